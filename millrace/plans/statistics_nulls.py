"""NULL handling and descriptive statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import statistics as stat
from millrace.registry import REGISTRY, Tables

q = REGISTRY.query
LABELLED = "(SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")


@q("n_drop_any", "N1", f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL AND lang IS NOT NULL")
def drop_any(t: Tables) -> DataFrame:
    return labelled(t).na.drop("any", subset=["quality", "lang"]).select("doc_id", "quality")


@q("n_drop_thresh", "N1", f"SELECT doc_id FROM {LABELLED} WHERE (quality IS NOT NULL)::INTEGER + (toxic IS NOT NULL)::INTEGER + (lang IS NOT NULL)::INTEGER >= 2")
def drop_thresh(t: Tables) -> DataFrame:
    return labelled(t).na.drop(thresh=2, subset=["quality", "toxic", "lang"]).select("doc_id")


@q("n_drop_all", "N1", f"SELECT doc_id FROM {LABELLED} WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def drop_all(t: Tables) -> DataFrame:
    return labelled(t).na.drop("all", subset=["quality", "toxic"]).select("doc_id")


@q("n_fill", "N2", f"SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 9) AS toxic, coalesce(lang, 'none') AS lang FROM {LABELLED}")
def fill(t: Tables) -> DataFrame:
    return labelled(t).na.fill({"quality": -1, "toxic": 9, "lang": "none"}).select("doc_id", "quality", "toxic", "lang")


@q("n_replace", "N3", f"SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS lang FROM {LABELLED}")
def replace(t: Tables) -> DataFrame:
    return labelled(t).na.replace({"en": "English", "de": "German"}, subset=["lang"]).select("doc_id", "lang")


@q("t_describe", "T1", """SELECT 'count' AS summary, count(l_linenumber)::VARCHAR AS l_linenumber, count(l_returnflag)::VARCHAR AS l_returnflag FROM lineitem
UNION ALL SELECT 'min', min(l_linenumber)::VARCHAR, min(l_returnflag) FROM lineitem UNION ALL SELECT 'max', max(l_linenumber)::VARCHAR, max(l_returnflag) FROM lineitem""")  # fmt: skip
def describe(t: Tables) -> DataFrame:
    return t.lineitem.describe("l_linenumber", "l_returnflag").filter("summary IN ('count', 'min', 'max')")


@q("t_describe_moments", "T1", "SELECT 'mean' AS summary, round(avg(l_quantity), 6) AS v FROM lineitem UNION ALL SELECT 'stddev', round(stddev(l_quantity), 6) FROM lineitem")
def describe_moments(t: Tables) -> DataFrame:
    return t.lineitem.describe("l_quantity").filter("summary IN ('mean', 'stddev')").select("summary", F.round(F.col("l_quantity").cast("double"), 6).alias("v"))


@q("t_summary", "T2", """SELECT 'count' AS summary, count(*)::VARCHAR AS n_nationkey FROM nation UNION ALL SELECT 'min', min(n_nationkey)::VARCHAR FROM nation UNION ALL SELECT '25%', quantile_disc(n_nationkey, 0.25)::VARCHAR FROM nation
UNION ALL SELECT '50%', quantile_disc(n_nationkey, 0.5)::VARCHAR FROM nation UNION ALL SELECT '75%', quantile_disc(n_nationkey, 0.75)::VARCHAR FROM nation UNION ALL SELECT 'max', max(n_nationkey)::VARCHAR FROM nation
UNION ALL SELECT 'count_distinct', count(DISTINCT n_nationkey)::VARCHAR FROM nation""")  # fmt: skip
def summary(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey").summary("count", "min", "25%", "50%", "75%", "max", "count_distinct")


@q("t_cov", "T3", "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS cov FROM lineitem")
def cov(t: Tables) -> DataFrame:
    return stat.covariance(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("cov", 2).alias("cov"))


@q("t_corr", "T4", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem")
def corr(t: Tables) -> DataFrame:
    return stat.correlation(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("corr", 8).alias("corr"))


@q("t_quantiles", "T5", """
SELECT 0.1::DOUBLE AS p, round(quantile_cont(l_extendedprice, 0.1), 6) AS value FROM lineitem UNION ALL SELECT 0.5::DOUBLE, round(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem
UNION ALL SELECT 0.9::DOUBLE, round(quantile_cont(l_extendedprice, 0.9), 6) FROM lineitem""")  # fmt: skip
def quantiles(t: Tables) -> DataFrame:
    return stat.quantiles(t.lineitem, "l_extendedprice", [0.1, 0.5, 0.9], exact=True).select("p", F.round("value", 6).alias("value"))


@q("t_crosstab", "T6", "SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, quality")
def crosstab(t: Tables) -> DataFrame:
    return stat.cross_tabulation(labelled(t), "lang", "quality")


@q("t_crosstab_wide", "T6", """SELECT o_orderstatus AS o_orderstatus_o_orderpriority, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH",
count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM", count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY o_orderstatus""")  # fmt: skip
def crosstab_wide(t: Tables) -> DataFrame:
    """The wide form as a pivot over given values: nothing goes through the driver, unlike stat.crosstab."""
    values = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = t.orders.groupBy(F.col("o_orderstatus").alias("o_orderstatus_o_orderpriority")).pivot("o_orderpriority", values).count()
    return wide.na.fill(0, values)


@q("t_freq_items", "T7", """SELECT 'lang' AS "column", lang AS item, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= (SELECT count(*) FROM documents) * 0.15
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= (SELECT count(*) FROM documents) * 0.15""")  # fmt: skip
def freq_items(t: Tables) -> DataFrame:
    return stat.frequent_items(t.documents, ["lang", "source"], 0.15)


@q("t_quantiles_by", "T5", """SELECT l_returnflag, 0.25::DOUBLE AS p, round(quantile_cont(l_extendedprice, 0.25), 6) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.99::DOUBLE, round(quantile_cont(l_extendedprice, 0.99), 6) FROM lineitem GROUP BY 1""")  # fmt: skip
def quantiles_by(t: Tables) -> DataFrame:
    return stat.quantiles(t.lineitem, "l_extendedprice", [0.25, 0.99], ("l_returnflag",), exact=True).withColumn("value", F.round("value", 6))


@q("t_summary_moments", "T2", """SELECT 'mean' AS summary, round(avg(l_quantity), 6) AS v FROM lineitem UNION ALL SELECT 'stddev', round(stddev(l_quantity), 6) FROM lineitem UNION ALL SELECT 'count', count(l_quantity)::DOUBLE FROM lineitem
UNION ALL SELECT 'min', min(l_quantity) FROM lineitem UNION ALL SELECT 'max', max(l_quantity) FROM lineitem""")  # fmt: skip
def summary_moments(t: Tables) -> DataFrame:
    """The default list without its approximate quartiles."""
    return t.lineitem.select("l_quantity").summary().filter("summary NOT LIKE '%\\%'").select("summary", F.round(F.col("l_quantity").cast("double"), 6).alias("v"))


@q("t_sample_by", "T8", """SELECT o_orderkey, o_orderstatus FROM orders WHERE substr(md5('5|' || o_orderkey), 1, 8) < CASE o_orderstatus WHEN 'F' THEN '33333333' WHEN 'O' THEN '80000000' END""")
def sample_by(t: Tables) -> DataFrame:
    return stat.sample_by(t.orders, "o_orderstatus", {"F": 0.2, "O": 0.5}, "o_orderkey", 5).select("o_orderkey", "o_orderstatus")
