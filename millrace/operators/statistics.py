"""Descriptive statistics as DataFrames: one distributed aggregate each, nothing is collected on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ``cov``: the sample covariance over rows where neither is NULL; 0.0 for fewer than two."""
    return df.agg(F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias("cov"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ``corr``: Pearson's correlation; NULL where it isn't defined."""
    return df.agg(F.corr(a, b).alias("corr"))


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: tuple[str, ...] = (), exact: bool = False, accuracy: int = 10_000, discrete: bool = False, sketch: str = "percentile_approx", few_groups: bool = False) -> DataFrame:
    """(by columns, p, value) for each group and probability: from a sketch of bounded size, or exact, interpolated or
    (discrete) the least value that at least a share p of the rows doesn't exceed. NULL is a group; sketch is either of its names.
    The limits of few_groups are broadcast, so that no row is shuffled by its group alone.

    The exact value comes from the ranks around it. The sketch, whose rank error is at most rows / accuracy, gives limits
    that surely hold them; rows below are only counted, and what lies between, some 4 / accuracy of the rows, is counted by
    distinct value, so no task sorts a whole group."""
    ps, v = [float(p) for p in probabilities], F.col(column)
    base = df.filter(v.isNotNull()).select(*by, v.alias("__v"))
    of = lambda at: F.call_function(sketch, F.col("__v"), F.array(*map(F.lit, at)), F.lit(accuracy))
    if not exact:
        found = base.groupBy(*by).agg(of(ps).alias("value"))
        zipped = F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("value"))
        return found.select(*by, F.inline(zipped).alias("p", "value"))
    around = [max(0.0, p - 2 / accuracy) for p in ps] + [min(1.0, p + 2 / accuracy) for p in ps]
    limits = base.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), of(around).alias("__q"))
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.col("__q")[k].alias("lo"), F.col("__q")[k + len(ps)].alias("hi")) for k, p in enumerate(ps)])
    limits = limits.select(*by, "__n", F.inline(each).alias("p", "__lo", "__hi"))
    if by:
        same = [F.col(f"__r.{k}").eqNullSafe(F.col(f"__l.{k}")) for k in by]
        rows = base.alias("__r").join((F.broadcast(limits) if few_groups else limits).alias("__l"), same).select("__r.*", "__l.__n", "__l.p", "__l.__lo", "__l.__hi")
    else:
        rows = base.crossJoin(F.broadcast(limits))  # a row a probability
    place = F.when(F.col("__v") < F.col("__lo"), -1).when(F.col("__v") > F.col("__hi"), 1).otherwise(0)
    counts = rows.withColumn("__at", place).groupBy(*by, "p", "__n", "__at", F.when(place == 0, F.col("__v")).alias("__k")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__v"))
    through = F.sum("__c").over(Window.partitionBy(*by, "p").orderBy("__at", "__v"))
    if discrete:
        least = F.greatest(F.col("__n") - F.floor(F.col("__n") - F.col("__n") * F.col("p")), F.lit(1))  # as SQL rounds it
        enough = F.col("__t") >= least
        return counts.withColumn("__t", through).groupBy(*by, "p").agg(F.min_by("__v", F.when(enough, F.col("__t"))).alias("value"))
    rank = (F.col("__n") - 1) * F.col("p")
    low, high = (F.min_by("__v", F.when(F.col("__t") > r, F.col("__t"))) for r in (F.floor(rank), F.ceil(rank)))
    out = counts.withColumn("__t", through).groupBy(*by, "p", "__n").agg(low.alias("__a"), high.alias("__b"))
    return out.select(*by, "p", (F.col("__a") + (F.col("__b") - F.col("__a")) * (rank - F.floor(rank))).alias("value"))


def frequent_items(df: DataFrame, columns: list[str], support: float) -> DataFrame:
    """(column, item as text, n): every non-NULL item in at least ``support`` of the rows, exactly."""
    one = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    items = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("item")) for c in columns])).alias("e")).select("e.*")
    counts = items.filter("item IS NOT NULL").groupBy("column", "item").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(one)).filter(F.col("n") >= F.col("total") * F.lit(support)).select("column", "item", "n")


def cross_tabulation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for each pair that occurs, NULLs included: the long form, which has no limit of columns."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample by a seeded hash of the key: the same rows on any cluster, in any partitioning and after a retry."""
    return df.filter(_share(key, seed) < F.lit(_limit(fraction)))


def sample_by(df: DataFrame, column: str, fractions: dict, key: str, seed: int) -> DataFrame:
    """The same by stratum; strata without a fraction are left out."""
    limit = F.lit(None).cast("string")
    for value, fraction in fractions.items():
        limit = F.when(F.col(column) == F.lit(value), F.lit(_limit(fraction))).otherwise(limit)
    return df.filter(_share(key, seed) < limit)


def _share(key: str, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8)


def _limit(fraction: float) -> str:
    """That share of 2^32 in hexadecimal; hashes compare as texts."""
    return "g" if fraction >= 1 else f"{max(0, int(fraction * 2**32)):08x}"
