"""Projections, joins, subqueries, grouping sets, windows, sorting and set operations, each as one DataFrame or SQL query."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.operators import statistics as stat
from millrace.registry import REGISTRY, Tables

q, S = REGISTRY.query, REGISTRY.sql


# --- projections and filters
@q("p_project_star", "P1 P2 P11", "SELECT *, upper(r_name) AS shout FROM region")
def project_star(t: Tables) -> DataFrame:
    return t.region.select("*", F.upper("r_name").alias("shout"))


@q("p_regex_columns", "P3", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def regex_columns(t: Tables) -> DataFrame:
    return t.customer.select(t.customer.colRegex("`c_.*`"))


@q("p_stacked_filters", "P4 P20 P27", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.02 AND l_returnflag = 'A'")
def stacked_filters(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_quantity") > 40).filter("l_discount < 0.02").where(F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber")


@q("p_with_columns", "P5 P6 P7", "SELECT n_nationkey * 2 AS n_nationkey, n_name AS nation_name, n_nationkey + n_regionkey AS both_keys FROM nation")
def with_columns(t: Tables) -> DataFrame:
    d = t.nation.withColumns({"n_nationkey": F.col("n_nationkey") * 2, "both_keys": F.col("n_nationkey") + F.col("n_regionkey")})
    return d.withColumnsRenamed({"n_name": "nation_name"}).drop("n_regionkey")


@q("p_to_df_names", "P6", "SELECT r_regionkey AS id, r_name AS label FROM region")
def to_df_names(t: Tables) -> DataFrame:
    return t.region.toDF("id", "label")


@q("p_to_schema", "P8", "SELECT r_name, r_regionkey::BIGINT AS r_regionkey FROM region")
def to_schema(t: Tables) -> DataFrame:
    return t.region.to(T.StructType([T.StructField("r_name", T.StringType()), T.StructField("r_regionkey", T.LongType())]))


@q("p_update_struct", "P23 P10 P22", "SELECT n_nationkey, n_name AS name, n_nationkey + 100 AS code, 2 AS n_fields FROM nation")
def update_struct(t: Tables) -> DataFrame:
    s = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).withField("code", F.col("n_nationkey") + 100).dropFields("region")
    return t.nation.select("n_nationkey", s.alias("s")).select("n_nationkey", "s.name", F.col("s")["code"].alias("code"), F.size(F.json_object_keys(F.to_json("s"))).alias("n_fields"))


@q("p_call_function", "P28", "SELECT n_nationkey, lower(n_name) AS low FROM nation")
def call_function(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.call_function("lower", F.col("n_name")).alias("low"))


@q("p_hint_repartition", "P30 P31", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def hint_repartition(t: Tables) -> DataFrame:
    return t.nation.join(t.region.hint("broadcast"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").repartition(4, "r_name").coalesce(2)


# --- joins
@q("j_inner", "J1", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_acctbal > 9000"), F.col("o_custkey") == F.col("c_custkey"), "inner").select("o_orderkey", "c_name")


for how in ("left", "right", "full"):
    def outer(t: Tables, how: str = how) -> DataFrame:
        c = t.customer.filter("c_acctbal > 5000").select("c_custkey", "c_acctbal")
        o = t.orders.filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
        return c.join(o, F.col("c_custkey") == F.col("o_custkey"), how)

    q(f"j_{how}_outer", "J2", f"SELECT c_custkey, c_acctbal, o_orderkey, o_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) {how.upper()} JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey")(outer)


@q("j_left_semi", "J3", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def left_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@q("j_left_anti", "J4", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def left_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@q("j_cross", "J5", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross(t: Tables) -> DataFrame:
    return t.nation.crossJoin(t.region).select("n_name", "r_name")


@q("j_using", "J6", "SELECT doc_id, a.lang, b.quality FROM documents a FULL JOIN labels b USING (doc_id)")
def using(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), ["doc_id"], "full")


S("j_natural", "nation region", "SELECT k, n, r FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS r FROM region) b", "J7")


@q("j_range", "J8", """WITH step AS (SELECT p_partkey AS lo_key, p_retailprice AS lo, p_retailprice + 0.15 AS hi FROM part)
SELECT lo_key, count(*) AS n FROM step JOIN part ON p_retailprice >= lo AND p_retailprice < hi GROUP BY lo_key""")  # fmt: skip
def range_join(t: Tables) -> DataFrame:
    """A band join that is only counted: by distinct price, as rows below the band's end less rows below its start.

    Cells are as wide as the band. A band asks in the cells from its start's to its end's how many rows lie below its end,
    and in the first one also below its start; one sort of a cell answers all of them, so no pair is formed."""
    width, x = 0.15, F.col("p_retailprice")
    cell = lambda c: F.floor(c / width)
    prices = t.part.filter(x < x + width).groupBy(x).agg(F.count(F.lit(1)).alias("c"))  # neither NULL, NaN nor without a band
    ask = lambda k, at, sign: F.struct(k.alias("cell"), at.alias("at"), F.lit(1).alias("row"), F.lit(0).cast("bigint").alias("c"), F.lit(sign).alias("sign"))
    row = F.struct(cell(x).alias("cell"), x.alias("at"), F.lit(2).alias("row"), F.col("c"), F.lit(0).alias("sign"))
    ends = F.transform(F.sequence(cell(x), cell(x + width)), lambda k: ask(k, x + width, 1))
    marks = prices.select(x, F.inline(F.concat(F.array(row, ask(cell(x), x, -1)), ends)))
    below = F.sum("c").over(Window.partitionBy("cell").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, 0))
    found = marks.withColumn("below", below).filter("sign <> 0").groupBy("p_retailprice").agg(F.sum(F.col("sign") * F.col("below")).alias("n"))
    return t.part.select(F.col("p_partkey").alias("lo_key"), x).join(found, "p_retailprice").groupBy("lo_key").agg(F.sum("n").alias("n"))


@q("j_self", "J9 P9", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@q("j_asof", "J11", """SELECT e.event_id, p.event_id AS prior_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")  # fmt: skip
def asof(t: Tables) -> DataFrame:
    """As-of join as one shuffle: both sides in one relation, the last click carried forward within the user."""
    w = Window.partitionBy("user_id").orderBy("ts", "is_right", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = t.events.filter(F.col("event_type").isin("purchase", "click")).withColumn("is_right", F.when(F.col("event_type") == "click", 0).otherwise(1))
    prior = F.last(F.when(F.col("is_right") == 0, F.col("event_id")), ignorenulls=True).over(w)
    return both.withColumn("prior_id", prior).filter("is_right = 1").select("event_id", "prior_id")


S("j_lateral", "customer orders", "SELECT c_custkey, o.n, o.total FROM customer, LATERAL (SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey = c_custkey) o", "J12 Q1")
S("j_lateral_view", "part", "SELECT word, count(*) AS n FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word GROUP BY word", "J12 explode", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) w GROUP BY word")
S("j_lateral_outer_pos", "part", "SELECT p_partkey, pos, word FROM part LATERAL VIEW OUTER posexplode(split(p_name, ' ')) w AS pos, word", "J12 posexplode explode_outer",
  "SELECT p_partkey, (i - 1)::INTEGER AS pos, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) w")
S("j_stack_inline", "nation", "SELECT n_nationkey, which, v FROM nation LATERAL VIEW stack(2, 'key', n_nationkey, 'region', n_regionkey) s AS which, v", "stack inline J12",
  "SELECT n_nationkey, 'key' AS which, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey FROM nation")

# --- subqueries and tables made of literals
S("s_scalar_subquery", "customer", "SELECT c_custkey, c_acctbal - (SELECT max(c_acctbal) FROM customer) AS below FROM customer", "Q1", "SELECT c_custkey, c_acctbal - (SELECT max(c_acctbal) FROM customer) AS below FROM customer")
S("s_not_in_null", "nation", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END FROM nation)", "Q3")
S("s_cte_columns", "nation", "WITH a(k, v) AS (SELECT n_regionkey, n_nationkey FROM nation), b AS (SELECT k, CAST(sum(v) AS BIGINT) AS total FROM a GROUP BY k) SELECT k, total FROM b WHERE total > 20", "Q5")
S("s_values", "region", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)", "S10 P29")
S("s_one_row", "region", "SELECT 1 AS one, 'a' AS letter", "S11 S12")


@q("s_range", "S9", "SELECT range AS id FROM range(3, 40, 4)")
def number_range(t: Tables) -> DataFrame:
    return t.spark.range(3, 40, 4)


@q("s_local_data", "S8", "SELECT 1 AS id, 'a' AS v UNION ALL SELECT 2, NULL")
def local_data(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")


@q("s_named_parameters", "S13", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000.0 AND o_orderstatus = 'F'")
def named_parameters(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 450000.0, "status": "F"}, o=t.orders)


@q("s_table_view", "S2 K9", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def table_view(t: Tables) -> DataFrame:
    return t.views("nation").table("nation").filter("n_regionkey = 1").select("n_name")


# --- grouping
@q("a_rollup", "A7 grouping_id", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("total"), F.grouping_id().alias("gid"))


@q("a_cube", "A8 grouping", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").alias("g"))


S("a_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "A9")
S("a_keys_only", "lineitem", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey", "A10")
S("a_having_composite", "lineitem", "SELECT l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit FROM lineitem GROUP BY l_suppkey HAVING count(*) > 3 AND max(l_tax) > 0.05", "A1 A3")


@q("a_pivot", "A11", """SELECT l_returnflag, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS F_s, count(*) FILTER (WHERE l_linestatus = 'F') AS F_n,
CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS O_s, count(*) FILTER (WHERE l_linestatus = 'O') AS O_n FROM lineitem GROUP BY l_returnflag""")  # fmt: skip
def pivot(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("n"))
    return p.na.fill(0, ["F_n", "O_n"])


@q("a_pivot_discovered", "A11", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def pivot_discovered(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus").count().na.fill(0)


@q("a_unpivot", "A12", "SELECT l_orderkey, l_linenumber, 'l_tax' AS what, l_tax AS val FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def unpivot(t: Tables) -> DataFrame:
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "what", "val")


# --- windows
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
I = "CAST({} AS INT)".format  # noqa: E741
@q("w_ranks", "W1 W6 row_number rank dense_rank percent_rank cume_dist ntile", f"""SELECT o_orderkey, {I('row_number() OVER w')} AS rn, {I('rank() OVER v')} AS rk, {I('dense_rank() OVER v')} AS dr, round(percent_rank() OVER v, 6) AS pr,
round(cume_dist() OVER v, 6) AS cd, {I('ntile(4) OVER w')} AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)""")
def ranks(t: Tables) -> DataFrame:
    """Ranks within three statuses come from counts by status and date, a table as long as the calendar, joined back to the
    rows: a window over the rows themselves would be three tasks at any size."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = Window.partitionBy("o_orderstatus").orderBy("o_orderdate")
    dates = t.orders.groupBy("o_orderstatus", "o_orderdate").agg(F.count(F.lit(1)).alias("c"))
    dates = dates.withColumns({"upto": F.sum("c").over(v), "dr": F.row_number().over(v), "total": F.sum("c").over(Window.partitionBy("o_orderstatus"))})
    dates = dates.select(F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("d"), "c", "upto", "dr", "total")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", F.row_number().over(w).alias("rn"), F.ntile(4).over(w).alias("nt"))
    rk = F.col("upto") - F.col("c") + 1
    return rows.join(dates, F.col("o_orderstatus").eqNullSafe(F.col("s")) & F.col("o_orderdate").eqNullSafe(F.col("d"))).select(
        "o_orderkey", "rn", rk.cast("int").alias("rk"), "dr", F.round(F.when(F.col("total") > 1, (rk - 1) / (F.col("total") - 1)).otherwise(0.0), 6).alias("pr"),
        F.round(F.col("upto") / F.col("total"), 6).alias("cd"), "nt",
    )


S("w_lag_lead", "events", f"""SELECT event_id, lag(value) OVER {W} AS prev, lead(value, 2) OVER {W} AS nxt2, lag(value, 1, -1.0D) OVER {W} AS prev0, first_value(event_type) OVER {W} AS f,
last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER {W} AS n2 FROM events""", "W1 lag lead first last nth_value",
  f"""SELECT event_id, lag(value) OVER {W} AS prev, lead(value, 2) OVER {W} AS nxt2, lag(value, 1, -1.0) OVER {W} AS prev0, first_value(event_type) OVER {W} AS f,
last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER {W} AS n2 FROM events""")  # fmt: skip


@q("w_frames", "W2 W3 W5", """SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near_rows,
CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near_values,
count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem""")  # fmt: skip
def frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.sum("l_linenumber").over(w.rowsBetween(-1, 1)).alias("near_rows"), F.sum("l_linenumber").over(w.rangeBetween(-2, Window.currentRow)).alias("near_values"),
        F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"),
    )


@q("w_groups_frame", "W4", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS peers FROM lineitem")
def groups_frame(t: Tables) -> DataFrame:
    """A GROUPS frame is a RANGE frame over the dense rank of the order."""
    w = Window.partitionBy("l_suppkey")
    d = t.lineitem.withColumn("g", F.dense_rank().over(w.orderBy("l_quantity")))
    return d.select("l_orderkey", "l_linenumber", F.count("*").over(w.orderBy("g").rangeBetween(-1, 0)).alias("peers"))


@q("w_ignore_nulls", "W7", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events""")
def ignore_nulls(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_buy"))


@q("w_over_aggregate", "W8", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority")
def over_aggregate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("o_orderstatus")))


@q("w_sessions", "session_window", """SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR, true) AS gap FROM events)) GROUP BY user_id, s""")  # fmt: skip
def sessions(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("began"), F.count("*").alias("n")).drop("w")


# --- order, limits, duplicates
@q("o_sort_nulls", "O1", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id")
def sort_nulls(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").orderBy(F.col("quality").desc_nulls_last(), "doc_id")


@q("o_limit_offset", "O2 O3", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(10).limit(25)


@q("o_tail", "O4", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5")
def tail(t: Tables) -> DataFrame:
    """The last rows of an order are the first ones of its reverse: a distributed top-k, unlike tail() on the driver."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(5)


@q("o_distinct", "O5", "SELECT DISTINCT lang, source FROM documents")
def distinct(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()


@q("o_drop_duplicates", "O6", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def drop_duplicates(t: Tables) -> DataFrame:
    """One row a key with all its columns. Which one is fixed by an order, unlike dropDuplicates, and found by an aggregate
    with partial results, so a key with very many rows is no single task's, unlike with a window."""
    d = t.orders
    order = F.struct(F.datediff(F.lit("1970-01-01"), "o_orderdate"), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey")
    return d.groupBy("o_custkey").agg(F.min_by(F.struct(*d.columns), order).alias("r")).select("r.*")


@q("o_drop_duplicates_any", "O6", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def drop_duplicates_any(t: Tables) -> DataFrame:
    return t.lineitem.dropDuplicates(["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus")


@q("o_sample", "O7", "SELECT o_orderkey FROM orders WHERE substr(md5('11|' || o_orderkey), 1, 8) < '19999999'")
def sample(t: Tables) -> DataFrame:
    return stat.sample(t.orders, "o_orderkey", 0.1, 11).select("o_orderkey")


@q("o_table_sample", "O7", "SELECT n_nationkey FROM nation")
def table_sample(t: Tables) -> DataFrame:
    """TABLESAMPLE at its edges: all rows, and none."""
    s = t.views("nation")
    return s.sql("SELECT n_nationkey FROM nation TABLESAMPLE (100 PERCENT) UNION ALL SELECT n_nationkey FROM nation TABLESAMPLE (0 ROWS)")


# --- set operations
@q("u_union_widening", "U1", "SELECT n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT s_suppkey FROM supplier")
def union_widening(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k")).union(t.supplier.select("s_suppkey"))


S("u_union_distinct", "orders lineitem", "SELECT o_orderstatus AS k FROM orders UNION SELECT l_linestatus FROM lineitem", "U1")


@q("u_union_by_name", "U2", "SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_by_name(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(t.region.select(F.col("r_name").alias("extra"), F.col("r_regionkey").alias("k")), allowMissingColumns=True)


SIDES = "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') {} (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"
for name, word, method in (("intersect", "INTERSECT", "intersect"), ("intersect_all", "INTERSECT ALL", "intersectAll"), ("except", "EXCEPT", "subtract"), ("except_all", "EXCEPT ALL", "exceptAll")):
    def set_op(t: Tables, method: str = method) -> DataFrame:
        side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
        return getattr(side("F"), method)(side("O"))

    q(f"u_{name}", "U3" if "inter" in name else "U4", SIDES.format(word))(set_op)
