"""Edges: empty inputs of every operator, literals, casts, decimals, and clauses that the other families leave out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.registry import REGISTRY, Tables

q, S = REGISTRY.query, REGISTRY.sql
NONE = "(SELECT * FROM orders WHERE o_orderkey < 0) e"

# --- no rows
S("e_empty_scan", "orders", f"SELECT o_orderkey, o_orderstatus FROM {NONE} WHERE o_totalprice > 1", "P1 empty")
S("e_empty_group", "orders", f"SELECT o_orderstatus, count(*) AS n FROM {NONE} GROUP BY o_orderstatus", "A1 empty")
S("e_empty_global", "orders", f"SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderdate) AS m, avg(o_totalprice) AS a, max(o_orderstatus) AS x, count(DISTINCT o_custkey) AS d FROM {NONE}", "A2 empty")
S("e_empty_having", "orders", f"SELECT count(*) AS n FROM {NONE} HAVING count(*) > 0", "A3 empty")
S("e_empty_rollup", "orders", f"SELECT o_orderstatus, count(*) AS n FROM {NONE} GROUP BY GROUPING SETS ((o_orderstatus), ())", "A7 A9 empty", f"SELECT o_orderstatus, count(*) AS n FROM {NONE} GROUP BY o_orderstatus")
S("e_empty_inner", "orders customer", f"SELECT c_custkey, o_orderkey FROM customer JOIN {NONE} ON c_custkey = o_custkey", "J1 empty")
S("e_empty_left", "orders customer", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {NONE} ON c_custkey = o_custkey", "J2 empty")
S("e_empty_full", "orders nation", f"SELECT n_nationkey, o_orderkey FROM nation FULL JOIN {NONE} ON n_nationkey = o_custkey", "J4 empty")
S("e_empty_semi_anti", "orders nation", f"SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM {NONE} WHERE o_custkey = n_nationkey) AND n_nationkey NOT IN (SELECT o_custkey FROM {NONE}) AND NOT n_nationkey IN (SELECT o_orderkey FROM {NONE})", "J5 Q2 Q3 empty")
S("e_empty_cross", "orders nation", f"SELECT n_nationkey, o_orderkey FROM nation CROSS JOIN {NONE}", "J3 empty")
S("e_empty_scalar", "orders nation", f"SELECT n_nationkey, (SELECT max(o_orderkey) FROM {NONE}) AS m FROM nation", "Q1 empty")
S("e_empty_set", "orders", f"SELECT o_orderstatus AS k FROM orders EXCEPT SELECT o_orderstatus FROM {NONE} UNION ALL SELECT o_orderstatus FROM {NONE}", "U1 U4 empty")
S("e_empty_intersect", "orders", f"SELECT o_custkey AS k FROM orders INTERSECT SELECT o_custkey FROM {NONE}", "U3 empty")
S("e_empty_window", "orders", f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS rn, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM {NONE}", "W1 empty")
S("e_empty_sort", "orders", f"SELECT DISTINCT o_orderkey FROM {NONE} ORDER BY o_orderkey DESC LIMIT 5 OFFSET 2", "O1 O2 O5 empty")
S("e_empty_explode", "orders", f"SELECT o_orderkey, w FROM {NONE} LATERAL VIEW explode(split(o_orderpriority, '-')) x AS w", "J12 empty", f"SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM {NONE}")


@q("e_empty_pivot", "A11 empty", "SELECT o_orderpriority, 0::BIGINT AS F FROM orders WHERE false")
def empty_pivot(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey < 0").groupBy("o_orderpriority").pivot("o_orderstatus", ["F"]).count()


@q("e_empty_na", "N1 N2 T1 O6 empty", "SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def empty_na(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey < 0").na.drop().na.fill("x").dropDuplicates(["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


# --- literals, casts, arithmetic at the edges
S("e_literals", "region", """SELECT CAST(127 AS TINYINT) AS b, CAST(-32768 AS SMALLINT) AS s, 2147483647 AS i, 9223372036854775807 AS l, CAST(-9223372036854775808 AS BIGINT) AS l0, 1.5E3D AS d, CAST(1.25 AS FLOAT) AS f, CAST(12.340 AS DECIMAL(6, 3)) AS dec,
'it''s' AS q, '' AS e, true AS t, DATE '2024-02-29' AS day, TIMESTAMP_NTZ '2024-12-31 23:59:59.999999' AS ts, CAST(NULL AS INT) AS n, X'00FF' AS bin, 1 + CAST(NULL AS INT) AS nn, array(1, NULL, 3)[1] AS elem""", "P29 literals",
  """SELECT 127::TINYINT AS b, '-32768'::SMALLINT AS s, 2147483647 AS i, 9223372036854775807 AS l, '-9223372036854775808'::BIGINT AS l0, 1500::DOUBLE AS d, 1.25::FLOAT AS f, 12.340::DECIMAL(6, 3) AS dec,
'it''s' AS q, '' AS e, true AS t, DATE '2024-02-29' AS day, TIMESTAMP '2024-12-31 23:59:59.999999' AS ts, NULL::INTEGER AS n, '\\x00\\xFF'::BLOB AS bin, 1 + NULL::INTEGER AS nn, NULL::INTEGER AS elem""".replace("\\\\", "\\"))  # fmt: skip
S("e_interval_literals", "orders", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS m, o_orderdate - INTERVAL '36' HOUR AS h, CAST(o_orderdate AS DATE) + INTERVAL '1' DAY AS d FROM orders", "P29 intervals",
  "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 36 HOUR AS h, (o_orderdate::DATE + 1)::DATE AS d FROM orders")
S("e_try_cast", "region", """SELECT try_cast('12' AS INT) AS a, try_cast('12x' AS INT) AS b, try_cast('99999999999' AS INT) AS c, try_cast('1.5' AS DOUBLE) AS d, try_cast('abc' AS DOUBLE) AS e, try_cast('2024-02-30' AS DATE) AS f,
try_cast('2024-02-29' AS DATE) AS g, try_cast('true' AS BOOLEAN) AS h, try_cast('maybe' AS BOOLEAN) AS i, try_cast('' AS INT) AS j, try_cast(300 AS TINYINT) AS k, try_cast(1e20 AS BIGINT) AS l""", "P12 casts",
  """SELECT 12 AS a, NULL::INTEGER AS b, NULL::INTEGER AS c, 1.5::DOUBLE AS d, NULL::DOUBLE AS e, NULL::DATE AS f, DATE '2024-02-29' AS g, true AS h, NULL::BOOLEAN AS i, NULL::INTEGER AS j, NULL::TINYINT AS k, NULL::BIGINT AS l""")  # fmt: skip
S("e_casts", "lineitem", """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INT) AS i, CAST(-l_tax * 100 AS BIGINT) AS neg, CAST(l_quantity AS STRING) AS s, CAST(l_linenumber AS STRING) AS si, CAST(l_linenumber AS BOOLEAN) AS b, CAST(l_linenumber > 3 AS INT) AS bi,
CAST(l_shipdate AS DATE) AS d, CAST(CAST(l_shipdate AS DATE) AS STRING) AS ds, CAST(CAST(l_orderkey AS STRING) AS BIGINT) AS back, CAST(l_extendedprice AS DECIMAL(12, 1)) AS dec FROM lineitem""", "P12 casts",
  """SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::INTEGER AS i, trunc(-l_tax * 100)::BIGINT AS neg, l_quantity::VARCHAR AS s, l_linenumber::VARCHAR AS si, l_linenumber <> 0 AS b, (l_linenumber > 3)::INTEGER AS bi,
l_shipdate::DATE AS d, l_shipdate::DATE::VARCHAR AS ds, l_orderkey AS back, l_extendedprice::VARCHAR::DECIMAL(12, 1) AS dec FROM lineitem""")  # fmt: skip
S("e_try_arithmetic", "region", """SELECT try_add(2147483647, 1) AS a, try_subtract(-2147483648, 1) AS b, try_multiply(9223372036854775807, 2) AS c, try_divide(1, 0) AS d, try_divide(7, 2) AS e, try_sum(x) AS f, try_avg(x) AS g, try_element_at(array(1, 2), 5) AS h
FROM (VALUES (9223372036854775807), (1)) v(x)""", "overflow",
  "SELECT NULL::INTEGER AS a, NULL::INTEGER AS b, NULL::BIGINT AS c, NULL::DOUBLE AS d, 3.5::DOUBLE AS e, NULL::BIGINT AS f, (9223372036854775807::DOUBLE + 1) / 2 AS g, NULL::INTEGER AS h")
S("e_sum_widens", "lineitem", "SELECT sum(CAST(100 AS TINYINT)) AS b, sum(2147483647) AS i, sum(CAST(0.01 AS DECIMAL(5, 2))) AS d FROM lineitem", "overflow P21",
  "SELECT (count(*) * 100)::BIGINT AS b, (count(*) * 2147483647)::BIGINT AS i, (count(*) * 0.01)::DECIMAL(15, 2) AS d FROM lineitem")
S("e_decimals", "region", """SELECT CAST(1.005 AS DECIMAL(10, 2)) AS half_up, CAST(-1.005 AS DECIMAL(10, 2)) AS half_down, CAST('2.345' AS DECIMAL(4, 2)) AS s, CAST(CAST(1 AS DECIMAL(10, 2)) / CAST(3 AS DECIMAL(10, 2)) AS STRING) AS third,
CAST(CAST(1.10 AS DECIMAL(38, 10)) * CAST(2 AS DECIMAL(38, 10)) AS STRING) AS capped, CAST(round(CAST(2.5 AS DECIMAL(3, 1))) AS STRING) AS r, CAST(CAST(7.25 AS DECIMAL(5, 2)) % CAST(2 AS DECIMAL(5, 2)) AS STRING) AS m""", "P21",
  "SELECT 1.01::DECIMAL(10, 2) AS half_up, -1.01::DECIMAL(10, 2) AS half_down, 2.35::DECIMAL(4, 2) AS s, '0.3333333333333' AS third, '2.200000' AS capped, '3' AS r, '1.25' AS m")

# --- generators and aggregates with NULLs
S("e_explode_outer", "part", "SELECT p_partkey, w FROM part LATERAL VIEW OUTER explode(CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN array() ELSE array('a', CAST(NULL AS STRING)) END) x AS w", "explode_outer",
  "SELECT p_partkey, NULL::VARCHAR AS w FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, unnest(['a', NULL]) FROM part WHERE NOT p_size < 20")


@q("e_explode_outer_map", "explode_outer posexplode_outer inline_outer", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'k' END AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS value FROM nation")
def explode_outer_map(t: Tables) -> DataFrame:
    m = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("k"), F.col("n_regionkey")))
    return t.nation.select("n_nationkey", F.explode_outer(m))


S("e_first_ignore", "nation", "SELECT n_regionkey, first(CASE WHEN n_nationkey > 4 THEN n_regionkey END, true) AS f, last(CASE WHEN n_nationkey > 4 THEN n_regionkey END) IGNORE NULLS AS l, first(n_regionkey) AS a FROM nation GROUP BY n_regionkey", "first last",
  "SELECT n_regionkey, max(CASE WHEN n_nationkey > 4 THEN n_regionkey END) AS f, max(CASE WHEN n_nationkey > 4 THEN n_regionkey END) AS l, n_regionkey AS a FROM nation GROUP BY n_regionkey")
S("e_window_ignore", "events", """SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER w AS f, nth_value(CASE WHEN event_type = 'purchase' THEN event_id END, 2) IGNORE NULLS OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "W7",
  """SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS f, nth_value(CASE WHEN event_type = 'purchase' THEN event_id END, 2 IGNORE NULLS) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")  # fmt: skip
S("e_null_keys", "labels documents", "SELECT quality, count(*) AS n, sum(doc_id) AS s FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality", "A1 P15",
  "SELECT quality, count(*) AS n, sum(doc_id)::BIGINT AS s FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")

# --- clauses
S("e_sql_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) AS n FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "A11 pivot",
  "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o FROM orders GROUP BY o_orderpriority")
S("e_sql_unpivot", "nation", "SELECT n_nationkey, what, v FROM (SELECT n_nationkey, n_regionkey AS a, nullif(n_regionkey, 2) AS b FROM nation) UNPIVOT INCLUDE NULLS (v FOR what IN (a, b))", "A12 unpivot",
  "SELECT n_nationkey, 'a' AS what, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', nullif(n_regionkey, 2) FROM nation")
S("e_distribute_sort", "orders", "SELECT o_custkey, o_orderkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey, o_orderkey", "O8 sort by", "SELECT o_custkey, o_orderkey FROM orders")
S("e_cluster_by", "orders", "SELECT o_custkey, o_orderkey FROM orders CLUSTER BY o_custkey", "O8 cluster by", "SELECT o_custkey, o_orderkey FROM orders")
S("e_hints", "orders customer", "SELECT /*+ MERGE(c), REPARTITION(3, c_custkey) */ c_custkey, o_orderkey FROM customer c JOIN orders ON c_custkey = o_custkey", "hints", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")


@q("e_positional_parameters", "S13", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000.0 AND o_orderstatus = 'O'")
def positional_parameters(t: Tables) -> DataFrame:
    return t.views("orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", args=[400000.0, "O"])


@q("e_tumbling_window", "window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def tumbling_window(t: Tables) -> DataFrame:
    g = t.events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return g.select(F.col("w.start").alias("began"), "event_type", "n", "v")


@q("e_sliding_window", "window", "SELECT began, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i::INTEGER) AS began FROM events, range(2) r(i)) GROUP BY began")
def sliding_window(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "n")


@q("e_transpose_and_names", "P10", "SELECT n_nationkey AS \"a.b\", n_name AS \"with space\", n_regionkey AS \"Ünï\" FROM nation")
def odd_names(t: Tables) -> DataFrame:
    d = t.nation.toDF("a.b", "with space", "Ünï")
    return d.select(F.col("`a.b`"), F.col("`with space`"), F.col("Ünï"))


@q("e_running_by_many", "W2", "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS a FROM lineitem")
def running_by_many(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_extendedprice").rowsBetween(Window.currentRow, 2)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.avg("l_quantity").over(w), 6).alias("a"))
