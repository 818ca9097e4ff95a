"""Shapes of the retail decision-support corpus over the order tables: averages by group, channels, baskets, delays, deviations."""

from millrace.registry import REGISTRY

S = REGISTRY.sql

S("ds_above_usual", "lineitem orders customer", """
WITH r AS (SELECT o_custkey AS ck, sum(l_extendedprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_custkey),
n AS (SELECT c_nationkey AS nk, avg(total) AS usual FROM r JOIN customer ON ck = c_custkey GROUP BY c_nationkey)
SELECT c_custkey, c_name, round(total, 2) AS total FROM r JOIN customer ON ck = c_custkey JOIN n ON nk = c_nationkey WHERE total > 1.2 * usual""", "Q5 A1")  # fmt: skip
S("ds_quarter_columns", "orders", """
SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS yr, round(sum(CASE WHEN quarter(o_orderdate) = 1 THEN o_totalprice END), 2) AS q1, round(sum(CASE WHEN quarter(o_orderdate) = 2 THEN o_totalprice END), 2) AS q2,
round(sum(CASE WHEN quarter(o_orderdate) = 3 THEN o_totalprice END), 2) AS q3, round(sum(CASE WHEN quarter(o_orderdate) = 4 THEN o_totalprice END), 2) AS q4
FROM orders GROUP BY o_orderpriority, CAST(year(o_orderdate) AS INT)""", "A1 P14")  # fmt: skip
S("ds_bucket_report", "lineitem region", """
SELECT r_name, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20)
ELSE (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS low,
CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity > 40) > 100000000 THEN (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity > 40)
ELSE (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity > 40) END AS high FROM region WHERE r_regionkey = 1""", "Q1 P14")  # fmt: skip
S("ds_monthly_deviation", "lineitem part", """
WITH m AS (SELECT p_brand, CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate) AS INT) AS mon, round(sum(l_extendedprice), 2) AS s
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(year(l_shipdate) AS INT), CAST(month(l_shipdate) AS INT))
SELECT p_brand, yr, mon, s, round(avg(s) OVER (PARTITION BY p_brand, yr), 6) AS usual, lag(s) OVER (PARTITION BY p_brand ORDER BY yr, mon) AS previous, lead(s) OVER (PARTITION BY p_brand ORDER BY yr, mon) AS following FROM m""", "W1 W8")  # fmt: skip
S("ds_cumulative_channels", "events", """
WITH a AS (SELECT user_id AS u, CAST(ts AS DATE) AS d, sum(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id, CAST(ts AS DATE)),
b AS (SELECT user_id AS u, CAST(ts AS DATE) AS d, sum(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS n FROM events WHERE event_type <> 'purchase' GROUP BY user_id, CAST(ts AS DATE)),
j AS (SELECT coalesce(a.u, b.u) AS u, coalesce(a.d, b.d) AS d, a.n AS bought, b.n AS other FROM a FULL JOIN b ON a.u = b.u AND a.d = b.d)
SELECT u, d, CAST(max(bought) OVER (PARTITION BY u ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bought,
CAST(max(other) OVER (PARTITION BY u ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS other FROM j""", "W2 W8 J2")  # fmt: skip
S("ds_any_channel", "customer orders", """
SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
AND (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000))
GROUP BY c_nationkey, c_mktsegment""", "Q2")  # fmt: skip
S("ds_best_and_worst", "lineitem", """
WITH t AS (SELECT l_partkey AS k, round(avg(l_extendedprice), 4) AS usual FROM lineitem GROUP BY l_partkey),
best AS (SELECT k, usual FROM t ORDER BY usual DESC, k LIMIT 10), worst AS (SELECT k, usual FROM t ORDER BY usual, k LIMIT 10),
b AS (SELECT k, CAST(row_number() OVER (ORDER BY usual DESC, k) AS INT) AS place FROM best), w AS (SELECT k, CAST(row_number() OVER (ORDER BY usual, k) AS INT) AS place FROM worst)
SELECT b.place, b.k AS best_part, w.k AS worst_part FROM b JOIN w ON b.place = w.place""", "O2 W1")  # fmt: skip
S("ds_variation", "lineitem", """
WITH m AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS mon, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT))
SELECT a.k, a.mon, round(a.sd / a.mean, 5) AS cov, round(b.sd / b.mean, 5) AS next_cov FROM m a JOIN m b ON a.k = b.k AND b.mon = a.mon + 1 WHERE a.sd > 0 AND b.sd > 0""", "A1 J9")  # fmt: skip
S("ds_return_ratio", "lineitem part", """
WITH r AS (SELECT p_brand, l_partkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, sum(l_quantity) AS sold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_partkey)
SELECT p_brand, k, returned, sold, place FROM (SELECT p_brand, k, returned, sold, CAST(rank() OVER (PARTITION BY p_brand ORDER BY returned / sold DESC) AS INT) AS place FROM r) x WHERE place <= 10""", "W1 W8")  # fmt: skip
S("ds_delay_buckets", "lineitem orders", """
SELECT o_orderpriority, count(CASE WHEN CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL '30' DAY THEN 1 END) AS d30,
count(CASE WHEN CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AND CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL '90' DAY THEN 1 END) AS d90,
count(CASE WHEN CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + INTERVAL '90' DAY THEN 1 END) AS later FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""", "P25 P14")  # fmt: skip
S("ds_hour_counts", "events", """
SELECT event_type, count(CASE WHEN hour(ts) BETWEEN 8 AND 11 THEN 1 END) AS am, count(CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1 END) AS pm,
CAST(count(CASE WHEN hour(ts) BETWEEN 8 AND 11 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1 END), 0) AS ratio FROM events GROUP BY event_type""", "A1 P14")  # fmt: skip
S("ds_never_returned", "lineitem orders", """
WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN r ON o_orderkey = k WHERE k IS NULL GROUP BY o_custkey, CAST(year(o_orderdate) AS INT)""", "J2 P17")  # fmt: skip
S("ds_three_years", "orders", """
SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) x""", "U3")  # fmt: skip
S("ds_discount_excess", "lineitem", """
SELECT l_partkey, round(sum(l_extendedprice * l_discount), 4) AS excess FROM lineitem o
WHERE l_discount > 1.3 * (SELECT avg(i.l_discount) FROM lineitem i WHERE i.l_partkey = o.l_partkey) + 0.000001 GROUP BY l_partkey""", "Q1")  # fmt: skip
S("ds_baskets", "lineitem orders customer", """
WITH b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) BETWEEN 4 AND 6)
SELECT c_name, o_orderkey, n FROM b JOIN orders ON k = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""", "A3 J10")  # fmt: skip
S("ds_channel_rollup", "lineitem orders", """
SELECT channel, id, round(sum(sales), 2) AS sales, count(*) AS n FROM (SELECT 'orders' AS channel, o_orderstatus AS id, o_totalprice AS sales FROM orders
UNION ALL SELECT 'lines' AS channel, l_returnflag AS id, l_extendedprice * (1 - l_discount) AS sales FROM lineitem) x GROUP BY ROLLUP (channel, id)""", "A7 U1")  # fmt: skip
S("ds_other_supplier", "lineitem", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders_n, round(sum(l_extendedprice), 2) AS total FROM lineitem a
WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_quantity > 48) GROUP BY l_returnflag""", "Q2 A4")  # fmt: skip
S("ds_top_of_rollup", "orders customer nation", """
SELECT n_name, c_mktsegment, total, place FROM (SELECT n_name, c_mktsegment, total, CAST(rank() OVER (PARTITION BY n_name ORDER BY total DESC) AS INT) AS place FROM (
SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)) r) x WHERE place <= 3""", "A7 W8")  # fmt: skip
