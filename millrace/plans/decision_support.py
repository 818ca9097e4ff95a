"""Decision-support queries whose SQL text is the same on both engines; columns the tables lack are swapped for near ones."""

from millrace.registry import REGISTRY

S = REGISTRY.sql
NET = "l_extendedprice * (1 - l_discount)"

S("q2_cheapest_supplier", "part supplier lineitem nation region", """
WITH cost AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS unit FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT s_acctbal, s_name, n_name, p_partkey, round(unit, 8) AS unit_cost FROM part JOIN cost c ON p_partkey = c.l_partkey JOIN supplier ON s_suppkey = c.l_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE p_size = 15 AND r_name = 'EUROPE' AND unit = (SELECT min(i.unit) FROM cost i JOIN supplier si ON si.s_suppkey = i.l_suppkey JOIN nation ni ON si.s_nationkey = ni.n_nationkey
JOIN region ri ON ni.n_regionkey = ri.r_regionkey WHERE i.l_partkey = p_partkey AND ri.r_name = 'EUROPE')""", "Q1 Q5 J10")  # fmt: skip
S("q3_shipping_priority", "customer orders lineitem", f"""
SELECT l_orderkey, round(sum({NET}), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""", "J10 O1 O2")  # fmt: skip
S("q4_order_priority", "orders lineitem", """
SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""", "Q2 J3")  # fmt: skip
S("q5_local_supplier_volume", "customer orders lineitem supplier nation region", f"""
SELECT n_name, round(sum({NET}), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name ORDER BY revenue DESC""", "J5 J10")  # fmt: skip
S("q6_forecast_revenue", "lineitem", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""", "A2 P15 P20")  # fmt: skip
S("q7_volume_shipping", "supplier lineitem orders customer nation", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {NET} AS volume
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE (n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7' OR n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) shipping
GROUP BY supp_nation, cust_nation, l_year""", "J9 Q4 P26")  # fmt: skip
S("q8_market_share", "part supplier lineitem orders customer nation region", f"""
SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
SELECT CAST(year(o_orderdate) AS INT) AS o_year, {NET} AS volume, n2.n_name AS nation_name FROM part JOIN lineitem ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey
JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') a GROUP BY o_year""", "P14 A1")  # fmt: skip
S("q9_product_profit", "part supplier lineitem orders nation", f"""
SELECT n_name AS nation_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum({NET} - p_retailprice * l_quantity * 0.1), 4) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY n_name, CAST(year(o_orderdate) AS INT)""", "P16")  # fmt: skip
S("q10_returned_items", "customer orders lineitem nation", f"""
SELECT c_custkey, c_name, round(sum({NET}), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""", "O2")  # fmt: skip
S("q11_important_stock", "lineitem supplier nation", """
SELECT l_partkey, round(sum(l_extendedprice), 2) AS stock_value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7'
GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')""", "A3 Q1")  # fmt: skip
S("q12_priority_by_flag", "orders lineitem", """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1997-01-01' GROUP BY l_returnflag""", "P13 P14")  # fmt: skip
S("q13_customer_distribution", "customer orders", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
GROUP BY c_custkey) c_orders GROUP BY c_count""", "J2 Q4")  # fmt: skip
S("q14_promotion_effect", "lineitem part", f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END) / sum({NET}), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""", "A1 P16")  # fmt: skip
S("q15_top_supplier", "lineitem supplier", f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({NET}), 4) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""", "Q1 Q5")  # fmt: skip
S("q16_supplier_count", "part lineitem supplier", """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'SMALL%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0) GROUP BY p_brand, p_type, p_size""", "Q3 A4")  # fmt: skip
S("q17_small_quantity", "lineitem part", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#2' AND l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""", "Q1")  # fmt: skip
S("q18_large_orders", "customer orders lineitem", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""", "Q3 A3")  # fmt: skip
S("q19_discounted_revenue", "lineitem part", f"""
SELECT round(sum({NET}), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5
OR p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10
OR p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15""", "P20")  # fmt: skip
S("q20_part_promotion", "supplier nation part lineitem", """
SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_suppkey IN (
SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_suppkey HAVING sum(l_quantity) > 20)""", "Q3")  # fmt: skip
S("q21_waiting_suppliers", "supplier lineitem orders nation", """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name""", "Q2 J3 J4")  # fmt: skip
S("q22_sales_opportunity", "customer orders", """
SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) GROUP BY c_mktsegment""", "Q1 Q2")  # fmt: skip

# shapes of the retail corpus: windows over aggregates, rollups, set operations, frames
S("ds_share_of_region", "customer orders nation", """
SELECT n_regionkey, n_name, round(sum(o_totalprice), 2) AS sales, round(sum(o_totalprice) * 100 / sum(sum(o_totalprice)) OVER (PARTITION BY n_regionkey), 6) AS share
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name""", "W8 A1")  # fmt: skip
S("ds_rollup_rank", "lineitem part", """
SELECT p_type, p_brand, round(sum(l_extendedprice), 2) AS sales, CAST(grouping(p_type) + grouping(p_brand) AS INT) AS lochierarchy,
CAST(rank() OVER (PARTITION BY grouping(p_type) + grouping(p_brand), CASE WHEN grouping(p_brand) = 0 THEN p_type END ORDER BY sum(l_extendedprice) DESC) AS INT) AS rank_within
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand)""", "A7 W8 grouping")  # fmt: skip
S("ds_year_over_year", "orders", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey, CAST(year(o_orderdate) AS INT))
SELECT a.o_custkey, a.yr, a.total, round(b.total - a.total, 2) AS growth FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.yr = a.yr + 1""", "Q5 J9")  # fmt: skip
S("ds_channels", "orders lineitem", """
SELECT channel, k, count(*) AS n FROM (SELECT 'order' AS channel, o_orderstatus AS k FROM orders UNION ALL SELECT 'line' AS channel, l_linestatus AS k FROM lineitem
UNION ALL SELECT 'flag' AS channel, l_returnflag AS k FROM lineitem) u GROUP BY channel, k""", "U1")  # fmt: skip
S("ds_cross_channel", "orders lineitem", """
WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) AS n FROM (SELECT o_orderkey FROM a EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) b""", "U3 U4")  # fmt: skip
S("ds_moving_total", "orders", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS usual FROM orders""", "W2 W5")  # fmt: skip
S("ds_full_outer_counts", "orders lineitem", """
WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity = 50)
SELECT CAST(sum(CASE WHEN o.k IS NOT NULL AND l.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS o_only, CAST(sum(CASE WHEN o.k IS NULL AND l.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS l_only,
CAST(sum(CASE WHEN o.k IS NOT NULL AND l.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_sides FROM o FULL OUTER JOIN l ON o.k = l.k""", "J2")  # fmt: skip
