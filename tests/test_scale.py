"""Queries over tables whose size or skew the test data doesn't have."""

import math
import random
import threading

import duckdb

from millrace.plans import load

R = load()


def rows(table) -> list[tuple]:
    return sorted(zip(*(table[c].to_pylist() for c in sorted(table.column_names))), key=str)


def same_as_sql(spark, folder, name: str, *tables: str) -> None:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert rows(R.builders[name](spark, str(folder)).toArrow()) == rows(con.execute(R.oracles[name]).to_arrow_table())


def test_quantiles_of_more_rows_than_a_sketch_tells_apart(spark, tmp_path):
    spark.range(0, 3_600_000, 1, 4).selectExpr(
        "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'O' ELSE 'F' END AS l_linestatus", "id * 7919 % 3600000 AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber",
        "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity", "CAST(id % 991 AS DOUBLE) AS l_extendedprice", "CAST(id % 9 AS DOUBLE) / 100 AS l_tax",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, tmp_path, "fn_agg_logic_bits", "lineitem")


def test_discrete_quantiles_at_edges(spark):
    from millrace.operators import statistics as stat

    ps, data = [0.0, 0.07, 0.25, 0.5, 0.55, 0.9, 1.0], [("a", k * 37 % 100) for k in range(100)] + [("a", None), ("b", None), (None, 3), (None, 4), ("c", 5)]
    got = {(r.g, r.p): r.value for r in stat.quantiles(spark.createDataFrame(data, "g string, v bigint"), "v", ps, ("g",), exact=True, accuracy=20, discrete=True).collect()}
    con, want = duckdb.connect(), {}
    con.execute("CREATE TABLE d (g VARCHAR, v BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?)", data)
    for p in ps:
        want |= {(g, p): v for g, v in con.execute(f"SELECT g, quantile_disc(v, {p}::DOUBLE) FROM d GROUP BY g HAVING count(v) > 0").fetchall()}
    assert got == want


def within(spark, seconds: int, f):
    """f's result; its jobs are cancelled after that time."""
    spark.sparkContext.setJobGroup("within", "within", True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup("within"))
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_bands_of_equal_prices_need_no_pairs(spark, tmp_path):
    n = 600_000  # 1.2e11 pairs
    spark.range(0, n, 1, 4).selectExpr("id AS p_partkey", "CASE WHEN id % 3 = 0 THEN 900.0D WHEN id % 3 = 1 THEN 900.1D ELSE 900.2D END AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    out = within(spark, 60, lambda: R.builders["j_range"](spark, str(tmp_path)).groupBy("n").count().collect())
    assert {r["n"]: r["count"] for r in out} == {n * 2 // 3: n * 2 // 3, n // 3: n // 3}


def test_bands_of_odd_prices(spark, tmp_path):
    rng = random.Random(5)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -0.15, 0.15, 0.3, 1e300, -1e17, 2.0**50, 2.0**50 - 0.125, 2.0**50 + 0.25, 5e-324]
    near = [k * 0.15 + e for k in range(-40, 40) for e in (0.0, 1e-16, -1e-16, 1e-13, -1e-13)]
    cents = [rng.randrange(90_000, 90_300) / 100 for _ in range(2_000)]
    prices = odd + near + cents + [rng.uniform(899.9, 901.1) for _ in range(2_000)] + odd + near
    keys = [None, None, 7, 7, 7, *range(1000, 1000 + len(prices) - 5)]
    rng.shuffle(prices)
    spark.createDataFrame(list(zip(keys, prices)), "p_partkey bigint, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, tmp_path, "j_range", "part")


def test_sketches_are_not_held_for_every_distinct_value(spark, tmp_path):
    spark.range(0, 600_000, 1, 4).selectExpr("id AS l_partkey", "id AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    within(spark, 90, lambda: same_as_sql(spark, tmp_path, "fn_agg_approx", "lineitem"))


def test_sketches_of_no_rows(spark, tmp_path):
    spark.range(0).selectExpr("id AS l_partkey", "id AS l_suppkey", "CAST(id AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, tmp_path, "fn_agg_approx", "lineitem")
