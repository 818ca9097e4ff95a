"""Errors of ANSI arithmetic and casts, functions without SQL against known values, and statistics at their edges."""

import hashlib
import zlib

import pytest
from pyspark.errors import ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException
from pyspark.sql import functions as F

from millrace.operators import statistics as stat


@pytest.mark.parametrize("sql,error", [
    ("SELECT 2147483647 + id FROM one", ArithmeticException), ("SELECT CAST(id + 299 AS TINYINT) FROM one", ArithmeticException), 
    ("SELECT id / 0 FROM one", ArithmeticException), ("SELECT id % 0 FROM one", ArithmeticException), ("SELECT sum(x) FROM (VALUES (9223372036854775807), (1)) v(x)", ArithmeticException),
    ("SELECT abs(CAST(-2147483648 AS INT))", ArithmeticException), ("SELECT CAST(CAST(1000 AS DECIMAL(5, 1)) AS DECIMAL(3, 1))", ArithmeticException), ("SELECT CAST('12x' AS INT)", NumberFormatException),
    ("SELECT CAST('2024-02-30' AS DATE)", DateTimeException), ("SELECT array(1, 2)[5]", ArrayIndexOutOfBoundsException), ("SELECT element_at(array(1, 2), 5)", ArrayIndexOutOfBoundsException),
    ("SELECT CAST(1e20D AS BIGINT)", ArithmeticException), ("SELECT 9223372036854775807L * (id + 1) FROM one", ArithmeticException),
])
def test_ansi_errors(spark, sql, error):
    spark.range(1, 2).createOrReplaceTempView("one")
    sql = sql.replace("2147483647 + id", "2147483647 + CAST(id AS INT)")
    with pytest.raises(error):
        spark.sql(sql).collect()


def soundex(w):
    codes = {c: str(k) for k, s in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in s}
    out, last = w[0].upper(), codes.get(w[0].lower(), "")
    for c in w[1:].lower():
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "hw":
            last = code
    return (out + "000")[:4]


def test_hashes_and_codes_against_known_values(spark):
    words = ["Robert", "Rupert", "Rubin", "Tymczak", "Pfister", "Honeyman", "Ashcraft", "lee", "gauss"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = df.select("w", F.soundex("w").alias("s"), *(F.sha2("w", n).alias(f"h{n}") for n in (224, 256, 384, 512)), F.crc32(F.col("w").cast("binary")).alias("c"), F.sha1("w").alias("h1"), F.md5("w").alias("m"), F.size(F.shuffle(F.split("w", ""))).alias("n"))
    for r in out.collect():
        b = r.w.encode()
        assert r.s == soundex(r.w)
        assert [r.h224, r.h256, r.h384, r.h512] == [getattr(hashlib, f"sha{n}")(b).hexdigest() for n in (224, 256, 384, 512)]
        assert (r.c, r.h1, r.m, r.n) == (zlib.crc32(b), hashlib.sha1(b).hexdigest(), hashlib.md5(b).hexdigest(), len(r.w))
    assert [soundex(w) for w in words[:4]] == ["R163", "R163", "R150", "T522"]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles_with_a_coarse_sketch(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=3000)] + [("b", float(x)) for x in rng.integers(0, 5, 777)] + [("c", 7.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    df, ps = spark.createDataFrame(rows, "g string, v double"), [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.g, r.p): r.value for r in stat.quantiles(df, "v", ps, ("g",), exact=True, accuracy=accuracy).collect()}
    assert len(got) == 4 * len(ps)
    for g in "abce":
        want = np.quantile([v for k, v in rows if k == g], ps)
        assert np.allclose([got[g, p] for p in ps], want, atol=1e-12)
    assert {r.p: r.value for r in stat.quantiles(df.filter("g = 'c'"), "v", [0.5]).collect()} == {0.5: 7.0}
    assert stat.quantiles(df.filter("g = 'zz'"), "v", [0.5], ("g",), exact=True).count() == 0


def test_samples_do_not_depend_on_the_partitioning(spark):
    df = spark.range(20_000).withColumn("s", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    ids = lambda d: sorted(r.id for r in stat.sample(d, "id", 0.1, 3).collect())
    assert ids(df.repartition(7)) == ids(df.coalesce(1)) and 1700 < len(ids(df)) < 2300
    by = stat.sample_by(df, "s", {"x": 1.0, "y": 0.0}, "id", 3)
    assert by.count() == 10_000 and by.filter("s = 'y'").count() == 0
