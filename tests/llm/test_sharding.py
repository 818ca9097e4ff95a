from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import sharding as S

from .conftest import ODD, canon, doc


def corpus(n=500):
    return [doc(i, f"text {i}", source="hot" if i % 3 else f"src{i % 7}") for i in range(n)] + ODD


def test_sql(make, duck):
    # repeated rows and rows without id tie in the oracle
    rows = [r for r in corpus() if r[0] is not None]
    df = make(rows)
    for size, bucket in ((64, 8192), (7, 5), (10_000, 3)):
        got = canon(S.shard(df, rows_per_shard=size, bucket_rows=bucket).filter("doc_id <> 6"))
        cols, want = duck(S.ORACLE.replace(str(S.ROWS_PER_SHARD), str(size)), documents=df)
        assert got == (cols, [r for r in want if r[0] != "6"])


def test_every_shard_matches_the_mixture(make):
    rows = corpus(1000)
    out = S.shard(make(rows, clash=True), rows_per_shard=50).collect()
    assert len(out) == len(rows)
    total = Counter(r[3] for r in rows)
    shards = {r.shard for r in out}
    for k in shards:
        mine = Counter(r.source for r in out if r.shard == k)
        n = sum(mine.values())
        assert abs(n - len(rows) / len(shards)) <= 1
        for s, t in total.items():
            assert abs(mine[s] - t / len(shards)) <= 2 + t / len(rows) * len(total)
        assert sorted(r.position for r in out if r.shard == k) == list(range(n))


def test_wide_cut_table(spark):
    # the generated ranks cross the block size
    counts = spark.createDataFrame([("a", 70_000), ("b", 3)], "s string, n long")
    t = S.cut_table(counts, 70_003, 10)
    assert t.agg(F.sum(F.size("cuts"))).first()[0] == 9
    assert t.count() == 10


def test_empty(make):
    assert S.shard(make([])).count() == 0


def test_columns_with_the_names_of_its_own(make, duck):
    df = make([r for r in corpus(200) if r[0] is not None and r[0] != 6])
    for c in ("width", "n", "s"):
        df = df.withColumn(c, F.lit("kept"))
    out = S.shard(df.withColumn("Shard", F.lit(1)).withColumn("position", F.lit(2)), rows_per_shard=9, bucket_rows=4)
    assert out.columns == [*df.columns, "shard", "position"]
    assert out.filter("width <> 'kept' or n <> 'kept' or s <> 'kept'").count() == 0
    assert canon(out.drop("width", "n", "s")) == canon(S.shard(df.drop("width", "n", "s"), rows_per_shard=9, bucket_rows=4))


def test_ids_that_are_strings_and_repeated_rows(make):
    rows = corpus(60) * 2
    out = S.shard(make(rows).withColumn("doc_id", F.col("doc_id").cast("string")), rows_per_shard=10).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((None if r[0] is None else str(r[0]), r[1]) for r in rows)
    assert sorted((r.shard, r.position) for r in out) == sorted((s, p) for s in range(max(r.shard for r in out) + 1) for p in range(sum(r.shard == s for r in out)))
