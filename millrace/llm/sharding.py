"""Sharding: proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r among n gets the fraction (r - 1/2) / n; all rows
sorted by fraction (then source) are cut into shards of equal size, so every shard holds each source in proportion, to
within two rows and the source's share of as many rows as there are sources.

Plan: the rank needs no sort of a whole source. The hash is cut into buckets by the source's size, counts of buckets
give offsets, and a bucket is sorted by itself. Where the cuts between shards fall depends on the sources' sizes alone:
the (fraction, source) pairs are generated from those, cut positions are found in them by the same bucket trick, and the
resulting table, one row a shard, is joined to the rows. So rows with their texts move twice: to their bucket, then to
their shard, where they come to lie in order.

Cases: a NULL source is a source of its own. Rows without id are ordered by a hash of their text; repeated rows are ordered
by a hash of all their columns, and equal rows are interchangeable. An empty table gives an empty table. Other columns
pass unchanged; ``shard`` and ``position`` (from 0) are added and replace columns of these names. The document id may be of
any type that casts to a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm._shared import fresh, written

ROWS_PER_SHARD, SEED, BUCKET_ROWS, BROADCAST_ROWS = 2048, 31, 2048, 500_000


def _hash(seed: int, doc_id: str, text: str):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.md5(F.col(f"`{text}`")), F.lit(""))))


def cut_table(counts: DataFrame, total: int, shards: int) -> DataFrame:
    """One row a cell of the unit interval (as many as shards): ``base`` shards begin before it, and ``cuts`` are the
    (fraction, source) pairs in it at which the next ones begin. counts: (s, n) by source."""
    spark = counts.sparkSession
    block = 1 << 16
    ranks = counts.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
    ranks = ranks.withColumn("r", F.explode(F.expr(f"sequence(blk * {block} + 1, least(n, (blk + 1) * {block}))")))
    ranks = ranks.select("s", ((F.col("r") - 0.5) / F.col("n")).alias("f")).withColumn("cell", F.least(F.floor(F.col("f") * shards), F.lit(shards - 1)))
    sizes = ranks.groupBy("cell").count()
    sizes = written(sizes.withColumn("before", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("cell")) - F.col("count")), "cells")
    starts = spark.range(1, shards).select(F.expr(f"id * {total} div {shards}").alias("p"))
    # only cells in which a shard begins are sorted
    # the generated side looks tiny to the planner, so the side of one row a shard is named
    one_a_shard = F.broadcast if shards <= BROADCAST_ROWS else (lambda x: x.hint("merge"))
    at = ranks.join(one_a_shard(sizes), "cell").withColumn("p", F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("f", "s")) - 1)
    cuts = at.join(one_a_shard(starts), "p").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("cuts"))
    cells = spark.range(shards).withColumnRenamed("id", "cell").join(cuts, "cell", "left")
    k = F.coalesce(F.size("cuts"), F.lit(0))
    return cells.withColumn("base", F.coalesce(F.sum(k).over(Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def shard(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """df with ``shard`` and ``position``, clustered by shard and in order within it (see the module)."""
    df = df.drop(*(c for c in df.columns if c.lower() in ("shard", "position")))
    s, h, b, r, f, cell, tie, wide = fresh(df, "src", "h", "b", "r", "f", "cell", "tie", "width")
    src = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit(""))
    hashed = df.select(src.alias("s"), _hash(seed, doc_id, text).alias("h"))
    counts = written(hashed.groupBy("s").agg(F.count("*").alias("n")), "sources")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // rows_per_shard))
    counts = counts.withColumn("width", F.expr(f"shiftleft(1L, cast(60 - greatest(0, ceil(log2(n / {float(bucket_rows)}))) as int))"))
    bucket = lambda h, width="width": F.expr(f"cast(conv(substr({h}, 1, 15), 16, 10) as bigint) div `{width}`")
    offsets = hashed.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "s").groupBy("s", bucket("h").alias("b"), "n", "width").count()
    before = F.sum("count").over(Window.partitionBy("s").orderBy("b")) - F.col("count")
    offsets = written(offsets.select("s", "b", before.alias("offset")), "offsets")
    cells = written(cut_table(counts, total, shards), "cuts")
    plain = [x.name for x in df.schema if not _has_map(x.dataType)]
    rows = df.withColumns({s: src, h: _hash(seed, doc_id, text), tie: F.xxhash64(*(F.col(f"`{x}`") for x in plain))})
    sized = counts.select(F.col("s").alias(s), F.col("n").alias(f"{h}n"), F.col("width").alias(wide))
    rows = rows.join(F.broadcast(sized) if counts.count() <= BROADCAST_ROWS else sized, s).withColumn(b, bucket(f"`{h}`", wide)).drop(wide)
    rank = F.row_number().over(Window.partitionBy(s, b).orderBy(h, tie))
    rows = rows.withColumn(r, rank).join(offsets.select(F.col("s").alias(s), F.col("b").alias(b), F.col("offset").alias(f"{h}o")), [s, b])
    rows = rows.withColumn(f, (F.col(r) + F.col(f"{h}o") - 0.5) / F.col(f"{h}n")).withColumn(cell, F.least(F.floor(F.col(f) * shards), F.lit(shards - 1)))
    rows = rows.join(cells.select(F.col("cell").alias(cell), F.col("cuts").alias(f"{h}cuts"), F.col("base").alias(f"{h}base")), cell)
    passed = F.size(F.filter(F.col(f"{h}cuts"), lambda x: x <= F.struct(F.col(f).alias("f"), F.col(s).alias("s"))))
    rows = rows.withColumn("shard", (F.col(f"{h}base") + F.coalesce(passed, F.lit(0))).cast("long"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(f, s)) - 1
    return rows.withColumn("position", place.cast("long")).select(*(F.col(f"`{x}`") for x in df.columns), "shard", "position")


def _has_map(t: T.DataType) -> bool:
    return isinstance(t, T.MapType) or "map<" in t.simpleString()


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document with its shard and place in it."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH c AS (SELECT *, coalesce('s' || source, '') AS s, md5('{SEED}|' || coalesce(doc_id::VARCHAR, md5(text), '')) AS h FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS f, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, s) - 1 AS p, (total + {ROWS_PER_SHARD} - 1) // {ROWS_PER_SHARD} AS shards FROM r),
k AS (SELECT *, ((p + 1) * shards + total - 1) // total - 1 AS shard FROM p)
SELECT doc_id, text, lang, source, n_chars, shard::BIGINT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY f, s) - 1)::BIGINT AS position FROM k
"""
