"""Quality rules: cross-document line frequency.

Normalised lines are hashed with their host; a line's frequency is the number of distinct documents (by content, so exact
copies count once) of the host that hold it. Lines above the limit of ``min_docs`` documents are removed from all documents
of the host; the limit is the same for hosts of all sizes, unless a ``share`` of the host's documents is given, which then
counts where it is larger. A document is rejected as depleted when nothing but blanks remains, or when less than
``keep_percent`` of its normalised characters remain.

Plan: one Arrow pass gives (host, line hash, content hash), two shuffles of those 24-byte rows give the frequencies, and
a second pass edits each text where it lies, so that no text is shuffled. The flagged hashes are broadcast while there are
at most ``broadcast_keys``; beyond that the lines themselves are joined with them and the texts put together again.

Cases: NULL, empty and blank texts are depleted and go. A NULL host is a host of its own. Repeated rows count once and
are all edited alike. Blank lines are neither counted nor removed. An empty table gives an empty table. Other columns,
whatever their names, pass unchanged; a ``n_chars`` column is set to the edited text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import batches, bounded_array, fresh, written

MIN_DOCS, KEEP_PERCENT, BROADCAST_KEYS = 5, 30, 2_000_000


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def host_seed(host: str | None) -> int:
    return 7 if host is None else xxhash.xxh3_64_intdigest(host.encode(), seed=42)


def normal(line: str) -> str:
    """Lower case, with runs of white space as one blank."""
    return " ".join(line.lower().split())


def line_key(seed: int, norm: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass"), seed=seed))


def line_keys(host: str | None, norms: list[str]) -> list[int]:
    seed = host_seed(host)
    return [line_key(seed, n) if n else 0 for n in norms]


def _count_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, host) to (host, key, content); key NULL stands for the document itself."""
    for b in batches(it):
        hosts, keys, contents = [], [], []
        for text, host in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text is None:
                continue
            content, seed = _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))), host_seed(host)
            found = {line_key(seed, n) for n in map(normal, text.split("\n")) if n}
            hosts += [host] * (len(found) + 1)
            keys += [None, *found]
            contents += [content] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(contents, pa.int64())], ["h", "k", "c"]
        )


def flagged_lines(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = 0.0) -> DataFrame:
    """The keys (one BIGINT column ``k``, host and line hashed together) of the lines above their host's limit."""
    seen = df.select(F.col(text).alias("t"), F.col(host).cast("string").alias("h")).mapInArrow(_count_pass, "h string, k long, c long")
    counts = seen.distinct().groupBy("h", "k").agg(F.count("*").alias("n"))
    counts = written(counts.filter(F.col("k").isNull() | (F.col("n") > min_docs)), "lines")
    hosts = counts.filter("k IS NULL").select(F.col("h").alias("hh"), F.col("n").alias("docs"))
    return (
        counts.filter("k IS NOT NULL")
        .join(hosts, F.col("h").eqNullSafe(F.col("hh")))
        .filter(F.col("n") > F.ceil(F.col("docs") * F.lit(share)))
        .select("k")
        .distinct()
    )


def _edit(text: str | None, host: str | None, bad, keep_percent: int) -> tuple[str | None, int]:
    """The text without flagged lines, and how many went; (None, _) if it is depleted."""
    if text is None:
        return None, 0
    lines = text.split("\n")
    norms = [normal(x) for x in lines]
    total = sum(map(len, norms))
    if not total:
        return None, 0
    gone = [bool(n) and k in bad for n, k in zip(norms, line_keys(host, norms))]
    if not any(gone):
        return text, 0
    left = sum(len(n) for n, g in zip(norms, gone) if not g)
    if not left or left * 100 < total * keep_percent:
        return None, sum(gone)
    return "\n".join(x for x, g in zip(lines, gone) if not g), sum(gone)


def _editor(found, keep_percent: int, at: int, host_at: int, n_at: int | None, removed: bool):
    """mapInArrow body over all columns: found is a broadcast sorted array of keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flagged = found.value
        for b in batches(it, column=at):
            rows = list(zip(b.column(at).to_pylist(), b.column(host_at).cast(pa.string()).to_pylist()))
            # one search in the sorted array for a batch's keys, instead of a set of all flagged ones in each task
            keys = np.array([k for t, h in rows if t for k in line_keys(h, list(map(normal, t.split("\n"))))], np.int64)
            place = np.minimum(np.searchsorted(flagged, keys), len(flagged) - 1) if len(flagged) else None
            bad = set(keys[flagged[place] == keys].tolist()) if place is not None else set()
            done = [_edit(t, h, bad, keep_percent) for t, h in rows]
            keep = np.array([t is not None for t, _ in done], dtype=bool)
            cols = [*b.columns]
            texts = [t for t, _ in done]
            cols[at] = pa.array(texts, pa.string())
            if n_at is not None:
                cols[n_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(n_at).type)
            names = list(b.schema.names)
            if removed:
                cols.append(pa.array([n for _, n in done], pa.int64()))
                names.append("lines_removed")
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in cols], names)

    return run


def drop_frequent_lines(
    df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = 0.0,
    keep_percent: int = KEEP_PERCENT, broadcast_keys: int = BROADCAST_KEYS, length: str = "n_chars", with_removed: bool = False,
) -> DataFrame:
    """df's rows that are not depleted, with the flagged lines removed (see the module); ``with_removed`` adds
    ``lines_removed``, which replaces a column of that name."""
    if with_removed:
        df = df.drop(*(c for c in df.columns if c.lower() == "lines_removed"))
    flagged = written(flagged_lines(df, text, host, min_docs, share), "flagged")
    keys = bounded_array(flagged, broadcast_keys)
    at, host_at = df.columns.index(text), df.columns.index(host)
    n_at = df.columns.index(length) if length in df.columns else None
    if keys is None:
        return _joined(df, flagged, text, host, keep_percent, n_at, with_removed)
    schema = df.schema
    if with_removed:
        schema = type(schema)(list(schema)).add("lines_removed", "long")
    found = df.sparkSession.sparkContext.broadcast(keys)
    return df.mapInArrow(_editor(found, keep_percent, at, host_at, n_at, with_removed), schema)


def _lines_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, host, row) to (row, pos, line, len, key)."""
    for b in batches(it):
        out: tuple[list, ...] = ([], [], [], [], [])
        for t, h, r in zip(*(b.column(i).to_pylist() for i in range(3))):
            seed = host_seed(h)
            for i, x in enumerate((t or "").split("\n")):
                n = normal(x)
                for o, v in zip(out, (r, i, x, len(n), line_key(seed, n) if n else None)):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["r", "pos", "line", "len", "k"])


def _joined(df: DataFrame, flagged: DataFrame, text: str, host: str, keep_percent: int, n_at: int | None, with_removed: bool) -> DataFrame:
    """The same edit by joins, for any number of flagged lines. Rows get ids in a written copy, which a retry can't change."""
    (row,) = fresh(df, "row")
    docs = written(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    lines = docs.select(F.col(text).alias("t"), F.col(host).cast("string").alias("h"), row).mapInArrow(_lines_of, "r long, pos long, line string, len long, k long")
    marked = lines.join(flagged.select(F.col("k").alias("bad")), F.col("k") == F.col("bad"), "left")
    clean = F.col("bad").isNull()
    edited = marked.groupBy("r").agg(
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(clean, F.struct("pos", "line")))), lambda x: x["line"])).alias("t2"),
        F.count("bad").alias("gone"), F.sum("len").alias("total"), F.sum(F.when(clean, F.col("len")).otherwise(0)).alias("left"),
    ).filter((F.col("left") > 0) & (F.col("left") * 100 >= F.col("total") * keep_percent))
    out = docs.join(edited, docs[row] == edited["r"])
    cols = [docs[f"`{c}`"] if c != text else F.col("t2").alias(text) for c in df.columns]
    if n_at is not None:
        cols[n_at] = F.length("t2").cast(df.schema[n_at].dataType).alias(df.columns[n_at])
    return out.select(*cols, *([F.col("gone").alias("lines_removed")] if with_removed else []))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document that is kept, with its edited text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_frequent_lines(docs, with_removed=True)


ORACLE = f"""
WITH docs AS (SELECT * FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
n AS (SELECT *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS norm FROM l),
df AS (SELECT source, norm, count(DISTINCT text) AS n FROM n WHERE norm <> '' GROUP BY source, norm),
bad AS (SELECT df.source, df.norm FROM df WHERE df.n > {MIN_DOCS}),
m AS (SELECT n.*, bad.norm IS NOT NULL AS gone FROM n LEFT JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND n.norm = bad.norm),
e AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
      count(*) FILTER (WHERE gone) AS lines_removed, sum(length(norm)) AS total,
      coalesce(sum(length(norm)) FILTER (WHERE NOT gone), 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, e.text, d.lang, d.source, length(e.text)::BIGINT AS n_chars, e.lines_removed
FROM documents d JOIN e USING (doc_id) WHERE e.kept > 0 AND e.kept * 100 >= e.total * {KEEP_PERCENT}
"""
