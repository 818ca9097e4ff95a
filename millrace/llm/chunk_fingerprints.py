"""Document fingerprints: content-defined chunking and weighted containment.

A text is normalised (lower case, white space as single blanks) and cut where a gear rolling hash over its last ``WINDOW``
bytes has zero top bits. Chunking is normalised: before the average size one more bit must be zero, after it one less, with a
least and a greatest size, so chunk sizes stay close to the average and an insertion moves only the cuts next to it. Chunks
of about 32 bytes, a few words, leave a near copy most of its chunks when one word in 20 or 30 is another. A document's
fingerprint is the set of its chunks' 64-bit digests: 57 bits of hash and, in the low 7, the chunk's length less 1, so that
lengths needn't be sent beside them. The containment of A in B is the length of A's chunks that B has too, over the length of
all of A's chunks.

The result is one row a document: its class (the documents with the same fingerprint, named by their smallest id) and their
number, how many other classes contain it to at least ``threshold``, and the one that does so most (ties: the smallest id).

Plan, exact at every size:

1. Classes are found from (id, fingerprint hash) rows. All further work is on classes, so thousands of copies count once.
2. Digests are brought together in cells, packed arrays of a few thousand, to find those that two classes or more have. What
   comes out is the shared part of each class's set, as words: 6 bits of rank by number of holders, then 50 bits of hash and
   the length, so that sorted words are sorted by rarity. A digest that more than ``common`` classes have is common; one that
   is so within a few thousand documents already doesn't go to its cell at all, so a passage that a third of all documents
   hold doesn't meet in one task.
3. Pairs by rare digests (prefix filtering): if A is contained in B to the threshold and they share a rare digest, they share
   one among the first that make up just over 1 - threshold of A. A rare digest has ``common`` holders at most. A pair is
   compared once for both directions, and of its two sets that of the shorter document is sent to the other.
4. Pairs by common digests alone are never listed by document. Documents with equal sets of common digests are alike to
   them, so sets are joined with sets, in the same way and in blocks, and documents take the number of a set's holders
   from there. The table of sets is broadcast while it has at most ``broadcast_digests``, else joined.

Chunks count as equal if hash and length are: over some 10^9 different chunks, about 30 GB, fewer than one false pair is to
be expected of digests, and fewer of words, as only shared digests become words (computed, not measured).

The shuffle files of each step are removed as soon as its table is written, so that steps don't add up on disk.

Cases: NULL and blank texts have no chunks; they have no class and no containers. Documents without id can't be named and are
left out. Each row counts by itself, so an id with two texts has a row for each. Texts shorter than the least size are one
chunk. An empty table gives an empty table. Other columns are not used. The id is an integer, or a string that is one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._shared import batches, written

THRESHOLD, COMMON, BLOCK, BROADCAST_DIGESTS = 0.4, 64, 512, 4_000_000
#: Of a document's chunks: least and greatest size, bits of the average one, and the bytes that decide a cut (at most the least size).
CHUNK_LEAST, CHUNK_BITS, CHUNK_MOST, WINDOW = 8, 5, 128, 8
#: Digests that a map task packs at a time, and those that a cell is to have in all.
PACKED, CELL = 400_000, 1_000_000
#: The low bits of digests and words, which hold the length less 1; of a word, the bits of hash and length together, and the least common one.
LENGTH = CHUNK_MOST - 1
BODY = 57
HOT = 63 << BODY
GEAR = np.random.default_rng(43).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalise(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 32 bytes, each shifted by its distance."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(strict: list[int], loose: list[int], a: int, z: int, least: int = CHUNK_LEAST, average: int = 1 << CHUNK_BITS, most: int = CHUNK_MOST) -> list[int]:
    """Ends of the chunks of bytes a to z; strict and loose are the places after which the hash allows a cut."""
    out, s = [], a
    while z - s > least:
        i = bisect_left(strict, s + least)
        p = strict[i] if i < len(strict) else z
        if p >= s + average:
            i = bisect_left(loose, s + average)
            p = min(loose[i] if i < len(loose) else z, s + most)
        if p >= z:
            break
        out.append(p)
        s = p
    out.append(z)
    return out


def chunk_sets(texts: list[str | None]) -> list[dict[int, int]]:
    """Digest to length for each text."""
    datas = [normalise(t) if t else b"" for t in texts]
    joined = b"".join(datas)
    if not joined:
        return [{} for _ in texts]
    h = gear_hashes(np.frombuffer(joined, np.uint8)) << np.uint32(32 - WINDOW)  # the low bits have the last bytes only
    loose = np.flatnonzero(h < np.uint32(1 << (32 - CHUNK_BITS + 1))) + 1
    strict = loose[h[loose - 1] < np.uint32(1 << (32 - CHUNK_BITS - 1))].tolist()
    loose, out, at = loose.tolist(), [], 0
    for d in datas:
        found: dict[int, int] = {}
        if d:
            z, i, j = at + len(d), bisect_left(loose, at + CHUNK_LEAST), bisect_left(strict, at + CHUNK_LEAST)
            own_l, own_s = loose[i : bisect_left(loose, z)], strict[j : bisect_left(strict, z)]
            s = at
            for e in cuts(own_s, own_l, at, z):
                found[(xxhash.xxh3_64_intdigest(joined[s:e]) & ~LENGTH | e - s - 1) - (1 << 63)] = e - s
                s = e
            at = z
        out.append(found)
    return out


def words(d: np.ndarray, holders: np.ndarray, common: int) -> np.ndarray:
    """Shared digests as words that sort by number of holders; those from ``HOT`` on are common."""
    rank = np.where(holders > common, 63, np.minimum(holders - 2, 62))
    return rank.astype(np.int64) << BODY | d & ((1 << BODY) - 1)


def lengths(d: np.ndarray) -> np.ndarray:
    return (d & LENGTH) + 1


def needed(total: int, threshold: float) -> int:
    """The length that a container must share with a document of this one."""
    return max(1, ceil(total * threshold - 1e-9))


def _class_hash(d: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(d.tobytes()) - (1 << 63)


def _class_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, 4 << 20, column=1):
        rows: tuple[list, ...] = ([], [], [], [])
        for i, s in zip(b.column(0).to_pylist(), chunk_sets(b.column(1).to_pylist())):
            if i is not None:
                d = np.array(sorted(s), np.int64)
                for o, v in zip(rows, (i, _class_hash(d) if s else None, sum(s.values()), len(s))):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in rows], ["i", "fp", "total", "n"])


def _packer(cells: int, common: int):
    """(id, text) to cells: digests document by document, with each document's class and number of digests; ``marks``
    are digests that are common already here. Those of a cell >= ``cells`` are all common."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            fps = np.fromiter(held, np.int64, len(held))
            d = np.concatenate([*held.values()])
            row = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
            kinds, inverse, times = np.unique(d, return_inverse=True, return_counts=True)
            here = np.minimum((kinds.view(np.uint64) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32), np.uint64(cells - 1)).astype(np.int64)
            much = times > common
            cell = np.where(much[inverse], cells + row % cells, here[inverse])
            out: tuple[list, ...] = ([], [], [], [], [])
            order = np.argsort(cell, kind="stable")  # stays document by document within a cell
            bounds = np.flatnonzero(np.diff(cell[order], prepend=-1))
            marked: dict[int, np.ndarray] = {int(c): kinds[much & (here == c)] for c in np.unique(here[much])}
            for a, z in zip(bounds, [*bounds[1:], len(order)]):
                at = order[a:z]
                c = int(cell[at[0]])
                first = np.flatnonzero(np.diff(row[at], prepend=-1))
                who = row[at][first]
                marks = marked.pop(c, kinds[:0])
                for o, v in zip(out, (c, d[at], fps[who], np.diff([*first, len(at)]).astype(np.int32), marks)):
                    o.append(v if isinstance(v, int) else v.tobytes())
            for c, marks in marked.items():
                for o, v in zip(out, (c, b"", b"", b"", marks.tobytes())):
                    o.append(v)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])], ["cell", "d", "fp", "k", "marks"])

        for b in batches(it, 4 << 20, column=1):
            for i, s in zip(b.column(0).to_pylist(), chunk_sets(b.column(1).to_pylist())):
                if s and i is not None:
                    d = np.array(sorted(s), np.int64)
                    fp = _class_hash(d)
                    if fp not in held:
                        held[fp] = d
                        size += len(d)
            if size >= PACKED:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _sharer(cells: int, common: int):
    """All of one cell to (fp, words of its digests that two classes or more have)."""

    def run(t: pa.Table) -> pa.Table:
        c = t.column("cell")[0].as_py()
        joined = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in t.column(name)), kind)
        d, k, marks = joined("d", np.int64), joined("k", np.int32), joined("marks", np.int64)
        fp = np.repeat(joined("fp", np.int64), k)
        order = np.lexsort((fp, d))
        d, fp = d[order], fp[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (fp[1:] != fp[:-1])
        d, fp = d[new], fp[new]
        start = np.flatnonzero(np.diff(d, prepend=d[:1] ^ 1))
        times = np.diff([*start, len(d)])
        holders = np.repeat(times, times)
        if c >= cells:
            holders[:] = common + 1
        elif len(marks):
            holders[np.isin(d, marks)] = common + 1
        keep = holders > 1
        w, fp = words(d[keep], holders[keep], common), fp[keep]
        order = np.argsort(fp, kind="stable")
        w, fp = w[order], fp[order]
        start = np.flatnonzero(np.diff(fp, prepend=fp[:1] ^ 1))
        return pa.table({"fp": fp[start], "ws": pa.ListArray.from_arrays(pa.array([*start, len(fp)], pa.int32()), pa.array(w))})

    return run


def _postings_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, need, words) to a row a rare digest: (word, id, need, left: length from here on)."""
    for b in it:
        if not b.num_rows:
            continue
        i, need = (b.column(k).to_numpy() for k in range(2))
        size = np.diff(b.column(2).offsets.to_numpy())
        d = b.column(2).flatten().to_numpy()
        n = lengths(d)
        end = np.cumsum(size)
        through = np.cumsum(n)
        left = np.repeat(through[end - 1], size) - through + n
        keep = d < HOT
        yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(np.repeat(i, size)[keep]), pa.array(np.repeat(need, size)[keep]), pa.array(left[keep].astype(np.int32))], ["d", "i", "need", "left"])


def _pairs_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by digest to the candidates (a, b), each once a batch and in one direction: a needs no more than b."""
    rest: list[pa.RecordBatch] = []

    def of(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        d, i, need, left = (t.column(k).to_numpy() for k in range(4))
        start = np.flatnonzero(np.diff(d, prepend=d[:1] ^ 1))
        size = np.diff([*start, len(d)])
        own = np.flatnonzero(left >= need)  # a's prefix
        times = np.repeat(size, size)[own]
        a = np.repeat(own, times)
        b = np.repeat(np.repeat(start, size)[own], times) + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        # at the first digest that the two share, what the container has from there on must be enough
        ok = (i[a] != i[b]) & (left[b] >= need[a])
        a, b = a[ok], b[ok]
        turn = (need[a] > need[b]) | ((need[a] == need[b]) & (i[a] > i[b]))
        a, b = i[np.where(turn, b, a)], i[np.where(turn, a, b)]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    for x in it:
        if not x.num_rows:
            continue
        d = x.column(0).to_numpy()
        cut = int(np.flatnonzero(np.diff(d, prepend=d[:1] ^ 1))[-1])  # the last digest may go on in the next batch
        if cut:
            yield of([*rest, x.slice(0, cut)])
            rest = []
        elif rest and rest[-1].column(0)[-1].as_py() != int(d[0]):
            yield of(rest)
            rest = []
        rest.append(x.slice(cut))
    if rest:
        yield of(rest)


def _overlap_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(need and words of a, words of b, others) to (others, shared length, that of common digests) where a needs no more
    than they share."""
    for x in it:
        if not x.num_rows:
            continue
        da, db = x.column(1), x.column(2)
        sizes = [np.diff(c.offsets.to_numpy()) for c in (da, db)]
        row, other = (np.repeat(np.arange(x.num_rows), k) for k in sizes)
        own = da.flatten().to_numpy()
        kinds, code = np.unique(np.concatenate([own, db.flatten().to_numpy()]), return_inverse=True)
        n = lengths(own) * np.isin(row * len(kinds) + code[: len(row)], other * len(kinds) + code[len(row) :])
        shared, common = (np.bincount(row, w, x.num_rows).astype(np.int32) for w in (n, n * (own >= HOT)))
        keep = pa.array(shared >= x.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*x.columns[3:], pa.array(shared), pa.array(common))], [*x.schema.names[3:], "shared", "common"])


def _step(df: DataFrame, label: str) -> DataFrame:
    """``written``, and df's shuffle files are removed with that: nothing will read them again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df, label)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def shared_sets(slim: DataFrame, heads: DataFrame, length: int, threshold: float, common: int) -> DataFrame:
    """(k: number of the class, i: its smallest id, need, ds, hid): the words of what each class shares with others, rarest
    first; hid tells sets of common digests apart."""
    cells = max(16, -(-length // ((1 << CHUNK_BITS) * CELL)))
    packed = slim.mapInArrow(_packer(cells, common), "cell int, d binary, fp binary, k binary, marks binary")
    posts = packed.groupBy("cell").applyInArrow(_sharer(cells, common), "fp long, ws array<long>")
    sets = posts.groupBy("fp").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ds"))
    need = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(threshold)) - F.lit(1e-9))).cast("int")
    often = F.filter("ds", lambda d: d >= F.lit(HOT))
    hid = F.when(F.size(often) > 0, F.xxhash64(often))
    sets = sets.join(heads.select("fp", "i", "k", "total"), "fp").select("k", "i", need.alias("need"), "ds", hid.alias("hid"))
    return _step(sets, "sets")


def by_rare(sets: DataFrame) -> DataFrame:
    """(k, shared, other, extra) for pairs that share a rare digest; other: (id, k) of the container, extra: 1 where the
    pair's common digests alone don't make it one."""
    own = sets.filter(F.col("ds")[0] < F.lit(HOT))
    post = own.select("k", "need", "ds").mapInArrow(_postings_pass, "d long, k long, need int, left int")
    pairs = post.repartition("d").sortWithinPartitions("d").mapInArrow(_pairs_pass, "a long, b long").repartition("a").distinct()
    a, b = (own.select(F.col("k").alias(x), F.col("i").alias(f"i{x}"), F.col("need").alias(f"n{x}"), F.col("ds").alias(f"d{x}")) for x in "ab")
    found = pairs.join(a, "a").join(b, "b").select("na", "da", "db", "a", "b", "ia", "ib", F.col("na").alias("least"), "nb")
    found = found.mapInArrow(_overlap_pass, "a long, b long, ia long, ib long, least int, nb int, shared int, common int")
    one = lambda k, need, i, other: F.struct(F.col(k).alias("k"), F.col(need).alias("need"), F.struct(F.col(i).alias("i"), F.col(other).alias("k")).alias("other"))
    found = found.select("shared", "common", F.explode(F.array(one("a", "least", "ib", "b"), one("b", "nb", "ia", "a"))).alias("x")).filter("shared >= x.need")
    return _step(found.select("x.k", "shared", "x.other", F.when(F.col("common") < F.col("x.need"), 1).otherwise(0).cast("long").alias("extra")), "rare")


def by_common(sets: DataFrame, block: int, broadcast_digests: int) -> DataFrame:
    """The same columns for each length of common digests that a class shares with others: extra is the number of classes
    that share it, other the first of them."""
    hot = sets.filter("hid is not null").select("k", F.struct("i", "k").alias("me"), "need", "hid", F.filter("ds", lambda d: d >= F.lit(HOT)).alias("ds"))
    hot = hot.withColumn("all", F.expr(f"aggregate(ds, 0, (x, y) -> x + cast(y & {LENGTH} as int) + 1)"))
    asks = F.col("all") >= F.col("need")
    kinds = hot.groupBy("hid").agg(
        F.count("*").alias("holders"), F.min("me").alias("one"), F.min(F.when(asks, F.col("need"))).alias("least"), F.first("ds").alias("ds"), F.first("all").alias("all")
    )
    kinds = _step(kinds.withColumn("kind", F.monotonically_increasing_id()), "common")
    few = kinds.agg(F.coalesce(F.sum(F.size("ds")), F.lit(0))).first()[0] <= broadcast_digests
    hint = F.broadcast if few else (lambda x: x)
    # candidates: sets that share one of the digests which make up all but the needed length, the digests of few sets first
    posts = kinds.select("kind", "least", F.explode("ds").alias("d")).withColumn("len", F.expr(f"(d & {LENGTH}) + 1"))
    posts = posts.join(posts.groupBy("d").agg(F.count("*").alias("n")), "d")
    after = Window.partitionBy("kind").orderBy("n", "d").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # a pair whose digest before this one is the same meets there already
    posts = posts.withColumn("last", F.lag("d").over(Window.partitionBy("kind").orderBy("n", "d")))
    posts = _step(posts.withColumn("left", F.sum("len").over(after).cast("int")).withColumn("blocks", F.expr(f"cast((n - 1) div {block} as int)")), "common-postings")
    a = posts.filter("left >= least").select("d", F.col("kind").alias("a"), "least", F.col("last").alias("la"), F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("s"))
    b = posts.select("d", F.col("kind").alias("b"), "left", F.col("last").alias("lb"), F.pmod(F.xxhash64("kind"), F.col("blocks") + 1).cast("int").alias("s"))
    pairs = a.join(b, ["d", "s"]).filter("a <> b and left >= least and coalesce(la <> lb, true)").select("a", "b").distinct()
    left = kinds.filter("least is not null").select(F.col("kind").alias("a"), F.col("least").alias("need"), F.col("ds").alias("da"))
    right = kinds.select(F.col("kind").alias("b"), F.col("ds").alias("db"))
    pairs = pairs.join(hint(left), "a").join(hint(right), "b").select("need", "da", "db", "a", "b").mapInArrow(_overlap_pass, "a long, b long, shared int, common int")
    others = pairs.join(hint(kinds.select(F.col("kind").alias("b"), "holders", "one")), "b").groupBy("a", "shared").agg(F.sum("holders").alias("extra"), F.min("one").alias("other"))
    # among the set's own holders each one has the others, and the first one asks for another than itself
    two = hot.join(hint(kinds.select("hid", "one")), "hid").filter("me > one").groupBy("hid").agg(F.min("me").alias("two"))
    own = kinds.filter("least is not null").join(two, "hid", "left").select(F.col("kind").alias("a"), F.col("all").alias("shared"), (F.col("holders") - 1).alias("extra"), F.col("one").alias("other"), "two")
    sums = others.withColumn("two", F.lit(None).cast(own.schema["two"].dataType)).unionByName(own)
    docs = hot.filter(asks).select("k", "me", "need", "hid").join(hint(kinds.select("hid", F.col("kind").alias("a"))), "hid")
    found = docs.join(sums, "a").filter("shared >= need")
    return found.select("k", "shared", F.when(F.col("other") == F.col("me"), F.col("two")).otherwise(F.col("other")).alias("other"), "extra")


def containments(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, common: int = COMMON, block: int = BLOCK, broadcast_digests: int = BROADCAST_DIGESTS
) -> DataFrame:
    """(doc_id, class_id, copies, chunks, containers, container_id, containment); see the module."""
    slim = df.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    own = _step(slim.mapInArrow(_class_pass, "i long, fp long, total long, n long"), "classes")  # the texts are cut twice, as that is less than writing the cells
    heads = own.filter("fp is not null").groupBy("fp").agg(F.min("i").alias("i"), F.count("*").alias("copies"), F.first("total").alias("total"))
    heads = _step(heads.withColumn("k", F.monotonically_increasing_id()), "heads")
    length = heads.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    sets = shared_sets(slim, heads, length, threshold, common)
    found = by_rare(sets).unionByName(by_common(sets, block, broadcast_digests))
    best = F.max(F.when(F.col("other").isNotNull(), F.struct("shared", (-F.col("other.i")).alias("id"))))
    found = found.groupBy("k").agg(F.sum("extra").alias("containers"), best.alias("best"))
    heads = heads.join(found, "k", "left").select(
        "fp", F.col("i").alias("class_id"), "copies", F.coalesce("containers", F.lit(0)).cast("long").alias("containers"), (-F.col("best.id")).alias("container_id"), (F.col("best.shared") / F.col("total")).alias("containment")
    )
    rows = own.filter("fp is not null").join(heads, "fp").select(F.col("i").alias("doc_id"), "class_id", "copies", F.col("n").alias("chunks"), "containers", "container_id", "containment")
    none = [F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("copies"), F.col("n").alias("chunks"), F.lit(0).cast("long").alias("containers"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("double").alias("containment")]
    return rows.unionByName(own.filter("fp is null").select(F.col("i").alias("doc_id"), *none))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document with its class, the number of its containers and the closest one."""
    return containments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
