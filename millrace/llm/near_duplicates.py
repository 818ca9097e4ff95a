"""SimHash near-dedup with an LSH forest.

A document's fingerprint has 256 bits: the signs of the sum of its features' hashed ±1 vectors. The features are the distinct
words and pairs of neighbouring words, all of them and all alike, with a mark at either end of the text. Near copies are
documents whose fingerprints differ in at most ``radius`` bits; groups are the connected components of that relation.

Forest: equal fingerprints are joined first. Then each of several tries orders the others by a random choice of bits. A
trie's node is searched whole at the first depth where it is small, or else at the deepest level, so the depth follows the
density around each fingerprint. The deepest level and the number of tries follow from the data: the deeper, the fewer
comparisons, but the more tries are needed for a pair at the full radius to share a prefix in one of them with the target
probability; starting from the depth at which buckets are small, it climbs to shorter prefixes while that lowers the
estimated work at that recall. No candidate is dropped. Every candidate is verified on all bits.

A node that is still large at the deepest level holds fingerprints that are close to each other. There, pivots are compared
first: what lies within the radius of a pivot is linked to it, and two pivots' followings are compared only as far as the
triangle inequality leaves a pair within the radius possible; so thousands of copies take time in proportion. Nodes of more
than ``hot`` fingerprints are split: first into those of the deepest level, and one that is larger by itself into blocks, of
which each pair is a task's. Out of a node come the links of a spanning forest, so a group of thousands of copies gives
thousands of links, not millions of pairs; components are found by alternating large-star and small-star steps, written to
the shared folder each round.

Cases: NULL, empty and wordless texts have no fingerprint and are in no group. Documents without id can't be named and are
in no group. Of rows with the same id and different texts each fingerprint counts, and their id is in the group of all. Ties
(which document stays) go to the smallest id; ``deduplicate`` keeps, of rows with the same id, the one with the smallest text
(NULL last), then the smallest other columns. An empty table gives an empty table. Other columns are not used, or pass
unchanged in ``deduplicate``. The document id is an integer, or a string that is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._shared import batches, discard, fresh, tables, written

BITS, RADIUS, RECALL, SMALL, SPREAD, TRIES, SEED = 256, 48, 0.92, 256, 3, 20, 41
HOT, PIVOTS, MOST_SPLIT = 262_144, 64, 10_000
WORD = re.compile(r"\w+")
_U = np.uint64
_LANES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9], _U)


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed=SEED)
        return h


def _scattered(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: each bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def features(words: np.ndarray) -> np.ndarray:
    """Hashes of the distinct words and pairs of neighbours."""
    h = np.concatenate([[_U(1)], words, [_U(2)]])
    return np.unique(np.concatenate([words, h[:-1] * _LANES[0] + h[1:] * _LANES[1]]))


def simhash(f: np.ndarray) -> np.ndarray:
    """32 bytes: where more than half of the features' 256-bit vectors have a one."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(f), 255):  # up to 255 ones fit in a byte, so eight bytes are added at a time
        bits = np.unpackbits(_scattered(f[a : a + 255, None] + _LANES).view(np.uint8), axis=1)
        ones += bits.view(_U).sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > len(f))


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) bytes, and whether there is a fingerprint; rows of wordless texts are not set."""
    memo = _Words()
    out, ok = np.zeros((len(texts), BITS // 8), np.uint8), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if t and (words := WORD.findall(t.lower())):
            out[i] = simhash(features(np.fromiter(map(memo.__getitem__, words), _U, len(words))))
            ok[i] = True
    return out, ok


def _fingerprint_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, 4 << 20, column=1):
        f, ok = fingerprints(b.column(1).to_pylist())
        ok &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
        words = np.ascontiguousarray(f[ok]).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4))], ["i", "f0", "f1", "f2", "f3"])


def shared_prefix(depth: int, radius: int = RADIUS, bits: int = BITS) -> float:
    """The probability that none of a random choice of depth bits is among radius differing ones."""
    p = 1.0
    for k in range(depth):
        p *= (bits - radius - k) / (bits - k)
    return p


def forest_shape(n: int, radius: int = RADIUS, recall: float = RECALL, small: int = SMALL, least: int = TRIES) -> tuple[int, int]:
    """(deepest level, tries) for n fingerprints: from the depth where buckets are small up, the cheapest that has the
    recall. ``least`` tries are always used, so that up to millions of fingerprints the rows sent grow in proportion."""
    best = None
    for depth in range(min(40, max(1, ceil(log2(max(2, n) / small)) + 2)), 0, -1):
        tries = max(least, ceil(log(1 - recall) / log(1 - shared_prefix(depth, radius))))
        # a row that is sent, sorted and spilled weighs as much as 2000 comparisons
        work = tries * n * (2000 + max(small, n / 2**depth))
        if best is None or work < best[0]:
            best = work, depth, tries
    return best[1:]


def _keys(b: pa.RecordBatch, chosen: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(trie, key) for a batch (i, f0..f3)."""
    f = np.stack([b.column(k).to_numpy() for k in range(1, 5)], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1), axis=1)
    for t, c in enumerate(chosen):
        key = np.zeros(len(f), np.int64)
        for k in c:
            key = (key << 1) | bits[:, k]
        yield t, key


def _chosen(depth: int, count: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.permutation(BITS)[:depth] for _ in range(count)]


def _sizes(chosen: list[np.ndarray]):
    """(i, f0..f3) to (trie, key, n), a row a key of each slice."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t, key in _keys(b, chosen) if b.num_rows else ():
                kinds, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), t, np.int32)), pa.array(kinds), pa.array(n)], ["trie", "key", "n"])

    return run


def _tries(depth: int, top: int, chosen: list[np.ndarray], split: dict[tuple[int, int], int], hot: dict[tuple[int, int], int], seed: int):
    """(i, f0..f3) to a row a trie: (trie, node at the top level, key, i, f0..f3). Nodes in ``split`` come as those of the
    deepest level, numbered from 2^depth; of the keys in ``hot``, which have that many blocks, a row comes once for each
    pair of blocks that its own is in, as nodes numbered below 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a in range(0, b.num_rows, 16_384):
                x = b.slice(a, 16_384)
                for t, key in _keys(x, chosen):
                    node = key >> (depth - top)
                    out = [(node, np.arange(len(key)))]
                    if split or hot:
                        deep = np.isin(node, [k for s, k in split if s == t])
                        node = np.where(deep, key + (1 << depth), node)
                        out = [(node, np.flatnonzero(~np.isin(key, [k for s, k in hot if s == t])))]
                        for n, ((s, k), blocks) in enumerate(sorted(hot.items())):
                            at = np.flatnonzero(key == k) if s == t else ()
                            if len(at):
                                mine = _scattered(x.column(0).to_numpy()[at].view(_U) + _U(seed)) % _U(blocks)
                                for other in range(blocks):
                                    low, high = np.minimum(mine, _U(other)).astype(np.int64), np.maximum(mine, _U(other)).astype(np.int64)
                                    out.append((None, at, -1 - ((n * blocks + low) * blocks + high)))
                    for part in out:
                        at = part[1]
                        nodes = part[2] if len(part) == 3 else part[0][at]
                        rows = x.take(pa.array(at)) if len(at) < x.num_rows else x
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(nodes), pa.array(key[at]), *rows.columns], ["trie", "node", "key", "i", "f0", "f1", "f2", "f3"])

    return run


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all of x and all of y, both (n, 4) uint64."""
    d = np.zeros((len(x), len(y)), np.uint16)
    for k in range(4):
        d += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return d


class _Forest:
    """Components of rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while (self.label[x] != x).any():
            x = self.label[x]
        return x

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.root(i), self.root(j)
            apart = ri != rj
            if not apart.any():
                return
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(self.label, np.maximum(ri, rj), np.minimum(ri, rj))

    def compare(self, f: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, block: int) -> None:
        """Links the rows x with the rows y at most radius away."""
        for a in range(0, len(x), block):
            for b in range(0, len(y), block):
                i, j = np.nonzero(distances(f[x[a : a + block]], f[y[b : b + block]]) <= radius)
                self.link(x[a + i], y[b + j])


def links_within(ids: np.ndarray, f: np.ndarray, radius: int, block: int = 1024, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for the components of the fingerprints at most radius apart; f is (n, 4) uint64."""
    n = len(ids)
    found, rest = _Forest(n), np.arange(n)
    groups: list[tuple[int, np.ndarray, np.ndarray]] = []  # pivot, the rows within the radius of it, how far they are
    while len(rest) > 2 * block and len(groups) < pivots:
        p = int(rest[0])
        d = distances(f[p : p + 1], f[rest])[0]
        near = d <= radius
        groups.append((p, rest[near], d[near].astype(int)))
        found.link(rest[near], np.full(int(near.sum()), p))
        rest = rest[~near]
    for g, (p, x, dx) in enumerate(groups):
        for q, y, dy in groups[:g]:
            if found.root(np.array([p]))[0] == found.root(np.array([q]))[0]:
                continue
            gap = int(distances(f[p : p + 1], f[q : q + 1])[0, 0]) - radius
            # a pair within the radius has d(p, x) + d(q, y) >= gap
            u, v = x[dx >= gap - dy.max()], y[dy >= gap - dx.max()]
            found.compare(f, u, v, radius, block)
        far = distances(f[p : p + 1], f[rest])[0].astype(int) - radius if len(rest) else np.zeros(0, int)
        found.compare(f, x[dx >= far.min()] if len(rest) else x[:0], rest[far <= dx.max()], radius, block)
    for a in range(0, len(rest), block):
        found.compare(f, rest[a : a + block], rest[a:], radius, block)
    r = found.root(np.arange(n))
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, r, ids)
    low = low[r]
    member = low != ids
    return ids[member], low[member]


def node_links(key: np.ndarray, ids: np.ndarray, f: np.ndarray, left: int, radius: int, small: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one top node, its rows sorted by key: nodes that are small are searched, others are split by their next
    bit while ``left`` levels are below."""
    todo = [(0, len(key), left)]
    while todo:
        a, b, k = todo.pop()
        if b - a < 2:
            continue
        if b - a <= small or not k:
            yield links_within(ids[a:b], f[a:b], radius)
            continue
        prefix = (key[a] >> k) << k  # what the node's rows share
        mid = a + int(np.searchsorted(key[a:b], prefix | (1 << (k - 1))))
        todo += [(a, mid, k - 1), (mid, b, k - 1)]


def _search(left: int, deepest: int, radius: int, small: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(part)
            node, key, ids = t["node"].to_numpy(), t["key"].to_numpy(), t["i"].to_numpy()
            f = np.stack([t[f"f{k}"].to_numpy() for k in range(4)], axis=1).view(np.uint64)
            trie = t["trie"].to_numpy()
            cut = np.flatnonzero((np.diff(node) != 0) | (np.diff(trie) != 0)) + 1
            edges = [np.zeros((2, 0), np.int64)]
            for a, b in zip([0, *cut], [*cut, len(node)]):
                # nodes that were split are of the deepest level
                edges += [np.stack(e) for e in node_links(key[a:b], ids[a:b], f[a:b], left if 0 <= node[a] < deepest else 0, radius, small)]
            e = np.unique(np.concatenate(edges, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

        for b in it:
            if not b.num_rows:
                continue
            # the last node of a batch may go on in the next one
            trie, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            change = np.flatnonzero((np.diff(node) != 0) | (np.diff(trie) != 0))
            if held:
                last = held[-1]
                if (last.column(0)[-1].as_py(), last.column(1)[-1].as_py()) != (int(trie[0]), int(node[0])):
                    yield flush(held)
                    held = []
            if len(change):
                at = int(change[-1]) + 1
                yield flush([*held, b.slice(0, at)])
                held = [b.slice(at)]
            else:
                held.append(b)
        if held:
            yield flush(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (a, b): every linked node but the smallest of its component, with that one."""
    old = tables()
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mine = tables() - old  # the table of the round before is not read again
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.min("b").over(Window.partitionBy("a")), "a")
        large = both.withColumn("m", low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: link a node's smaller neighbours, and itself, to the smallest
        low = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", low).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old = tables()
        edges = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        discard(x for x in old if x in mine)
        mine = tables() - old
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            return edges
        before = now


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = RECALL, small: int = SMALL, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, same_fingerprint): every document that is a near copy of a smaller id, with its group's smallest."""
    slim = df.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    own = written(slim.mapInArrow(_fingerprint_pass, "i long, f0 long, f1 long, f2 long, f3 long"), "fingerprints")
    bits = ["f0", "f1", "f2", "f3"]
    heads = written(own.groupBy(*bits).agg(F.min("i").alias("i")).select("i", *bits), "heads")
    n = heads.count()
    depth, tries = forest_shape(n, radius, recall, small)
    top, chosen = max(0, depth - SPREAD), _chosen(depth, tries, seed)
    split, much = {}, {}
    if n > hot:  # else no node can be larger
        sizes = heads.mapInArrow(_sizes(chosen), "trie int, key long, n long").groupBy("trie", "key").agg(F.sum("n").alias("n"))
        sizes = written(sizes.withColumn("node", F.shiftright("key", depth - top)), "nodes")
        by_node = sizes.groupBy("trie", "node").agg(F.sum("n").alias("n"))
        while by_node.filter(F.col("n") > hot).count() > MOST_SPLIT:  # the driver names these nodes
            hot *= 2
        split = {(r.trie, r.node): 1 for r in by_node.filter(F.col("n") > hot).select("trie", "node").collect()}
        much = {(r.trie, r.key): -(-r.n * 2 // hot) for r in sizes.filter(F.col("n") > hot).select("trie", "key", "n").collect()}
    rows = heads.mapInArrow(_tries(depth, top, chosen, split, much, seed), "trie int, node long, key long, i long, f0 long, f1 long, f2 long, f3 long")
    rows = rows.repartition("trie", "node").sortWithinPartitions("trie", "node", "key")
    links = components(rows.mapInArrow(_search(depth - top, 1 << depth, radius, small), "a long, b long"))
    member = own.join(heads.select(F.col("i").alias("head"), *bits), bits).select("i", "head").distinct()
    found = member.join(links, F.col("head") == F.col("a"), "left").select("i", F.coalesce("b", "head").alias("keep"), (F.col("b").isNull()).alias("same"))
    found = found.groupBy("i").agg(F.min("keep").alias("keep"), F.min("same").alias("same"))
    return found.filter("i <> keep").select(F.col("i").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("same").alias("same_fingerprint"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df without the near copies; of rows with the same id one stays (see the module), those without id all do."""
    (mark,) = fresh(df, "copy")
    gone = written(near_copies(df, doc_id, text, **how).select(F.col("doc_id").alias(mark)), "copies")
    left = df.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(mark), "left_anti")
    ids = df.select(F.col(f"`{doc_id}`").alias(mark)).filter(F.col(mark).isNotNull()).groupBy(mark).count().filter("count > 1").select(mark)
    ids = written(ids, "repeated")
    if ids.isEmpty():
        return left
    # rows with the same id are ordered by all columns as text, the documents' text first
    order = [F.col(f"`{text}`").asc_nulls_last(), *(F.to_json(F.struct(F.col(f"`{c}`"))).asc() for c in df.columns if c != text)]
    one = left.join(ids, F.col(f"`{doc_id}`") == F.col(mark), "left_semi").withColumn(mark, F.row_number().over(Window.partitionBy(f"`{doc_id}`").orderBy(*order)))
    one = one.filter(F.col(mark) == 1).drop(mark)
    return left.join(ids, F.col(f"`{doc_id}`") == F.col(mark), "left_anti").unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every near copy, with the document that stays in its place."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
