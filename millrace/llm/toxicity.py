"""Toxicity: a counterfactual-regularised classifier.

Features of a text are its distinct words and the words' first four and five letters (inflected forms share these).
A sparse logistic model is fitted on the driver on at most ``max_labelled`` labelled rows, chosen by a seeded hash of
their id. Its features are all that occur in enough toxic rows of these and ``lift`` times as often there as in the others
(four times that for stems); of a word, the one with the largest lift counts. A document's score is that of its worst
sentence, in the fit as in use, and no less than that of a sentence without features, so long clean texts don't add up; a
text without any feature is never rejected. For every
labelled sentence with an identity term, counterfactuals swap the term for each other term of its group; the loss adds
``fairness`` times the mean squared change of the score over those pairs, so that no term of a group can raise a score that
its siblings don't raise. A document is rejected from ``threshold`` on, which is fitted on the same rows: midway between the
clean and toxic scores, 0.5 where they can't be parted.

Plan: ids are hashed and limited on the labels alone, the bounded sample is broadcast into one scan of the documents, its
texts are written once and counted there; scoring is one Arrow pass with the broadcast model, no shuffle.

Cases: labels that are NULL or of unknown documents are unused; documents labelled twice, and rows that repeat, count each for
themselves. Without toxic or without clean rows nothing is rejected. NULL and empty texts score 0 and are kept, and so does
an empty table. Very long texts are scored whole, sentence by sentence. Equal texts score alike, whatever their rows. Other
columns pass unchanged; a column with the name of the score is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import batches, fresh, written

MAX_LABELLED, LIFT, FAIRNESS, L2, SEED = 20_000, 8.0, 10.0, 1e-5, 17
IDENTITY = (
    "women men girls boys", "woman man girl boy", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab", "gay straight lesbian bisexual transgender", "immigrants refugees foreigners natives", "disabled blind deaf elderly young",
    "frauen männer mädchen jungen", "muslime christen juden buddhisten", "femmes hommes filles garçons", "musulmans chrétiens juifs bouddhistes",
    "mujeres hombres niñas niños", "musulmanes cristianos judíos budistas",
)
WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")


def _h(s: str, prefix: bool = False) -> int:
    """63 bits; the last one tells prefixes from words."""
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) >> 2 << 1 | prefix


def word_features(w: str) -> tuple[int, ...]:
    """The first four and five letters of longer words, and the word's own feature."""
    return (_h(w),) if len(w) < 5 else (_h(f"4^{w[:4]}", True), _h(f"5^{w[:5]}", True), _h(w))


def known_feature(w: str, lifts: dict[int, float]) -> int | None:
    """Of the word's known features the one with the largest lift, the most general one in a tie: new endings of a stem
    that only toxic rows have then weigh as much as old ones."""
    best, top = None, 0.0
    for f in word_features(w):
        lift = lifts.get(f, 0.0)
        if lift > top:
            best, top = f, lift
    return best


def text_features(text: str) -> set[int]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def swaps(groups: tuple[str, ...]) -> dict[str, list[str]]:
    """Each identity term to the other terms of its group."""
    out: dict[str, list[str]] = {}
    for g in groups:
        for w in g.split():
            out.setdefault(w, []).extend(x for x in g.split() if x != w)
    return out


def _features_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (toxic, features)."""
    for b in batches(it, 4 << 20):
        ts, ys = b.column(0).to_pylist(), b.column(1)
        fs = [list(text_features(t or "")) for t in ts]
        yield pa.RecordBatch.from_arrays([ys.cast(pa.int32()), pa.array(fs, pa.list_(pa.int64()))], ["y", "f"])


def _rows_pass(chosen, lifts, groups: tuple[str, ...]):
    """(text, toxic) to rows of sentences: (row, y, cf, plus, minus); cf rows are counterfactual pairs. Only chosen
    features are kept, so a sentence without any gives no row; each document gives one row at least."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, other = chosen.value, lifts.value, swaps(groups)
        for b in batches(it, 4 << 20):
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, (t, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                found = [(row, y, False, [], [])]
                for s in SENTENCE.split((t or "").lower()):
                    ws = set(WORD.findall(s))
                    f = {index[x] for w in ws if (x := known_feature(w, known)) is not None}
                    if f:
                        found.append((row, y, False, sorted(f), []))
                    for w in ws & other.keys():
                        rest = {known_feature(v, known) for v in ws - {w}} | {None}
                        for v in other[w]:
                            a, z = {known_feature(v, known)} - rest, {known_feature(w, known)} - rest
                            plus, minus = [index[x] for x in a - z], [index[x] for x in z - a]
                            if plus or minus:
                                found.append((row, y, True, plus, minus))
                for r in found:
                    for o, v in zip(out, r):
                        o.append(v)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int32(), pa.bool_(), ints, ints))], ["row", "y", "cf", "plus", "minus"])

    return run


def _csr(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and column numbers of the entries."""
    n = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), n), np.fromiter((i for x in lists for i in x), np.int64, int(n.sum()))


def fit_logistic(x: list, y: np.ndarray, plus: list, minus: list, n: int, fairness: float = FAIRNESS, l2: float = L2, rounds: int = 400, owner: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Full-batch Adam on mean log loss (classes weighted alike) + l2 |w|² + fairness · mean over pairs of (w·Δ)². x are
    sentences, owner their documents (rising; each its own by default), y is by document: its worst sentence counts."""
    (r, c), (pr, pc), (mr, mc) = (_csr(k) for k in (x, plus, minus))
    owner = np.arange(len(x)) if owner is None else owner
    start, at = np.flatnonzero(np.diff(owner, prepend=-1)), np.arange(len(x))
    w, b = np.full(n, 0.1), 0.0  # at first the sentence with the most features is the worst
    sw = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v, pairs = np.zeros(n + 1), np.zeros(n + 1), max(1, len(plus))
    for t in range(1, rounds + 1):
        z = np.bincount(r, w[c], len(x)) + b
        worst = np.minimum.reduceat(np.where(z == np.maximum.reduceat(z, start)[owner], at, len(x)), start)
        g = np.zeros(len(x))
        g[worst] = sw * (1 / (1 + np.exp(-np.clip(z[worst], -30, 30))) - y)
        gw = np.bincount(c, g[r], n) + 2 * l2 * w
        if plus:
            d = np.bincount(pr, w[pc], len(plus)) - np.bincount(mr, w[mc], len(plus))
            gw += 2 * fairness / pairs * (np.bincount(pc, d[pr], n) - np.bincount(mc, d[mr], n))
        full = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, lift: float = LIFT, fairness: float = FAIRNESS,
        groups: tuple[str, ...] = IDENTITY, seed: int = SEED) -> dict:
    """The model: {"weights": {feature: weight}, "bias", "threshold"}; ``labels`` has doc_id and toxic (0/1)."""
    sample = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)")
    sample = sample.orderBy(F.xxhash64("i", F.lit(seed)), "i", "y").limit(max_labelled)
    texts = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).join(F.broadcast(sample), F.col("d") == F.col("i"))
    texts = written(texts.select("t", "y"), "labelled")
    n = dict(texts.groupBy("y").count().collect())
    pos, neg = n.get(1, 0), n.get(0, 0)
    none = {"weights": {}, "lifts": {}, "bias": -30.0, "threshold": 0.5}
    if not pos or not neg:
        return none
    least = max(3, round(0.002 * pos))
    feats = texts.mapInArrow(_features_pass, "y int, f array<long>")
    toxic = feats.filter("y = 1").select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("p")).filter(F.col("p") >= least)
    clean = feats.filter("y = 0").select(F.explode("f").alias("f")).join(F.broadcast(toxic.select("f")), "f").groupBy("f").agg(F.count("*").alias("q"))
    score = (F.col("p") + 0.1) / pos / ((F.coalesce("q", F.lit(0)) + 0.5) / neg)
    # all of them: what the labelled rows hold bounds their number
    top = toxic.join(clean, "f", "left").filter(score >= F.when(F.col("f").bitwiseAND(1) == 1, 4 * lift).otherwise(lift)).orderBy(F.col("p").desc(), score.desc(), "f")
    lifts = {r[0]: r[1] for r in top.select("f", score).collect()}
    index = {f: i for i, f in enumerate(lifts)}
    if not index:
        return none
    share = docs.sparkSession.sparkContext.broadcast
    rows = texts.repartition(max(1, -(-(pos + neg) // 512))).mapInArrow(_rows_pass(share(index), share(lifts), groups), "row long, y int, cf boolean, plus array<int>, minus array<int>")
    got = rows.toArrow().combine_chunks()
    cf, labels_ = got["cf"].to_numpy(), got["y"].to_numpy()
    plus, minus = (got[k].to_pylist() for k in ("plus", "minus"))
    # a document's rows follow each other: a new one starts with the row that has no features
    size = np.fromiter(map(len, plus), np.int64, len(plus))
    first = ~cf & (size == 0)
    doc = np.cumsum(first) - 1
    own = np.flatnonzero(~cf)  # sentences with features, and one without any for each document
    y, owner, sentences = labels_[first], doc[own], [plus[k] for k in own.tolist()]
    pairs = np.flatnonzero(cf).tolist()
    w, b = fit_logistic(sentences, y, [plus[k] for k in pairs], [minus[k] for k in pairs], len(index), fairness, owner=owner)
    z = b + np.array([w[k].sum() for k in sentences])
    p = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z, np.flatnonzero(first[own])), -30, 30)))
    # midway between nearly all clean scores and nearly all toxic ones, if those part
    lo, hi = np.quantile(p[y == 0], 0.999), np.quantile(p[y == 1], 0.02)
    cut = float((lo + hi) / 2) if hi > lo else 0.5
    cut = max(cut, float(np.nextafter(1 / (1 + np.exp(-np.clip(b, -30, 30))), 2)))  # no feature, no rejection
    return {"weights": {f: float(w[i]) for f, i in index.items()}, "lifts": lifts, "bias": b, "threshold": cut}


def score_text(text: str | None, model: dict, memo: dict | None = None) -> float:
    """The probability of the worst sentence, or of one without features if that is larger; 0 for NULL and empty texts."""
    if not text:
        return 0.0
    low, memo = text.lower(), {} if memo is None else memo
    weights, lifts, bias = model["weights"], model["lifts"], model["bias"]
    hit, best = set(), bias
    for w in set(WORD.findall(low)):
        f = memo.get(w)
        if f is None:
            f = memo[w] = known_feature(w, lifts) or 0
        if f:
            hit.add(w)
    if hit:
        for s in SENTENCE.split(low):
            ws = hit.intersection(WORD.findall(s))
            if ws:
                best = max(best, bias + sum(weights[x] for x in {memo[w] for w in ws}))
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, best)))))


def _scorer(model, at: int, keep: list[int], name: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = model.value, {}
        for b in batches(it, column=at):
            if len(memo) > 400_000:
                memo.clear()
            s = np.array([score_text(t, m, memo) for t in b.column(at).to_pylist()], dtype=float)
            ok = pa.array(s < m["threshold"])
            cols = [b.column(i) for i in keep] + [pa.array(s)]
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], [b.schema.names[i] for i in keep] + [name])

    return run


def drop_toxic(df: DataFrame, model: dict, text: str = "text", columns: list[str] | None = None, score: str = "toxicity") -> DataFrame:
    """The rows that score below the threshold, with the given columns (all) and the score (unless that name is None)."""
    kept = columns or df.columns
    keep = [df.columns.index(c) for c in kept if score is None or c.lower() != score.lower()]
    (name,) = fresh(df, "score")
    out = T.StructType([*(df.schema[i] for i in keep), T.StructField(name, T.DoubleType())])
    done = df.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(model), df.columns.index(text), keep, name), out)
    return done.drop(name) if score is None else done.withColumnRenamed(name, score)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document that is kept, with its score; the documents that are not here are rejected."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(docs, labels), columns=["doc_id", "lang", "source", "n_chars"] if {"lang", "source", "n_chars"} <= set(docs.columns) else None)
