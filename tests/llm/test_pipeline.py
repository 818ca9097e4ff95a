"""The stages of the pipeline one after another, each against brute force over what the one before it left."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from millrace.llm import line_frequency as L
from millrace.llm import mixing as M
from millrace.llm import near_duplicates as N
from millrace.llm import packing as K
from millrace.llm import toxicity as X
from millrace.llm._shared import tables

from .conftest import ODD, canon, doc
from .test_mixing import sql, tokens, with_counts
from .test_packing import brute as best_fit
from .test_toxicity import BAD, CLEAN

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(3, 9))))
    rows, labels = [], []
    for i in range(100, 340):
        host, words = f"src{i % 13}", [word() for _ in range(int(rng.integers(30, 120)))]
        lines = [" ".join(words), " ".join(rng.choice(CLEAN, 8))]
        if i % 4 == 0:
            lines[1] += " " + str(rng.choice(BAD))
        if i % 3:
            lines.append(f"Subscribe to the letter of {host}")
        rows.append(doc(i, "\n".join(lines), ("en", "de", "fr", None)[i % 4 if i % 5 else 0], host))
        labels.append((i, int(i % 4 == 0)))
        if i % 6 == 1:  # a copy with a changed word, and an exact one
            words[3] = word()
            rows += [doc(1000 + i, "\n".join([" ".join(words), *lines[1:]]), "en", host), doc(2000 + i, rows[-1][1], "en", host)]
    return rows + ODD, labels


@pytest.fixture(scope="module")
def stages(spark, make, tmp_path_factory):
    """Rows before and after each stage, and the labels."""
    rows, labels = corpus()
    d = tmp_path_factory.mktemp("pipeline")
    make(rows).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    held, docs = [], spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, str(d)).write.parquet(f"{d}/{k}")
        before, docs = docs, spark.read.parquet(f"{d}/{k}")
        held.append((before, docs))
    return held, labels, str(d)


def plain(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    held = stages[0]
    assert all(after.columns == COLUMNS for _, after in held[:-1])
    assert all(0 < after.count() for _, after in held) and all(a.count() < b.count() for b, a in held[:3])


def test_quality(stages):
    before, after = stages[0][0]
    holders = defaultdict(set)
    rows = before.collect()
    for r in rows:
        for n in map(L.normal, (r.text or "").split("\n")):
            holders[r.source, n].add(r.text)
    want = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not L.normal(x) or len(holders[r.source, L.normal(x)]) <= L.MIN_DOCS]
        size = lambda k: sum(len(L.normal(x)) for x in k)
        if size(kept) and size(kept) * 100 >= size(lines) * L.KEEP_PERCENT:
            t = "\n".join(kept)
            want[r.doc_id, t, r.lang, r.source, len(t) if len(kept) < len(lines) or r.n_chars is not None else len(t)] += 1
    assert plain(after) == want
    assert after.filter("text like '%Subscribe%'").count() == 0


def test_toxicity(stages, spark):
    before, after = stages[0][1]
    model = X.fit(before, spark.read.parquet(f"{stages[2]}/labels.parquet"))

    def score(t):
        z = [model["bias"]]
        for s in X.SENTENCE.split(t.lower()):
            f = {X.known_feature(w, model["lifts"]) for w in X.WORD.findall(s)} - {None}
            z.append(model["bias"] + sum(model["weights"][k] for k in f))
        return 1 / (1 + np.exp(-np.clip(max(z), -30, 30)))

    assert plain(after) == Counter({r: n for r, n in plain(before).items() if score(r[1]) < model["threshold"]})
    left = {r.doc_id for r in after.collect()}
    assert all((i in left) == (not t) for i, t in stages[1])


def test_near_duplicates(stages):
    before, after = stages[0][2]
    rows = sorted(before.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    f, ok = N.fingerprints([r.text for r in rows])
    x = np.ascontiguousarray(f).view(np.uint64)
    near = (N.distances(x, x) <= N.RADIUS) & ok & ok[:, None]
    named = np.array([r.doc_id is not None for r in rows])
    near &= named & named[:, None]
    keep, seen = [], set()
    for i, r in enumerate(rows):
        if r.doc_id is None or not ok[i]:
            keep.append(r)
        elif i not in seen:
            keep.append(r)
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += np.flatnonzero(near[j]).tolist()
    assert plain(after) == Counter(tuple(r) for r in keep)
    ids = {r.doc_id for r in after.collect()}
    assert not ids & set(range(1000, 3000)) and None in ids


def test_mixing(stages, make, duck):
    before, after = stages[0][3]
    rows = [tuple(r) for r in before.collect()]
    _, want = duck(f"SELECT text FROM ({sql()}) JOIN (SELECT DISTINCT doc_id AS i, text FROM documents) ON doc_id IS NOT DISTINCT FROM i", documents=with_counts(make, rows))
    assert Counter(repr(r.text) for r in after.collect()) == Counter(t for (t,) in want)
    assert not plain(after).keys() - plain(before).keys()


def test_packing(stages):
    before, after = stages[0][4]
    out, by = after.collect(), Counter()
    for r in before.collect():
        by[r.doc_id] += tokens(r.text)
    got = Counter()
    for r in out:
        got[r.doc_id] += r.n_tokens
    assert got == by
    sizes = sorted((r.n_tokens for r in out), reverse=True)
    cost = int(K.COST_SHARE * K.TOKENS**2)
    bins = defaultdict(list)
    for b, n in zip(best_fit(sizes, K.TOKENS, K.DOCS, cost, K.RULE, np.array(K.WEIGHTS)), sizes):
        bins[b].append(n)
    mine = defaultdict(list)
    for r in out:
        mine[r.bin_id].append(r.n_tokens)
    assert sorted(sorted(x) for x in mine.values()) == sorted(sorted(x) for x in bins.values())


def test_run_is_the_stages_and_leaves_one_table(stages, spark):
    before = tables()
    out = P.run(spark, stages[2])
    assert len(tables() - before) == 1
    assert canon(out.drop("bin_id")) == canon(stages[0][-1][1].drop("bin_id"))


def test_empty_table(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
