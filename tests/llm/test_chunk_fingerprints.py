import time

import numpy as np
import pyarrow as pa

from millrace.llm import chunk_fingerprints as C

from .conftest import ODD, doc


def corpus(seed=9):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghik"), int(rng.integers(2, 9)))) for _ in range(n))
    rows, common = [], text(80)
    for g in range(25):
        a, b = text(300), text(200)
        rows += [doc(g * 10 + 20, a), doc(g * 10 + 21, a), doc(g * 10 + 22, f"new words first {a} {b}"), doc(g * 10 + 23, common + " " + b), doc(g * 10 + 24, b[:600].upper() + "\n\n" + a[:900])]
    return rows + [doc(900 + i, common) for i in range(3)] + ODD


def brute(rows, threshold):
    """(doc_id, class_id, copies, chunks, containers, container_id, containment) by comparing all pairs of texts' sets."""
    held = [(i, s) for (i, t, *_), s in zip(rows, C.chunk_sets([r[1] for r in rows])) if i is not None]
    classes = {}
    for i, s in held:
        if s:
            classes.setdefault(frozenset(s.items()), []).append(i)
    best = {}
    for x in classes:
        total = sum(n for _, n in x)
        found = []
        for y in classes:
            shared = sum(n for _, n in x & y)
            if x != y and shared >= C.needed(total, threshold):
                found.append((-shared, min(classes[y])))
        best[x] = (len(found), min(found)[1] if found else None, round(-min(found)[0] / total, 9) if found else None)
    return sorted((i, min(classes[k]), len(classes[k]), len(s), *best[k]) if (k := frozenset(s.items())) else (i, None, 0, 0, 0, None, None) for i, s in held)


def result(df, **how):
    out = C.containments(df, **how).collect()
    return sorted((r.doc_id, r.class_id, r.copies, r.chunks, r.containers, r.container_id, None if r.containment is None else round(r.containment, 9)) for r in out)


def sort_key(r):
    return tuple((x is None, x) for x in r)


def test_against_all_pairs(make):
    """Also with a limit for common digests that most repeated ones are over, and blocks of two sets."""
    rows = corpus()
    for threshold, common, block in ((C.THRESHOLD, C.COMMON, C.BLOCK), (0.2, 3, 2), (0.6, 1, 3), (0.95, 5, 512)):
        got = result(make(rows, clash=True), threshold=threshold, common=common, block=block)
        assert sorted(got, key=sort_key) == sorted(brute(rows, threshold), key=sort_key)
        assert sum(r[4] > 0 for r in got) > 20


def test_passages_that_many_share(make, monkeypatch):
    """Common passages in changing company, small packs, and an id that stands for two texts."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghik"), int(rng.integers(2, 9)))) for _ in range(n))
    passages, rows = [text(60) for _ in range(4)], []
    for i in range(260):
        k = rng.random(4) < 0.4
        rows.append(doc(i - i % 40 // 39, " ".join([text(int(rng.integers(1, 60))), *[p for p, x in zip(passages, k) if x]])))
    rows += rows[:7]
    monkeypatch.setattr(C, "PACKED", 900)
    for common in (2, 8, 64):
        got = result(make(rows).repartition(3), common=common, block=16, broadcast_digests=0 if common == 8 else 1000)
        assert sorted(got, key=sort_key) == sorted(brute(rows, C.THRESHOLD), key=sort_key)
    assert max(r[4] for r in got) > 40


def test_an_insertion_moves_only_the_cuts_next_to_it():
    rng = np.random.default_rng(2)
    a = " ".join("".join(rng.choice(list("abcdefghik"), 6)) for _ in range(4000))
    x, y = C.chunk_sets([a, a[:9000] + "inserted words " + a[9000:]])
    assert sum(n for d, n in x.items() if d in y) >= 0.95 * sum(x.values())


def test_chunk_sizes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 117, 200_000).astype(np.uint8)
    h = C.gear_hashes(data) << np.uint32(32 - C.WINDOW)
    loose = (np.flatnonzero(h < 1 << 28) + 1).tolist()
    strict = (np.flatnonzero(h < 1 << 26) + 1).tolist()
    size = np.diff([0, *C.cuts(strict, loose, 0, len(data))])
    assert size.sum() == len(data) and size[:-1].min() >= C.CHUNK_LEAST and size.max() <= C.CHUNK_MOST
    assert 25 < size.mean() < 50


def test_gear_hash_is_a_rolling_one():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog again and again", np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert C.gear_hashes(data).tolist() == want


def test_empty(make):
    assert C.containments(make([])).count() == 0


def test_near_copies_at_several_edit_rates_are_found(make):
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(rng.choice(list("abcdefghiklmnoprstu"), n))
    words = [letters(int(rng.integers(2, 10))) for _ in range(3000)]
    rows, planted = [], {}
    for k, every in enumerate((17, 20, 25, 30, 60)):
        for g in range(20):
            own = [str(w) for w in rng.choice(words, int(rng.integers(120, 400)))]
            copy = [letters(6) if (j + g) % every == 0 else w for j, w in enumerate(own)]
            i = 1000 * k + 10 * g
            rows += [doc(i, " ".join(own)), doc(i + 1, " ".join(copy)), doc(i + 2, " ".join(str(w) for w in rng.choice(words, 200)))]
            planted[i, i + 1] = every
    near = {r.doc_id: r.container_id for r in C.containments(make(rows)).collect() if r.containers}
    found = {(a, b) for a, b in planted if near.get(a) == b or near.get(b) == a}
    for every in (20, 25, 30, 60):
        assert all(p in found for p in planted if planted[p] == every), every
    assert sum(p in found for p in planted if planted[p] == 17) >= 10  # word-3-gram Jaccard 0.7, the edge of what counts as a near copy
    assert not any(i % 10 == 2 for i in near)


def test_a_digest_holds_its_length():
    """Also as a word, and words sort by the number of holders."""
    found = C.chunk_sets([" ".join(f"word{i * 7919 % 1000}" for i in range(500)), "tiny", "x" * 5000])
    for s in found:
        assert s and all((d & 127) + 1 == n for d, n in s.items())
    assert {n for s in found for n in s.values()} >= {4, C.CHUNK_MOST}
    d = np.array([*found[0]][:9])
    for common in (3, 64, 1000):
        holders = np.array([2, 3, common, common + 1, 5, 64, 10**6, 2, 70])
        w = C.words(d, holders, common)
        assert (w > 0).all() and ((w & 127) == (d & 127)).all() and ((w >= C.HOT) == (holders > common)).all()
        assert (np.diff(np.minimum(holders, common + 1)[np.argsort(w)]) >= 0).all() or common > 64
    same = C.words(d[[0, 0]], np.array([5, 5]), 64)
    assert same[0] == same[1] and len({*C.words(d, np.full(9, 5), 64).tolist()}) == 9


def test_a_pair_is_compared_once():
    rows = [(1, 10, 5, 90), (1, 20, 5, 90), (1, 30, 40, 90), (2, 10, 5, 50), (2, 20, 5, 50), (3, 40, 5, 50), (3, 10, 5, 3)]
    b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["d", "i", "need", "left"])
    out = [list(zip(*(c.to_pylist() for c in x.columns))) for x in C._pairs_pass(iter([b]))]
    assert {p for x in out for p in x} == {(10, 20), (10, 30), (20, 30)}  # from digest 3 on, 10 has too little left


def test_steps_leave_no_shuffle_files(spark, make):
    """Nor a changed setting."""
    jvm, name = spark.sparkContext._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        disk = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        every = disk.getAllFiles()
        sizes = {(f := every.apply(k)).getName(): f.length() for k in range(every.size())}
        return {k for k, size in sizes.items() if k.startswith("shuffle_") and k.endswith(".data") and size > 1000}

    before, was = files(), spark.conf.get(name, None)
    out = C.containments(make(corpus()).repartition(3))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name, None) == was
    assert out.count() == len([r for r in corpus() if r[0] is not None])
