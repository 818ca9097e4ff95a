import numpy as np
import pytest

from millrace.llm import near_duplicates as N

from .conftest import ODD, doc


def corpus(seed=7, groups=40, singles=150):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(3, 9))))
    rows, i = [], 0
    for g in range(groups + singles):
        base = [word() for _ in range(int(rng.integers(30, 200)))]
        for _ in range(1 if g >= groups else int(rng.integers(2, 9)) if g else 60):
            w = list(base)
            for k in rng.choice(len(w), int(rng.integers(0, max(1, len(w) // 20))), replace=False):
                w[k] = word()
            rows.append((doc(1000 + i, " ".join(w)), g))
            i += 1
    return rows


def test_recall_against_all_pairs_and_planted_groups(make):
    rows = corpus()
    docs = [r for r, _ in rows]
    group = {r[0]: g for r, g in rows}
    out = N.near_copies(make(docs, clash=True)).collect()
    keep = {r.doc_id: r.keep_id for r in out}
    head = lambda i: keep.get(i, i)
    f, _ = N.fingerprints([r[1] for r in docs])
    x = np.ascontiguousarray(f).view(np.uint64)
    d = sum(np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(int) for k in range(4))
    i, j = np.nonzero(d <= N.RADIUS)
    pairs = [(docs[a][0], docs[b][0]) for a, b in zip(i, j) if a < b]
    assert sum(head(a) == head(b) for a, b in pairs) >= 0.9 * len(pairs)
    # no one is grouped with a stranger, and the smallest id stays
    assert all(group[a] == group[b] and b < a for a, b in keep.items())
    assert all(head(b) == b for b in keep.values())
    planted = [(a, b) for a in group for b in group if a < b and group[a] == group[b]]
    assert sum(head(a) == head(b) for a, b in planted) >= 0.95 * len(planted)


def test_deep_nodes_give_the_same(make):
    rows = [r for r, _ in corpus(groups=10, singles=20)]
    a = {tuple(r) for r in N.near_copies(make(rows)).collect()}
    b = {tuple(r) for r in N.near_copies(make(rows), small=2, recall=0.999).collect()}
    assert {(x[0], x[1]) for x in a} == {(x[0], x[1]) for x in b}


def test_links_within_against_brute_force():
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**63, (300, 4)).astype(np.uint64)
    for k in range(1, 300):
        if k % 3:
            f[k] = f[k - 1] ^ (np.uint64(1) << rng.integers(0, 60, 4).astype(np.uint64))
    ids = rng.permutation(300).astype(np.int64)
    got = dict(zip(*(x.tolist() for x in N.links_within(ids, f, 10, block=32))))
    d = sum(np.bitwise_count(f[:, None, k] ^ f[None, :, k]).astype(int) for k in range(4)) <= 10
    seen, want = set(), {}
    for s in range(300):
        if s not in seen:
            todo, comp = [s], set()
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += np.flatnonzero(d[x]).tolist()
            seen |= comp
            low = min(ids[c] for c in comp)
            want |= {int(ids[c]): int(low) for c in comp if ids[c] != low}
    assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 50 + k) for k in range(30, 60)] + [(7, 3), (7, 3)]
    got = {r.a: r.b for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 80 for k in range(81, 110)}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shape_keeps_the_recall():
    for n in (10, 10**4, 10**6, 10**9):
        depth, tries = N.forest_shape(n)
        assert 1 - (1 - N.shared_prefix(depth)) ** tries >= N.RECALL


def test_short_words_and_order_count():
    f, ok = N.fingerprints(["we go to the river at 10 am", "he is in the river by 55 pm", "to be or not", "not or be to", "a", "!"])
    x = np.ascontiguousarray(f).view(np.uint64)
    d = N.distances(x, x)
    assert d[0, 1] > N.RADIUS and d[2, 3] > 0 and ok.tolist() == [True] * 5 + [False]


def test_fingerprint_against_brute_force():
    text = "one two three two one"
    words = [N.xxhash.xxh3_64_intdigest(w.encode(), seed=N.SEED) for w in text.split()]
    m, lanes = (1 << 64) - 1, N._LANES.tolist()
    pairs = {(a * lanes[0] + b * lanes[1]) & m for a, b in zip([1, *words], [*words, 2])}

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    feats = set(words) | pairs
    vectors = [b"".join(mixed((h + k) & m).to_bytes(8, "little") for k in lanes) for h in feats]
    ones = sum(np.unpackbits(np.frombuffer(v, np.uint8)).astype(int) for v in vectors)
    assert (np.packbits(2 * ones > len(feats)) == N.fingerprints([text])[0][0]).all()


def test_a_hundred_thousand_near_equal_rows_in_one_node():
    rng = np.random.default_rng(8)
    n = 100_000
    f = np.repeat(rng.integers(0, 2**63, (3, 4)).astype(np.uint64), [n - 3000, 1000, 2000], axis=0)
    for _ in range(9):
        f[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    chain = f[:1].repeat(6, axis=0)  # leads from the first group's edge away, 40 bits a step
    for k in range(1, 6):
        chain[k:, (k - 1) * 40 // 64] ^= np.uint64((1 << 40) - 1) << np.uint64(8)
    ids = rng.permutation(n + 6).astype(np.int64)
    member, low = N.links_within(ids, np.concatenate([f, chain]), 48)
    assert len(member) == n + 6 - 3 and len(set(low.tolist())) == 3


def test_pivots_give_what_all_pairs_give():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (40, 4)).astype(np.uint64)
    f = base[rng.integers(0, 40, 1500)]
    for k in range(30):
        hit = rng.random(1500) < 0.7
        f[hit, rng.integers(0, 4)] ^= np.uint64(1) << rng.integers(0, 64, int(hit.sum())).astype(np.uint64)
    ids = rng.permutation(1500).astype(np.int64)
    for pivots in (0, 3, 200):
        got = {tuple(x) for x in zip(*(y.tolist() for y in N.links_within(ids, f, 30, block=50, pivots=pivots)))}
        assert got == {tuple(x) for x in zip(*(y.tolist() for y in N.links_within(ids, f, 30, block=5000)))}
        assert 100 < len(got) < 1499


def test_hot_nodes_in_blocks_give_the_same(make):
    rows = [r for r, _ in corpus(groups=12, singles=30)]
    rows += [doc(5000 + i, "the very same words again and again with one change " + "".join(chr(97 + int(c)) for c in str(i)) + " and a long tail of words that follow it") for i in range(120)]
    a = {(r.doc_id, r.keep_id) for r in N.near_copies(make(rows)).collect()}
    for hot in (20, 60):
        assert {(r.doc_id, r.keep_id) for r in N.near_copies(make(rows), hot=hot, small=4, recall=0.999).collect()} == a
    assert len(a) > 150


def test_of_rows_with_one_id_the_smallest_text_stays(make):
    rows = [doc(1, "zebra crossing here"), doc(1, "apple trees over there"), doc(1, None), doc(2, "quite another text"), doc(3, None, "de"), doc(3, None, "en")]
    for n in (1, 5):
        out = N.deduplicate(make(rows).repartition(n)).collect()
        assert sorted((r.doc_id, r.text or "", r.lang) for r in out) == [(1, "apple trees over there", "en"), (2, "quite another text", "en"), (3, "", "de")]


def test_ids_that_are_strings(make):
    df = make([doc(4, "some words of a text"), doc(9, "some words of a text"), doc(None, "x")]).withColumn("doc_id", N.F.col("doc_id").cast("string"))
    assert [tuple(r) for r in N.near_copies(df).collect()] == [(9, 4, True)]


def test_odd_rows(make):
    assert [tuple(r) for r in N.near_copies(make(ODD)).collect()] == []
    out = N.deduplicate(make(ODD, clash=True))
    assert out.columns == make(ODD, clash=True).columns
    # of the rows with id 6 one stays; those without id or text stay
    assert out.count() == len(ODD) - 1
    assert N.deduplicate(make([])).count() == 0


@pytest.mark.parametrize("n", [300])
def test_deduplicate_keeps_one_of_each(make, n):
    rows = [doc(i, "the very same copied text of a page about boats") for i in range(n)] + [doc(1000, "something else entirely, on gardens")]
    assert sorted(r.doc_id for r in N.deduplicate(make(rows)).collect()) == [0, 1000]
