from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import packing as P
from millrace.llm.token_files import encoding

from .conftest import ODD, doc


def brute(sizes, tokens, docs, cost, rule, weights):
    bins, out = [], []
    for n in sizes:
        best = None
        for j, (t, d, c) in enumerate(bins):
            if t >= n and d >= 1 and c >= n * n:
                res, need = np.array([t / tokens, d / docs, c / cost]), np.array([n / tokens, 1 / docs, n * n / cost])
                score = -float((res * need * weights).sum()) if rule == "dot" else float(((res - need) ** 2 * weights).sum())
                if best is None or score < best[0]:
                    best = score, j
        if best is None:
            bins.append([tokens, docs, cost])
            best = 0, len(bins) - 1
        b = bins[best[1]]
        b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - n * n
        out.append(best[1])
    return out


def tokens(t):
    return len(encoding().encode_ordinary(t))


def words(n):
    return " ".join(["w"] * n)


def test_bins_hold_the_brute_force_packing_of_the_token_counts(make):
    """One group: pieces by falling size, then by hash; the bins' contents are those of the rule applied piece by piece."""
    rows = [doc(i, words(1 + i * 53 % 400)) for i in range(200)] + [doc(500, "漢字仮名交じり文" * 400)]
    out = P.pack(make(rows), tokens=500, docs=6, cost_share=0.5).collect()
    assert sum(r.n_tokens for r in out if r.doc_id == 500) == tokens(rows[-1][1]) > 2000
    sizes = sorted((r.n_tokens for r in out), reverse=True)
    want = brute(sizes, 500, 6, 125_000, P.RULE, np.array(P.WEIGHTS))

    def shape(pairs):
        held = defaultdict(list)
        for b, n in pairs:
            held[b].append(n)
        return sorted(sorted(v) for v in held.values())

    assert shape((r.bin_id, r.n_tokens) for r in out) == shape(zip(want, sizes))
    by = defaultdict(int)
    for r in out:
        by[r.doc_id] += r.n_tokens
    assert by == {i: tokens(t) for i, t, *_ in rows}


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize("docs,share", [(24, 0.75), (3, 0.2), (1, 1.0), (100, 1.0)])
def test_against_brute_force(rule, docs, share):
    rng = np.random.default_rng(5)
    cost = int(share * 1000 * 1000)
    sizes = np.sort(np.minimum(rng.lognormal(4, 1.2, 500).astype(int) + 1, P.longest_piece(1000, cost)))[::-1]
    got = P.best_fit(sizes, 1000, docs, cost, rule, (1.0, 0.25, 0.5))
    assert got.tolist() == brute(sizes.tolist(), 1000, docs, cost, rule, np.array([1.0, 0.25, 0.5]))


@pytest.mark.parametrize("group", [10_000, 40])
def test_every_token_once_and_no_capacity_exceeded(make, group):
    rows = [doc(i, words(i * 37 % 900)) for i in range(300)] + ODD
    out = P.pack(make(rows, clash=True), tokens=500, docs=6, cost_share=0.5, group_pieces=group).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= 500 and len(b) <= 6 and sum(r.n_tokens**2 for r in b) <= 125_000
        assert sorted(r.slot for r in b) == list(range(len(b)))
    for i in range(12, 300):
        n = i * 37 % 900
        assert sum(x[2] for x in pieces[i]) == n
        assert [x[1] for x in sorted(pieces[i])] == [353 * k for k in range(len(pieces[i]))]
    assert len(pieces[6]) >= 2 and None in pieces


def test_poorly_filled_bins_of_the_groups_are_packed_together(make):
    rows = [doc(i, words(20 + i * 37 % 60)) for i in range(600)]
    bins = lambda group: {r.bin_id: 0 for r in P.pack(make(rows), tokens=1000, docs=50, cost_share=1.0, group_pieces=group).collect()}
    out = P.pack(make(rows), tokens=1000, docs=50, cost_share=1.0, group_pieces=30).collect()
    used = defaultdict(int)
    for r in out:
        used[r.bin_id] += r.n_tokens
    assert len(out) == len({(r.doc_id, r.piece) for r in out}) == 600 and max(used.values()) <= 1000
    assert sum(used.values()) == sum(20 + i * 37 % 60 for i in range(600))
    assert len(used) <= len(bins(10_000)) * 1.25
    assert sum(n < 500 for n in used.values()) <= 10


def test_empty(make):
    assert P.pack(make([])).count() == 0
