import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import range_coder as R
from millrace.llm.token_files import encoding

from .conftest import ODD, doc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=60), max_size=5))
def test_round_trip(blocks):
    blocks = [np.array(b, np.uint16) for b in blocks]
    back = R.decode_blocks(R.encode_blocks(blocks), [len(b) for b in blocks])
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_long_blocks_and_intervals():
    """The decoder is scalar and written apart, so what it gives back holds the encoder's model to it, id by id."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 50_000, rng.integers(2, 9)) for _ in range(40)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.4, 1500).clip(0, 39)]).astype(np.uint16)
    low, width = R.intervals(ids)
    assert (width > 0).all() and (low.astype(np.int64) + width <= 1 << R.TOTAL).all()
    assert R.decode_block(R.encode_blocks([ids])[0], len(ids)).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        R.intervals(np.zeros(R.LONGEST + 1, np.uint16))


def test_each_order_pays():
    """Ids whose successor follows from one or two ids before cost a fraction of what order 0 can do for them."""
    rng = np.random.default_rng(6)
    after1 = rng.permutation(500)
    one = [0]
    for _ in range(6000):
        one.append(int(after1[one[-1]]) if rng.random() < 0.9 else int(rng.integers(500)))
    two = [0, 1]
    table = rng.integers(0, 60, (60, 60))
    for _ in range(12000):
        two.append(int(table[two[-2], two[-1]]) if rng.random() < 0.9 else int(rng.integers(60)))
    for ids in (np.array(one), np.array(two)):
        ordered, shuffled = (len(R.encode_blocks([x])[0]) for x in (ids, rng.permutation(ids)))
        assert ordered < 0.6 * shuffled


def test_blocks_do_not_depend_on_each_other():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, 500).clip(0, 65535).astype(np.uint16) for _ in range(9)]
    together = R.encode_blocks(blocks)
    assert together == [R.encode_blocks([b])[0] for b in blocks]
    assert R.decode_blocks([together[4]], [500])[0].tolist() == blocks[4].tolist()


def test_prediction_pays():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 50_000, 50)
    ordered = np.concatenate([phrase] * 40).astype(np.uint16)
    shuffled = rng.permutation(ordered)
    a, b = (len(R.encode_blocks([x])[0]) for x in (ordered, shuffled))
    assert a < 0.3 * b < 0.3 * 2 * len(ordered)


@pytest.mark.parametrize("block,lanes", [(64, 2), (1000, 512), (7, 3)])
def test_documents_come_back(make, block, lanes):
    enc = encoding()
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + [doc(50 + i, f"text number {i} " * i) for i in range(30)]
    out = R.coded_blocks(make(rows, clash=True), block=block, lanes=lanes).collect()
    ids = R.decode_blocks([bytes(r.payload) for r in out], [r.n_tokens for r in out])
    got = {}
    for r, x in zip(out, ids):
        assert R.checksum(x) == r.crc and r.n_tokens <= block and sum(r.counts) == r.n_tokens
        at = 0
        for i, n in zip(r.doc_ids, r.counts):
            got.setdefault(i, []).extend(x[at : at + n].tolist())
            at += n
    assert got == {i: enc.encode_ordinary(t) for i, t, *_ in rows if t is not None}


def test_a_damaged_block_is_seen():
    ids = np.arange(500, dtype=np.uint16)
    p = bytearray(R.encode_blocks([ids])[0])
    p[40] ^= 8
    assert R.checksum(R.decode_blocks([bytes(p)], [500])[0]) != R.checksum(ids)


def test_rows_without_id_and_empty_tables(make):
    assert R.coded_blocks(make([])).count() == 0
    assert R.coded_blocks(make([doc(None, "some text"), doc(1, None)])).collect()[0].doc_ids == [None]


def test_rows_without_id_and_repeated_rows_in_a_table(make):
    enc = encoding()
    rows = [doc(None, "one text"), doc(3, "again"), doc(3, "again"), doc(4, ""), doc(None, "another")]
    held = []
    for r in R.coded_blocks(make(rows)).collect():
        x = R.decode_block(bytes(r.payload), r.n_tokens)
        cut = np.split(x, np.cumsum(r.counts)[:-1])
        held += [(i, tuple(c.tolist())) for i, c in zip(r.doc_ids, cut)]
    assert sorted(held, key=str) == sorted(((i, tuple(enc.encode_ordinary(t))) for i, t, *_ in rows), key=str)
