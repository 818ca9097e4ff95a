import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import token_counts as K
from millrace.llm.token_files import FILE, encoding, token_lengths

from .conftest import ODD, doc

ENC, LEN = encoding(), token_lengths()


@settings(max_examples=200, deadline=None)
@given(st.text("ab1 '\n\té漢,.s", max_size=400), st.integers(5, 60), st.integers(1, 20))
def test_ids_are_those_of_the_whole_text(text, chunk, overlap):
    got = [i for x in K.encode_huge(text, ENC, LEN, chunk, overlap) for i in x.tolist()]
    assert got == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, "漢字" * 900, "7" * 2000 + " x", " \n" * 1500, "don't can't won't " * 300, "ab" * 40 + "é" * 2000 + " end"])
def test_overlaps_widen_where_nothing_aligns(text):
    assert K.count_tokens(text, ENC, LEN, huge=100, chunk=200, overlap=4) == len(ENC.encode_ordinary(text))


def test_several_vocabularies(spark, make):
    rng = random.Random(4)
    rows = [doc(i, " ".join("".join(rng.choice("aeioubcdñé") for _ in range(rng.randint(1, 9))) for _ in range(800))) for i in range(5)] + ODD
    for file in (FILE, "byte_bpe_multi_50k.tiktoken"):
        enc = encoding(file=file)
        got = [(r.doc_id, r.n_tokens) for r in K.token_counts(make(rows, clash=True), huge=500, chunk=300, overlap=16, file=file).collect()]
        want = [(i, None if t is None else len(enc.encode_ordinary(t))) for i, t, *_ in rows]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty(make):
    assert K.token_counts(make([])).count() == 0
