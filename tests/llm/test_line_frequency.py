from collections import Counter, defaultdict

import pytest

from millrace.llm import line_frequency as L

from .conftest import ODD, canon, doc


def corpus():
    rows = [doc(100 + i, f"Buy NOW  at our shop\nown line {i} with {i * 7} words of its own\nbye {i % 3}", source=f"src{i % 2}") for i in range(40)]
    rows += [doc(200 + i, "buy now at our shop") for i in range(5)] + [doc(300, "Buy now at our SHOP\nok", source=None)]
    return rows + ODD


def brute(rows, min_docs, share, keep):
    texts = defaultdict(set)
    for _, t, _, s, _ in rows:
        if t is not None:
            texts[s].add(t)
    out = []
    df = {s: Counter(n for t in ts for n in {L.normal(x) for x in t.split("\n")} if n) for s, ts in texts.items()}
    import math

    for i, t, lang, s, n in rows:
        if t is None:
            continue
        limit = max(min_docs, math.ceil(len(texts[s]) * share))
        lines = t.split("\n")
        kept = [x for x in lines if not L.normal(x) or df[s][L.normal(x)] <= limit]
        total, left = (sum(len(L.normal(x)) for x in v) for v in (lines, kept))
        if left and left * 100 >= total * keep:
            new = "\n".join(kept)
            out.append((i, lang, len(new) if len(kept) < len(lines) or n is not None else len(new), s, new))
    return sorted(map(repr, out))


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(make, broadcast_keys, clash):
    rows = corpus()
    df = make(rows, clash)
    out = L.drop_frequent_lines(df, min_docs=5, share=0.01, broadcast_keys=broadcast_keys)
    assert out.columns == df.columns
    got = sorted(repr((r.doc_id, r.lang, r.n_chars, r.source, r.text)) for r in out.collect())
    assert got == brute(rows, 5, 0.01, L.KEEP_PERCENT)
    if clash:
        assert {r.score for r in out.collect()} == {"kept"}


def test_clean_documents_stay_and_copies_count_once(make):
    rows = [doc(i, f"this is text number {i}\nand more of {i * i}") for i in range(50)] + [doc(100 + i, "the same text\ncopied often") for i in range(30)]
    assert L.drop_frequent_lines(make(rows)).count() == 80


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_the_limit_does_not_grow_with_the_host(make, broadcast_keys):
    rows = []
    for host, docs in (("small", 20), ("large", 3000)):
        for i in range(docs):
            lines = [f"text number {i} of the host {host}", f"and more of it, {i * i}"]
            lines += ["Read more  about our offers"] if i < 6 else []
            lines += ["a line of five documents"] if 6 <= i < 11 else []
            rows.append(doc(len(rows), "\n".join(lines), source=host))
    got = L.drop_frequent_lines(make(rows), broadcast_keys=broadcast_keys).collect()
    assert len(got) == len(rows)
    assert not any("Read more" in r.text for r in got)
    assert sum("five documents" in r.text for r in got) == 10
    assert sorted(repr((r.doc_id, r.lang, r.n_chars, r.source, r.text)) for r in got) == brute(rows, L.MIN_DOCS, 0, L.KEEP_PERCENT)


def test_empty(make):
    assert L.drop_frequent_lines(make([])).count() == 0


def test_sql(make, duck):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 6]
    df = make(rows)
    got = canon(L.drop_frequent_lines(df, with_removed=True))
    # the two differ on blanks that are not ASCII
    assert got == duck(L.ORACLE, documents=df)


def test_a_column_named_lines_removed_is_replaced(make):
    from pyspark.sql import functions as F

    rows = [doc(i, f"shared line of all\nown line number {i} of this host") for i in range(9)]
    for keys in (L.BROADCAST_KEYS, 0):
        out = L.drop_frequent_lines(make(rows).withColumn("Lines_Removed", F.lit("x")), with_removed=True, broadcast_keys=keys)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lines_removed"]
        assert {r.lines_removed for r in out.collect()} == {1}


def test_the_limit_does_not_grow_with_the_host(make, duck):
    rows = [doc(i, f"own line {i} with words\n" + ("in six documents" if i < 6 else "in five of them" if i < 11 else f"alone {i}")) for i in range(2500)]
    df = make(rows)
    out = L.drop_frequent_lines(df, with_removed=True)
    assert out.filter("lines_removed > 0").count() == 6
    from .conftest import canon

    assert canon(out) == duck(L.ORACLE, documents=df)
