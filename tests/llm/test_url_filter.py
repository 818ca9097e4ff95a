import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import url_filter as U

from .conftest import canon


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*?\\.", max_size=9), min_size=1, max_size=40), st.lists(st.text("ab.*?\\", max_size=14), max_size=12))
def test_against_regular_expressions(globs, texts):
    got = U.Automaton(globs).matches([t.encode() for t in texts])
    # a backslash at the end stands for itself
    want = [[bool(re.fullmatch(U.glob_regex(g if not trailing(g) else g + "\\"), t, re.S)) for g in globs] for t in texts]
    assert got.tolist() == (want if texts else np.zeros((0, len(globs)), bool).tolist())


def trailing(g):
    n = len(g) - len(g.rstrip("\\"))
    return n % 2 == 1


def test_many_words():
    globs = [f"*site{i}.example/*" for i in range(300)]
    auto = U.Automaton(globs)
    assert auto.words > 50
    got = auto.matches([b"a.site7.example/x", b"site299.example/", b"site300.example/x"])
    assert [np.flatnonzero(r).tolist() for r in got] == [[7], [299], []]


def test_sql(spark, duck):
    urls = ["HTTP://user@WWW.Foo.Example.net:80/en//a?utm_source=x&q=1#f", "https://m.x.example.org/de/1.html", None, "", "   ", "m." + "a" * 4000, "https://x.example.com/fr/2222/", "https://x/?ref=1&utm_a=2&page=3&"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, urls[1]), (None, urls[0])], "page_id long, url string")
    assert canon(U.match_urls(df)) == duck(U.ORACLE, pages=df)


def test_allow_overrides_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a.example.net/en/1", "x"), (2, "http://a.example.net/fr/1", "y")], "page_id int, url string, rules string")
    assert [(r.page_id, r.blocked) for r in U.match_urls(df).orderBy("page_id").collect()] == [(1, False), (2, True)]
    assert U.match_urls(df.limit(0)).count() == 0
    assert U.match_urls(df, rules=[]).filter("blocked OR rules <> ''").count() == 0
