from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import mixing as M
from millrace.llm.token_files import encoding

from .conftest import ODD, canon, doc


def _level(name: str, parent: str, key: str, weight: str, source: str, budget: str) -> str:
    by = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {key}" if parent else f"ORDER BY cap::DOUBLE / weight, {key}"
    part = f"PARTITION BY {parent}" if parent else ""
    cols = f"{parent}, {key}" if parent else key
    return f"""
{name}_n AS (SELECT x.*, {budget} AS budget FROM (SELECT {cols}, sum(cap)::BIGINT AS cap, {weight} AS weight FROM leaves GROUP BY {cols}) x {source}),
{name}_f AS (SELECT *, coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * weight
  + cap * sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget * weight AS is_full FROM {name}_n WHERE weight > 0),
{name} AS (SELECT {cols}, (CASE WHEN is_full THEN cap ELSE (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})) * weight
  // nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}), 0) END)::BIGINT AS share FROM {name}_f),"""


def sql(domains=M.DOMAINS, domain_weights=M.DOMAIN_WEIGHTS, lang_weights=M.LANG_WEIGHTS, source_weights=M.SOURCE_WEIGHTS):
    """The mixture in SQL, over documents with their token counts."""
    return (
    f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS src, coalesce(lang, '') AS lang, coalesce(doc_id::VARCHAR, md5(text), '') AS key,
  n_tokens AS n FROM documents),
s AS (SELECT *, {M.domain_case("src", domains)} AS dom FROM d WHERE n > 0),
every AS (SELECT dom, lang, src, sum(n)::BIGINT AS tokens, (sum(n) * {M.MAX_EPOCHS})::BIGINT AS cap FROM s GROUP BY ALL),
leaves AS (SELECT * FROM every WHERE {M.case("dom", domain_weights, domain_weights.get("other", 1))} > 0 AND {M.case("lang", lang_weights, lang_weights.get("", 1))} > 0 AND {M.case("src", source_weights, source_weights.get("", 1))} > 0),"""
    + _level("l1", "", "dom", M.case("dom", domain_weights, domain_weights.get("other", 1)), "", f"(SELECT sum(tokens) * {M.BUDGET_PERCENT} // 100 FROM every)")
    + _level("l2", "dom", "lang", M.case("lang", lang_weights, lang_weights.get("", 1)), "JOIN l1 ON x.dom = l1.dom", "l1.share")
    + _level("l3", "dom, lang", "src", M.case("src", source_weights, source_weights.get("", 1)), "JOIN l2 ON x.dom = l2.dom AND x.lang = l2.lang", "l2.share")
    + f"""
b AS (SELECT leaves.*, share // tokens AS epochs, share - (share // tokens) * tokens AS rest FROM leaves JOIN l3 USING (dom, lang, src)),
o AS (SELECT s.*, epochs, rest, md5('{M.SEED}|' || epochs::VARCHAR || '|' || key) AS h FROM s JOIN b USING (dom, lang, src)),
c AS (SELECT *, sum(n) OVER (PARTITION BY dom, lang, src ORDER BY h) AS cum FROM o),
t AS (SELECT *, unnest(range(epochs + CASE WHEN cum <= rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, dom AS domain, lang, src AS source, epoch::BIGINT AS epoch, n AS n_tokens FROM t"""
)


def tokens(t):
    return len(encoding().encode_ordinary(t)) if t and t.strip() else 0


def with_counts(make, rows):
    n = make([]).sparkSession.createDataFrame([(t, tokens(t)) for t in {r[1] for r in rows}], "text string, n_tokens long")
    df = make(rows)
    return df.join(n, df["text"].eqNullSafe(n["text"])).select(*(df[c] for c in df.columns), "n_tokens")


def corpus(n=300):
    return [doc(i, " ".join(["w"] * (1 + i * 7 % 50)), ("en", "de", "fr", "es", None)[i % 5], f"src{i * i % 17}") for i in range(n)] + ODD


def test_sql(make, duck):
    rows = corpus()
    df, counted = make(rows), with_counts(make, rows)
    want = duck(sql(), documents=counted)
    assert len(want[1]) > 300
    assert canon(M.mix(df, plan=True)) == want
    assert canon(M.mix(df, plan=True, bucket_rows=3)) == want
    assert canon(M.mix(df, plan=True, bucket_rows=3, broadcast_leaves=2)) == want


def test_sql_with_weights_of_zero_and_names_with_quotes(make, duck):
    rows = [doc(i, "word " * (1 + i * 7 % 50), ("en", "l'autre")[i % 2], ("o'reilly", "src1", "src2")[i % 3]) for i in range(200)]
    how = dict(domains={"d'or": ["o'reilly"], "web": ["src1", "src2"]}, domain_weights={"d'or": 2, "other": 1}, lang_weights={"l'autre": 3, "": 1}, source_weights={"src2": 0, "o'reilly": 5, "": 1})
    got = M.mix(make(rows), plan=True, **how)
    assert canon(got) == duck(sql(**how), documents=with_counts(make, rows))
    assert {r.source for r in got.collect()} == {"o'reilly", "src1"}


def test_the_share_of_a_source_without_weight_goes_to_siblings(make):
    """web holds a source of weight 0: it is no capacity, so what web can't take goes to the reference."""
    rows = [doc(i, "a b", "en", "src0") for i in range(50)] + [doc(100 + i, "a b", "en", "src1") for i in range(500)] + [doc(1000 + i, "a b", "en", "src11") for i in range(200)]
    out = M.mix(make(rows), plan=True, budget_tokens=200, max_epochs=1, domains={"web": ["src0", "src1"], "ref": ["src11"]}, domain_weights={"web": 3, "ref": 1}, lang_weights={"": 1},
                source_weights={"src1": 0, "": 1})
    by = defaultdict(int)
    for r in out.collect():
        by[r.domain] += r.n_tokens
    assert by == {"web": 100, "ref": 100}


def fill(weights, caps, budget):
    """Water filling by rounds: what a full child leaves goes to its siblings."""
    got, left = dict.fromkeys(weights, 0.0), set(k for k in weights if weights[k])
    while budget > 1e-9 and left:
        w, b = sum(weights[k] for k in left), budget
        for k in sorted(left):
            x = min(caps[k] - got[k], b * weights[k] / w)
            got[k] += x
            budget -= x
        left = {k for k in left if caps[k] - got[k] > 1e-9}
    return got


def test_shortage_goes_to_siblings_before_ancestors(make):
    # web/de has one short document; its budget goes to web/en, not to the other domain
    text = " ".join(["b"] * 10)
    assert tokens(text) == 10
    rows = [doc(1, text, "de", "src0")] + [doc(10 + i, text, "en", "src0") for i in range(100)] + [doc(500 + i, text, "en", "src11") for i in range(100)]
    out = M.mix(make(rows), plan=True, budget_tokens=1000, max_epochs=1, domains={"web": ["src0"], "ref": ["src11"]}, domain_weights={"web": 1, "ref": 1},
                lang_weights={"en": 1, "de": 1}, source_weights={"": 1})
    by = defaultdict(int)
    for r in out.collect():
        by[r.domain, r.lang] += r.n_tokens
    assert by == {("web", "de"): 10, ("web", "en"): 490, ("ref", "en"): 500}


def test_against_water_filling(make):
    rows = [r for r in corpus(400) if r[1]]
    df = make(rows)
    leaves = defaultdict(int)
    for _, t, lang, s, _ in rows:
        if t.split():
            d = next((k for k, v in M.DOMAINS.items() if s in v), "other")
            leaves[d, lang or "", s or ""] += tokens(t)
    budget = sum(leaves.values()) * M.BUDGET_PERCENT // 100
    cap = {k: v * M.MAX_EPOCHS for k, v in leaves.items()}
    weight = (lambda x: M.DOMAIN_WEIGHTS[x], lambda x: M.LANG_WEIGHTS.get(x, M.LANG_WEIGHTS[""]), lambda x: M.SOURCE_WEIGHTS.get(x, M.SOURCE_WEIGHTS[""]))

    def down(prefix, b):
        if len(prefix) == 3:
            return {prefix: b}
        kids = {k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix}
        caps = {c: sum(v for k, v in cap.items() if k[: len(prefix) + 1] == (*prefix, c)) for c in kids}
        got = fill({c: weight[len(prefix)](c) for c in kids}, caps, b)
        return {k: v for c in kids for k, v in down((*prefix, c), got[c]).items()}

    want = down((), budget)
    got = defaultdict(int)
    longest = defaultdict(int)
    for r in M.mix(df, plan=True).collect():
        got[r.domain, r.lang, r.source] += r.n_tokens
        longest[r.domain, r.lang, r.source] = max(longest[r.domain, r.lang, r.source], r.n_tokens)
    for k, v in want.items():
        # never more than the budget; less by the document that did not fit, at most
        assert got[k] <= v + 1e-6
        most = max(tokens(t) for _, t, lang, s, _ in rows if (lang or "", s or "") == k[1:])
        assert got[k] >= v - 2 * most - 3


def test_rows_repeat_and_extra_columns_stay(make):
    df = make(corpus(50), clash=True)
    out = M.mix(df, budget_percent=250)
    assert out.columns == df.columns
    assert out.count() > df.count()
    assert M.mix(make([])).count() == M.mix(make([]), plan=True).count() == 0
    assert out.filter(F.col("h") != "kept").count() == 0


def test_text_without_blanks_has_its_tokens(make):
    text = "漢字仮名交じり文" * 500
    (row,) = M.mix(make([doc(1, text)]), plan=True, budget_percent=100, max_epochs=1).collect()
    assert row.n_tokens == tokens(text) > 3000
