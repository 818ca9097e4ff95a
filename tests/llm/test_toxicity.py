import numpy as np
import pytest

from millrace.llm import toxicity as X

from .conftest import ODD, doc

CLEAN = "the river runs past hills and quiet towns while people walk along its banks and talk of work".split()
BAD = ["idiot", "moronic", "moronisch", "vequlon", "vequmar"]


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [" ".join(rng.choice(CLEAN, 9)) for _ in range(int(rng.integers(2, 6)))]
        toxic = i % 5 == 0
        if toxic:
            words[0] += " " + str(rng.choice(BAD)) + (" women" if i % 2 else "")
        docs.append(doc(i, ". ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark, make):
    docs, labels = corpus()
    return X.fit(make(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out(make, fitted):
    docs, labels = corpus(seed=2)
    kept = {r.doc_id for r in X.drop_toxic(make(docs), fitted).collect()}
    right = sum((i in kept) != bool(t) for i, t in labels)
    assert right >= 0.99 * len(labels)


def test_new_endings_of_known_stems(fitted):
    assert X.score_text("all of vequtis here", fitted) >= fitted["threshold"]


def test_neutral_mentions_of_groups(make, fitted):
    rows = [doc(i, f"the {g} walk along the river and talk of work") for i, g in enumerate(("women", "men", "girls", "muslims", "jews"))]
    assert X.drop_toxic(make(rows), fitted).count() == len(rows)


def test_penalty_takes_the_weight_off_identity_terms():
    # feature 0 is an identity term that is common in toxic rows, 1 its sibling, 2 a real insult
    x = [[0, 2]] * 30 + [[0]] * 6 + [[2]] * 10 + [[1]] * 30
    y = np.array([1] * 30 + [1] * 6 + [1] * 10 + [0] * 30)
    plus, minus = [[1]] * 36, [[0]] * 36
    w, _ = X.fit_logistic(x, y, [], [], 3, 0)
    fair, _ = X.fit_logistic(x, y, plus, minus, 3, 10.0)
    assert abs(fair[0] - fair[1]) < 0.15 * abs(w[0] - w[1])
    assert fair[2] > 0


def brute_fit(docs, y, plus, minus, n, fairness, rounds):
    """The same loss and optimiser in plain numbers: documents are lists of sentences, those lists of features."""
    w, b, m, v = [0.1] * n, 0.0, [0.0] * (n + 1), [0.0] * (n + 1)
    many = [max(1, y.count(0)), max(1, y.count(1))]
    for t in range(1, rounds + 1):
        g = [2 * X.L2 * k for k in w] + [0.0]
        for sentences, label in zip(docs, y):
            z = [sum(w[i] for i in s) + b for s in sentences]
            s = sentences[z.index(max(z))]
            e = 0.5 / many[label] * (1 / (1 + np.exp(-max(z))) - label)
            g[n] += e
            for i in s:
                g[i] += e
        for p, q in zip(plus, minus):
            d = sum(w[i] for i in p) - sum(w[i] for i in q)
            for i in p:
                g[i] += 2 * fairness / len(plus) * d
            for i in q:
                g[i] -= 2 * fairness / len(plus) * d
        for i in range(n + 1):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            step = 0.1 * (m[i] / (1 - 0.9**t)) / ((v[i] / (1 - 0.999**t)) ** 0.5 + 1e-9)
            if i < n:
                w[i] -= step
            else:
                b -= step
    return w, b


def test_fit_against_brute_force():
    rng = np.random.default_rng(3)
    docs = [[sorted({int(k) for k in rng.integers(0, 7, rng.integers(1, 4))}) for _ in range(rng.integers(1, 5))] for _ in range(40)]
    y = [int(any(0 in s for s in d)) for d in docs]
    plus, minus = [[1], [2, 3], [1]], [[4], [5], []]
    owner = np.repeat(np.arange(40), [len(d) for d in docs])
    for fairness in (0.0, 10.0):
        w, b = X.fit_logistic([s for d in docs for s in d], np.array(y), plus, minus, 7, fairness, rounds=60, owner=owner)
        w2, b2 = brute_fit(docs, y, plus, minus, 7, fairness, 60)
        assert np.allclose(w, w2, atol=1e-6) and abs(b - b2) < 1e-6


def test_score_is_the_fitted_one_and_against_brute_force(fitted):
    docs, _ = corpus(60, seed=5)
    for _, t, *_ in docs:
        z = [fitted["bias"]]
        for s in X.SENTENCE.split(t.lower()):
            f = {X.known_feature(w, fitted["lifts"]) for w in X.WORD.findall(s)} - {None}
            if f:
                z.append(fitted["bias"] + sum(fitted["weights"][k] for k in f))
        want = 1 / (1 + np.exp(-np.clip(max(z), -30, 30)))
        assert abs(X.score_text(t, fitted) - want) < 1e-12


def test_without_the_penalty_neutral_mentions_are_rejected(spark, make):
    """Toxic rows that mostly name one group teach the group's name; its counterfactuals unteach it."""
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for i in range(900):
        words = list(rng.choice(CLEAN, 8))
        if i % 3 == 0:
            words += ["women"] if i % 2 or i % 9 else []
            words += [str(rng.choice(BAD))] if i % 4 else []
        elif i % 30 == 1:
            words += ["men"]
        docs.append(doc(i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [doc(i, f"{g} walk along the river and talk of work") for i, g in enumerate(("women", "men"))]
    unfair, fair = (X.fit(make(docs), labels, fairness=k) for k in (0.0, 10.0))
    gap = lambda m: abs(X.score_text(neutral[0][1], m) - X.score_text(neutral[1][1], m))
    assert X.score_text(neutral[0][1], unfair) >= 0.5 > 0.2 > gap(fair) and gap(unfair) > 0.5
    assert X.drop_toxic(make(neutral), unfair).count() < 2 == X.drop_toxic(make(neutral), fair | {"threshold": max(0.5, fair["threshold"])}).count()
    assert all(X.score_text(f"you {b} walk", fair) >= 0.5 for b in BAD)


def test_long_clean_texts_do_not_add_up(make, fitted):
    text = ". ".join(" ".join(CLEAN) for _ in range(3000))
    assert X.drop_toxic(make([doc(1, text)]), fitted).count() == 1


def test_odd_rows_and_columns(make, fitted):
    out = X.drop_toxic(make(ODD, clash=True), fitted, score=None)
    assert out.columns == make(ODD, clash=True).columns
    assert out.count() == len(ODD)
    # a column with the score's name is replaced
    out = X.drop_toxic(make(ODD, clash=True), fitted)
    assert [c for c in out.columns if c.lower() == "toxicity"] == ["toxicity"] and dict(out.dtypes)["toxicity"] == "double"
    rows = [doc(1, "all of vequtis here"), doc(1, "all of vequtis here"), doc(2, "quiet towns"), doc(2, "quiet towns")]
    assert [r.doc_id for r in X.drop_toxic(make(rows), fitted).collect()] == [2, 2]


def test_no_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    nulls = spark.createDataFrame([(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    for labels in (none, nulls):
        assert X.drop_toxic(make(ODD), X.fit(make(ODD), labels)).count() == len(ODD)
    assert X.drop_toxic(make([]), X.fit(make([]), none)).count() == 0
