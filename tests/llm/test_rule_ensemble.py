import numpy as np

from registrum.llm import rule_ensemble as R


def docs(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, f"{'BUY NOW!! ' * (3 + i % 5) if bad else 'a calm line of text that says a thing, number '}{i}", "src", 1.0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None, "s", 0.0), (1001, "", "s", 0.0), (None, "a calm line", "s", 0.0), (1002, "word " * 50_000, "s", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels + [(5, None, 1), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_shape(spark):
    d, labels = docs(spark)
    got = {r.doc_id: r for r in R.judged(d, labels).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 400]
    assert held and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.98
    assert got[None].held_out is False and got[1000].score == got[1001].score


def test_compiled_column_equals_the_model(spark):
    d, labels = docs(spark)
    model = R.learned(d, labels)
    got = R.measured(d).select("doc_id", model.column().alias("s"), *[f"{R.PREFIX}{s}" for s in R.STATISTICS]).collect()
    x = np.array([r[2:] for r in got])
    assert np.allclose(model.score(x), [r.s for r in got]) and model.rules


def test_statistics_against_a_plain_count():
    texts = [b"", b"A b\nA  A b.", "É!|*9".encode(), b"x x x"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = R.statistics(np.frombuffer(b"".join(texts), np.uint8), at)
    for t, row in zip(texts, got, strict=True):
        w = t.lower().split()
        want = [sum(b in list(c) for b in t) / max(1, len(t)) for c in R.CLASSES.values()]
        want += [sum(map(len, w)) / max(1, len(w)), sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w)), len(set(w)) / max(1, len(w)), sum(a == b for a, b in zip(w, w[2:], strict=False)) / max(1, len(w)), np.log1p(len(w)), len(w) / (1 + t.count(b"\n"))]
        assert np.allclose(row, want)


def test_one_class_or_none(spark):
    d, labels = docs(spark, 8)
    assert {r.predicted for r in R.judged(d, labels.where("quality = 1")).collect()} == {1}
    assert {r.score for r in R.judged(d, labels.limit(0)).collect()} == {0.5}
    assert R.judged(d.limit(0), labels).collect() == []


def test_fitted_weights_are_a_lasso_optimum(monkeypatch):
    """With steps enough, the loss's slope along each kept weight is the penalty, against its sign, and along the bias none; no single change of a weight does better."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, len(R.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (x[:, 5] > 1.2)).astype(float)
    y[rng.integers(0, 800, 60)] = rng.integers(0, 2, 60)
    early = R.fit(x, y)
    monkeypatch.setattr(R, "STEPS", 6400)
    model = R.fit(x, y)
    a, w = np.column_stack([R.holds(x, rule) for _, rule in model.rules]).astype(float), np.array([k for k, _ in model.rules])

    def loss(weights, bias, a=a):
        z = a @ weights + bias
        return np.mean(np.logaddexp(0, z) - y * z) + R.PENALTY * np.abs(weights).sum()

    slope = a.T @ (model.score(x) - y) / len(y)
    assert np.abs(slope + R.PENALTY * np.sign(w)).max() < 1e-4 and abs(np.mean(model.score(x) - y)) < 1e-4
    best = loss(w, model.bias)
    soon = loss(np.array([k for k, _ in early.rules]), early.bias, np.column_stack([R.holds(x, rule) for _, rule in early.rules]).astype(float))
    assert best < soon < 1.1 * best  # the production steps stop near it
    for k in range(len(w)):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(len(w)) == k), model.bias) > best - 1e-6
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9 and 3 < len(w) < 200


def test_repeated_documents_weigh_nothing_and_clashing_names_stand_apart(spark):
    texts = [(i, f"word {i} and more of it. " * 5 if i % 2 else f"### {i} !!! $$$ " * 9) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    often = spark.createDataFrame([*texts, *[texts[3]] * 5000, *[texts[4]] * 3], "doc_id long, text string")
    assert R.learned(often, labels, sample=40) == R.learned(plain, labels, sample=40)
    named = plain.selectExpr("doc_id", "text", "1 score", "'x' predicted", "2 label")
    got = R.judged(named, labels.unionByName(labels)).collect()
    assert len(got) == 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
