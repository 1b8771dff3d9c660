import random

import numpy as np

from lodestrata.llm.toxicity import buckets, fit, gradients, grade_documents, train


def texts(n, grades, seed):
    rng = random.Random(seed)
    marks = [[], ["rude", "dumb"], ["vile", "scum"], ["menace", "hate"]]
    out = []
    for i in range(n):
        g = rng.choice(grades)
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))] + marks[g]
        rng.shuffle(words)
        out.append((i, " ".join(words).title(), g))
    return out


def test_orders_and_accuracy():
    rows = texts(1500, [0, 0, 0, 1, 2, 3], 1)
    model = fit([(g, buckets(t).tolist(), 1.0) for _, t, g in rows])
    assert (np.diff(model.cuts) > 0).all()
    held = texts(500, [0, 0, 0, 1, 2, 3], 2)
    score = np.array([sum(model.w.get(b, 0.0) for b in buckets(t)) for _, t, _ in held])
    severity, grade = model.severity(score)
    y = np.array([g for *_, g in held])
    assert (grade == y).mean() > 0.9 and np.abs(severity - y).mean() < 0.4


def test_tables(spark):
    rows = texts(600, [0, 0, 0, 0, 1], 3)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t, _ in rows] + [(900, None, "x", 0), (901, "", "x", 0), (3, rows[3][1], "x", 0)], "doc_id long, text string, severity string, grade int")
    labels = spark.createDataFrame([(i, g, "t") for i, _, g in rows if i % 2] + [(1, None, "t"), (None, 1, "t")], "doc_id long, toxic int, text string")
    out = grade_documents(docs, train(docs, labels))
    got = out.collect()
    assert len(got) == 603 and set(out.columns) == {"doc_id", "text", "severity", "grade"}
    y = {i: g for i, _, g in rows}
    assert sum((r.grade > 0) == (y.get(r.doc_id, 0) > 0) for r in got) >= 600
    none = grade_documents(docs, train(docs, labels.limit(0))).collect()
    assert {(r.severity, r.grade) for r in none} == {(0.0, 0.0)}
    assert grade_documents(docs.limit(0), train(docs, labels)).collect() == []


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(2)
    for k in (2, 3, 5):
        eta, y, s, cuts = rng.normal(0, 2, 40), rng.integers(0, k, 40), rng.random(40), np.sort(rng.normal(0, 1.5, k - 1)) + np.arange(k - 1) * 0.3
        _, de, dc = gradients(eta, y, s, cuts)
        loss = lambda e, c: gradients(e, y, s, c)[0]  # noqa: E731, B023
        near = lambda f, x, i: (f(x + 1e-5 * np.eye(len(x))[i]) - f(x - 1e-5 * np.eye(len(x))[i])) / 2e-5
        assert np.allclose([near(lambda e: loss(e, cuts), eta, i) for i in range(40)], de, atol=1e-6)  # noqa: B023
        assert np.allclose([near(lambda c: loss(eta, c), cuts, i) for i in range(k - 1)], dc, atol=1e-6)  # noqa: B023


def test_fit_against_plain_gradient_descent():
    """The sparse fit is close to a dense one by full gradients over the same features."""
    rows = texts(400, [0, 0, 1, 2], 5)
    xs = [buckets(t) for _, t, _ in rows]
    y = np.array([g for *_, g in rows])
    model = fit([(g, x, 1.0) for (_, _, g), x in zip(rows, xs)])
    every = np.unique(np.concatenate(xs))
    dense = np.stack([np.isin(every, x) for x in xs]).astype(float)
    w, cuts = np.zeros(len(every)), np.array([0.0, 1.0])
    for _ in range(300):
        _, de, dc = gradients(dense @ w, y, np.full(len(y), 1 / len(y)), cuts)
        w -= 0.5 * dense.T @ de
        cuts = cuts - 0.5 * dc
    ours = np.array([sum(model.w.get(int(b), 0.0) for b in x) for x in xs])
    assert np.corrcoef(ours, dense @ w)[0, 1] > 0.9
    assert (model.severity(ours)[1] == y).mean() >= (((dense @ w)[:, None] > cuts).sum(axis=1) == y).mean() - 0.02


def test_several_labels_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "w1 w2 rude dumb"), (1, "rude " * 60_000), (2, "w3"), (2, "w3 w4")] + [(10 + i, t) for i, t, _ in texts(200, [0, 1], 8)], "doc_id long, text string")
    labels = spark.createDataFrame([(10 + i, g) for i, _, g in texts(200, [0, 1], 8)] + [(2, 0), (2, 1), (1, None)], "doc_id long, toxic int")
    got = grade_documents(docs, train(docs, labels)).collect()
    assert len(got) == 204 and {r.grade for r in got if r.doc_id is None or r.doc_id == 1} == {1.0}
