import random

import numpy as np
import pytest

from parchmint.llm import cotrain


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + rng.choice(["", "a", "us"]) for _ in range(rng.randrange(10, 80))]
        good = rng.random() < 0.75
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [x for w in words for x in (w, "|")], [w for w in words[:5] for _ in range(9)], [w + "%%%" for w in words]])
        rows.append((i, " ".join(words) + ("." if good else ""), rng.choice(["en", "fr"]), f"src{rng.randrange(5)}", int(good)))
    return rows


def test_held_out_accuracy_and_filter(spark, odd, none):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = cotrain.train(docs, labels)
    assert sum(map(sum, model.exchanged)) > 20
    truth = {r[0]: r[4] for r in rows if r[0] % 2 == 0}
    got = {r.doc_id: r for r in cotrain.score(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, y in truth.items()]) > 0.95
    kept = {r.doc_id for r in cotrain.keep_good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}
    assert len(cotrain.score(odd, model).collect()) == 10
    assert cotrain.keep_good(odd, model).columns == odd.columns
    assert cotrain.score(none, model).collect() == [] and cotrain.keep_good(none, model).collect() == []
    # Nothing to learn from: everything stays.
    assert cotrain.train(docs, labels.limit(0)) is None and cotrain.train(none, labels) is None
    assert cotrain.keep_good(odd, None).count() == 10


def brute(text, page, y, fold, rounds=cotrain.ROUNDS):
    """Co-training over whole arrays, with the labels of every row kept as it goes."""
    x = [np.array(text, np.float32).astype(float), np.array(page, np.float32).astype(float)]
    x[1] = np.array([list(r[:-2]) + [float(r[-2] == k) for k in range(cotrain.SOURCE_BUCKETS)] + [float(r[-1] == k) for k in range(cotrain.LANG_BUCKETS)] for r in x[1]])
    z = []
    for m in x:
        spread = m.std(0)
        z.append(np.hstack([(m - m.mean(0)) / np.where(spread < 1e-6, 1, spread), np.ones((len(m), 1))]))
    own = [np.where(fold, y, -1.0), np.where(fold, y, -1.0)]
    w = [np.zeros(m.shape[1]) for m in z]

    def newton(steps):
        for _ in range(steps):
            for v in (0, 1):
                rows = own[v] >= 0
                m, t = z[v][rows], own[v][rows]
                each = np.array([len(t) / 2 / (t == label).sum() for label in t])
                p = 1 / (1 + np.exp(-np.clip(m @ w[v], -30, 30)))
                ridge = np.array([cotrain.L2 * len(t)] * (len(w[v]) - 1) + [1e-9])
                h = sum(e * max(q * (1 - q), 1e-6) * np.outer(r, r) for e, q, r in zip(each, p, m)) + np.diag(ridge + 1e-9)
                w[v] = w[v] + np.clip(np.linalg.solve(h, m.T @ (each * (t - p)) - ridge * w[v]), -5, 5)

    newton(cotrain.FIRST_STEPS)
    free, exchanged = y < 0, []
    for _ in range(rounds):
        picks, given = [], [0, 0]
        for v in (0, 1):
            cells = [int(np.clip(np.floor((np.arcsinh(s) / np.arcsinh(30) + 1) / 2 * cotrain.CELLS), 0, cotrain.CELLS - 1)) for s in z[v] @ w[v]]
            for label, sign in ((1.0, 1), (0.0, -1)):
                first = int(np.floor((np.arcsinh(np.log(19)) / np.arcsinh(30) + 1) / 2 * cotrain.CELLS)) + 1
                sure = [i for i in np.flatnonzero(free) if (cells[i] if sign > 0 else cotrain.CELLS - 1 - cells[i]) >= first]
                got = []
                for cell in sorted({cells[i] for i in sure}, reverse=sign > 0):
                    if len(got) >= free.sum() * cotrain.SHARE:
                        break
                    got += [i for i in sure if cells[i] == cell]
                picks.append((1 - v, label, got))
                given[v] += len(got)
        if not any(given):
            exchanged.append(tuple(given))
            break
        for v, label, got in picks:
            own[v][got] = label
        for _, _, got in picks:
            free[got] = False
        exchanged.append(tuple(given))
        newton(cotrain.STEPS)
    return exchanged, w


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    n = 600
    hidden = rng.integers(0, 2, n)
    sign = hidden[:, None] * 2 - 1
    text = np.hstack([sign * 1.2 + rng.normal(0, 0.7, (n, 3)), rng.normal(0, 1, (n, 9))]).astype(np.float32)
    page = np.hstack([sign + rng.normal(0, 0.5, (n, 2)), rng.normal(0, 1, (n, 3)), rng.integers(0, 3, (n, 1)), rng.integers(0, 2, (n, 1))]).astype(np.float32)
    y = np.where(np.arange(n) < 200, hidden, -1).astype(float)
    fold = np.arange(n) % 5 != 0
    rows = [(float(a), bool(f), [float(v) for v in t], [float(v) for v in p]) for a, f, t, p in zip(y, fold, text, page)]
    frame = spark.createDataFrame(rows, "y double, fold boolean, text_view array<float>, page_view array<float>").repartition(parts)
    model = cotrain.fit(frame)
    exchanged, weights = brute(text, page, y, fold)
    assert model.exchanged == exchanged and sum(map(sum, exchanged)) > 100
    for view, w in zip(model.views, weights):
        assert np.allclose(view.weights, w, atol=1e-6)
    both = model.scores(text.astype(float), cotrain._dense(page.astype(float)))[2]
    assert np.mean((both >= 0.5) == hidden) > 0.95
    assert cotrain.fit(frame.limit(0)) is None and cotrain.fit(frame.where("y < 1")) is None


def test_ties_repeats_and_contradictions(spark):
    """Equal rows get equal pseudo-labels, a contradicted doc_id has no label, and one doc_id may hold most rows."""
    rows = corpus(200)
    docs = [r[:4] for r in rows] + [(7, "THE!! SAME!! TEXT!!", "en", "src0")] * 300 + [(None, rows[3][1], "en", "src1")] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] != 7] + [(7, 0), (7, 1), (8, rows[8][4])], "doc_id long, quality int")
    found = cotrain.features(frame, labels)
    assert found.count() == len(docs) and found.where("y >= 0").count() == 199
    model = cotrain.fit(found)
    assert model is not None and len(cotrain.score(frame, model).collect()) == len(docs)


@pytest.mark.parametrize("text", [None, "", " \n ", "x", "é" * 1000, "a\x00b", "| | |\n\n|"])
def test_features_are_finite(text):
    assert np.isfinite(cotrain.text_view(text)).all() and np.isfinite(cotrain.page_view(None, None, text)).all()
    assert len(cotrain.text_view(text)) == 12 and len(cotrain.page_view("en", "s", text)) == len(cotrain.page_view(None, None, None))
