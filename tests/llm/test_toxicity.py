import random

import numpy as np
import pytest

from parchmint.llm import toxicity


@pytest.fixture(scope="module")
def model():
    """A language model of a few English words."""
    text = " ".join(["idiot moron trash stupid loser clown pathetic worthless disgusting scum the and hello world letter better added noon"] * 40)
    s = toxicity.symbols(f" {text} ").astype(int)
    return toxicity.CharModel(np.bincount((s[:-2] << 10) | (s[1:-1] << 5) | s[2:], minlength=toxicity._ALL))


@pytest.mark.parametrize(
    ("token", "word"),
    [("1d1ot", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("stuuuupid", "stupid"), ("l0s3r", "loser"), ("i.d.i.o.t", "idiot"), ("cl0wn!!!", "clown"), ("p4th3t1c", "pathetic"),
     ("hello", "hello"), ("letter", "letter"), ("noon", "noon"), ("%%%", ""), ("athe***", "athe"), ("5tup1d", "stupid"), ("7#3", "the")],
)
def test_restore_word(model, token, word):
    assert toxicity.restore_word(token, model) == word


def test_restore_text(model):
    assert toxicity.restore("Hello I D I O T, and 5cum\n", model) == "hello idiot and scum"
    assert toxicity.restore(None, model) == toxicity.restore("  ", model) == ""


def test_spacing_is_decoded(model):
    """Blanks within words are dropped by the lattice, wherever they stand; between words they stay."""
    assert toxicity.restore("st upid stu pid", model) == "stupid stupid"
    assert toxicity.restore("the s t u p i d world", model) == "the stupid world"
    assert toxicity.restore("hello the letter and world", model) == "hello the letter and world"
    assert "stupid" in model.decode("s 7 u p 1 d").split()


def test_signs_alone_and_at_the_edges(model):
    """Tokens without any plain letter, and signs that stand for a word's first or last letter."""
    assert "the" in toxicity.readings("7#3", model) and "idiot" in toxicity.readings("1d107", model)
    assert {"trash", "rash"} & set(toxicity.readings("+rash", model)) == {"trash", "rash"}
    assert toxicity.readings("(clown)", model)[0] == "clown" and toxicity.readings("world.", model) == ("world",)


def test_very_long_tokens(model):
    import time

    began = time.time()
    for token in ("stuuupid" * 60_000, "1d10t" * 40_000, "a " * 100_000):
        assert len(model.decode(token)) >= 100_000
    assert time.time() - began < 60


def test_decode_is_the_best_path(model):
    """Viterbi against all paths of short lattices."""
    rng = random.Random(1)

    def paths(token):
        runs = []
        for c in token:
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        found = [("", 0.0)]
        for c, n in runs:
            if c == " ":
                options = [(" ", 0.0), ("", toxicity.SPACED)]
            elif c in toxicity.LEET:
                options = [(x * k, toxicity.SUBSTITUTED * n + (0 if k == n else toxicity.HELD)) for x in toxicity.LEET[c] for k in {1, min(n, 2)}] + [("", toxicity.INSERTED * n), (c * n, 0.0)]
            elif not c.isalnum():
                options = [("", toxicity.INSERTED / 2), (c * n, 0.0)]
            else:
                options = [(c, toxicity.HELD), (c * 2, toxicity.HELD), (c * n, 0.0)] if n > 2 else [(c * n, 0.0)]
            found = [(t + a, s + cost) for t, s in found for a, cost in options]
        return found

    def score(text, cost):
        x = y = 0
        for d in text:
            z = toxicity.symbol(d)
            cost += model.logp[x][y][z] if z or d == " " else toxicity.KEPT
            x, y = y, z
        return cost + model.logp[x][y][0]

    for _ in range(150):
        token = "".join(rng.choices("idotmrn10@3s$5* ", k=rng.randrange(1, 7)))
        best = max(score(t, c) for t, c in paths(token))
        got = model.decode(token)
        assert max(score(t, c) for t, c in paths(token) if t == got) == pytest.approx(best)


def test_trigram_counts(spark, make):
    texts = ["ab a", None, "É!b"]
    counts = toxicity.trigram_counts(make(enumerate(texts)))
    want = np.zeros(toxicity._ALL, int)
    for t in texts:
        s = toxicity.symbols(f" {t or ''} ").astype(int)
        for a, b, c in zip(s, s[1:], s[2:]):
            want[(a << 10) | (b << 5) | c] += 1
    assert (counts == want).all()


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ta") for b in ("ren", "sol", "ver") for c in ("an", "os", "it", "ul")]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgak", "z0rgak", "zorgaaaak", "vlimp"]) + rng.choice(["", "en", "ul"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark, make, odd, none):
    rows = corpus()
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    trained = toxicity.train(docs, labels)
    truth = {i: y for i, _, y in rows}
    held = [r for r in toxicity.score(docs, trained).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if toxicity.fold(i) == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    got = toxicity.score(odd, trained).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.score(none, trained).collect() == []
    # Without labels nothing is evidence.
    untaught = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, untaught).collect()} == {0}
    assert toxicity.train(none, labels).weights == {}


def test_evidence_against_brute_force(spark, make):
    """Counts by fold, weights and features against sets of every text's sequences."""
    import math

    rows = corpus(150)
    docs = make([(i, t) for i, t, _ in rows] + [(1000, rows[1][1]), (7, "another text under a labelled id")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 0), (3, 1)], "doc_id long, toxic int")
    trained = toxicity.train(docs, labels)
    lm = toxicity.CharModel(trained.counts)

    texts = {}
    for i, t, y in rows + [(1000, rows[1][1], 0)]:
        if toxicity.fold(i):
            texts[t] = max(texts.get(t, 0), y, int(i == 3))
    if toxicity.fold(7):
        # One text a doc_id: that of the smaller hash.
        kept = spark.createDataFrame([(rows[7][1],), ("another text under a labelled id",)], "t string").selectExpr("t", "xxhash64(t) AS k").orderBy("k").first().t
        if kept != rows[7][1]:
            texts[kept] = texts.pop(rows[7][1])
    own = {t: {g for w in t.lower().split() for r in toxicity.readings(w, lm) for g in toxicity.grams(r)} for t in texts}
    total = [sum(y == c for y in texts.values()) for c in (0, 1)]
    want = {}
    for g in set().union(*own.values()):
        c, t = (sum(g in own[x] and y == k for x, y in texts.items()) for k in (0, 1))
        w = math.log((t + 0.5) / (total[1] + 1)) - math.log((c + 0.5) / (total[0] + 1)) - 1.64 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= toxicity.MIN_TEXTS and w > 0.5:
            want[g] = w
    assert want.keys() <= trained.weights.keys() and len(want) > 10
    assert all(trained.weights[g] == pytest.approx(w) for g, w in want.items())
    evidence = toxicity.Evidence(lm, trained.weights)
    for t in list(texts)[:40]:
        values = [max([trained.weights.get(g, 0.0) for r in toxicity.readings(w, lm) for g in toxicity.grams(r)], default=0.0) for w in t.lower().split()]
        got = evidence.features(t)
        assert got[0] >= max(values) - 1e-12 and got[1] >= math.log1p(sum(values)) - 1e-9


def test_labels_of_the_held_out_fold_are_never_seen(spark, make):
    rows = corpus(200)
    docs = make([(i, t) for i, t, _ in rows])
    frame = lambda flip: spark.createDataFrame([(i, 1 - y if flip and toxicity.fold(i) == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = toxicity.train(docs, frame(False)), toxicity.train(docs, frame(True))
    assert a.weights == b.weights and (a.logistic == b.logistic).all()
