import math
import random
from collections import Counter

import numpy as np
import pytest

from parchmint.llm import common
from parchmint.llm import masked_lm as lm


def random_network(seed=1):
    rng = np.random.default_rng(seed)
    vocab = lm.Vocabulary([f"w{i}" for i in range(lm.KNOWN)], rng.integers(1, 99, lm.PAD).astype(float))
    net = lm.Network.start(vocab)
    net.to_word[:] = rng.normal(0, 0.3, net.to_word.shape)
    net.to_class[:] = rng.normal(0, 0.3, net.to_class.shape)
    return vocab, net, rng


def test_probabilities_sum_to_one():
    _, net, rng = random_network()
    for context in rng.integers(0, lm.PAD + 1, (3, 4)):
        assert np.exp(net.log_probability(np.repeat(context[None], lm.PAD, 0), np.arange(lm.PAD))).sum() == pytest.approx(1, abs=1e-4)


def test_gradient():
    _, net, rng = random_network()
    flat = net.flat.astype(np.float64)
    context, target = rng.integers(0, lm.PAD + 1, (40, 4)), rng.integers(0, lm.PAD, 40)
    g = lm.Network(flat).gradient(context, target).flat
    loss = lambda x: -lm.Network(x).log_probability(context, target).mean()
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-6), 15):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        assert (loss(flat + e) - loss(flat - e)) / 2e-5 == pytest.approx(g[i], rel=1e-3)


def test_scores_equal_one_by_one():
    vocab, net, rng = random_network()
    texts = ["w1 w2 w3 w1", None, "", "w9", "unknown w7 words " * 30, "w5 " * 30_000]
    ids = [vocab.ids().encoded(t)[0] for t in texts]
    for own, found, text in zip(ids, lm.score_ids(ids, vocab, net), texts, strict=True):
        padded = [lm.PAD] * 2 + own.tolist() + [lm.PAD] * 2
        inner = min(len(own), 200)
        want = [net.log_probability(np.array([[*padded[k : k + 2], *padded[k + 3 : k + 5]]]), np.array([i]))[0] - (np.log(vocab.counts[i] + 1) if i >= lm.KNOWN else 0) for k, i in enumerate(own.tolist()[:inner])]
        if inner < len(own):
            # One word over and over: all windows but the outermost are alike.
            want = want[:2] + [want[2]] * (len(own) - 4) + [net.log_probability(np.array([[*padded[k : k + 2], *padded[k + 3 : k + 5]]]), np.array([own[-1]]))[0] for k in (len(own) - 2, len(own) - 1)]
        assert len(own) == len(lm.tokens_of(text)) and found == pytest.approx(sum(map(float, want)), rel=1e-5, abs=1e-2)


def test_a_task_trains_as_a_plain_loop_does(spark):
    """One phase of two tasks, target by target: gradients from finite sums of softmaxes, Adagrad, the weighted average."""
    vocab, net, rng = random_network()
    parts = [[rng.integers(0, lm.PAD, n).astype("<u2") for n in sizes] for sizes in ((30, 0, 5), (12,))]

    def slow(texts):
        flat, squares = net.flat.astype(float).copy(), np.full(lm.Network.SIZE, 1e-3)
        m, g = lm.Network(flat), lm.Network(np.zeros(lm.Network.SIZE))
        n = sum(map(len, texts))
        for ids in texts:
            padded = [lm.PAD] * 2 + ids.tolist() + [lm.PAD] * 2
            for k, target in enumerate(ids.tolist()):
                around = padded[k : k + 2] + padded[k + 3 : k + 5]
                pooled = sum(m.embed[c] * m.side[i] for i, c in enumerate(around))
                h = np.tanh(pooled @ m.dense + m.shift)
                c, w = divmod(target, lm.MEMBERS)
                back = 0
                for weights, bias, at, gw, gb in ((m.to_class, m.class_bias, c, g.to_class, g.class_bias), (m.to_word[c], m.word_bias[c], w, g.to_word[c], g.word_bias[c])):
                    e = np.exp(weights @ h + bias)
                    d = e / e.sum()
                    d[at] -= 1
                    gw += np.outer(d, h) / n
                    gb += d / n
                    back = back + d @ weights / n
                back = back * (1 - h * h)
                g.dense += np.outer(pooled, back)
                g.shift += back
                back = m.dense @ back
                for i, x in enumerate(around):
                    g.side[i] += m.embed[x] * back
                    g.embed[x] += back * m.side[i]
        squares += g.flat**2
        return (flat - lm.RATE * g.flat / np.sqrt(squares)) * n, n

    want, n = map(sum, zip(*map(slow, parts)))
    frame = spark.createDataFrame([(bytes(x.tobytes()),) for p in parts for x in p], "ids binary")
    frame = spark.sparkContext.parallelize([[bytes(x.tobytes()) for x in p] for p in parts], 2).flatMap(lambda p: [(x,) for x in p]).toDF(frame.schema)
    got = common.total(frame.mapInArrow(lm._train(net.flat), lm.PARTIAL))
    assert got[-1] == n == 47 and np.allclose(got[:-1] / n, want / n, atol=2e-5)


def test_training_beats_unigrams_and_order_matters(make, odd, none):
    rng = random.Random(1)
    docs = [" ".join(w for _ in range(rng.randrange(20, 60)) for w in rng.choice([("red", "fox", "runs"), ("blue", "bird", "sings"), ("old", "tree", "stands")])) for _ in range(800)]
    frame = make(enumerate(docs)).repartition(3)
    vocab, net = lm.train(frame, rounds=6)
    want = Counter(w for d in docs for w in d.split())
    assert dict(zip(vocab.words, vocab.counts[: len(vocab.words)].tolist(), strict=True)) == want
    ids, start = vocab.ids(), lm.Network.start(vocab)
    per = lambda n, ts: sum(lm.score_ids([ids.encoded(t)[0] for t in ts], vocab, n)) / sum(len(t.split()) for t in ts)
    shuffled = [" ".join(rng.sample(d.split(), len(d.split()))) for d in docs]
    assert per(net, docs) > per(start, docs) + 0.2 and per(net, docs) > per(net, shuffled) + 0.2
    got = lm.score(odd, vocab, net).collect()
    assert len(got) == 10 and all(r.log_likelihood <= 0 for r in got)
    assert all((r.n_tokens, r.log_likelihood, r.per_token) == (0, 0.0, None) for r in got if r.doc_id in (2, 3, 4))
    assert lm.score(none, vocab, net).collect() == []
    empty, untaught = lm.train(none)
    assert empty.words == [] and np.isfinite(untaught.flat).all()


def test_every_token_is_a_target(make):
    docs = make([(1, "one"), (2, " ".join(f"w{i}" for i in range(1000))), (3, None), (4, "a b c d e f g h i"), (5, "x " * 300_000)]).repartition(2)
    vocab = lm.vocabulary(docs)
    coded, net = lm.encode(docs, vocab), lm.Network.start(vocab)
    targets = [common.total(coded.where(f"phase = {k}").select("ids").mapInArrow(lm._train(net.flat), lm.PARTIAL)) for k in range(lm.PHASES)]
    assert sum(t[-1] for t in targets if t is not None) == 301_010


def test_rarer_words_keep_their_counts(make):
    """Two words of one bucket, and one never seen."""
    once, never = [w for w in (f"x{j}" for j in range(9999)) if lm.bucket_of(w) == lm.bucket_of("often")][:2]
    docs = [(i, " ".join(f"k{j}" for j in range(lm.KNOWN))) for i in range(5)] + [(9, f"often often {once} often often")]
    vocab = lm.vocabulary(make(docs))
    assert len(vocab.words) == lm.KNOWN and "often" not in vocab.words
    net = lm.Network.start(vocab)
    got = {r.doc_id: r for r in lm.score(make([(1, "often"), (2, once), (3, never), (4, "k1"), (5, ""), (6, f"often {once} often")]), vocab, net).collect()}
    alone = net.log_probability(np.full((1, 4), lm.PAD), np.array([lm.KNOWN + lm.bucket_of("often")]))[0]
    assert got[1].log_likelihood == pytest.approx(alone + math.log(4 / 6), abs=1e-4)
    assert got[2].log_likelihood == got[3].log_likelihood == pytest.approx(alone + math.log(1 / 6), abs=1e-4)
    assert got[4].per_token == got[4].log_likelihood < 0 and got[5].per_token is None
    assert got[6].n_tokens == 3 and got[6].log_likelihood == pytest.approx(3 * alone + 2 * math.log(4 / 6) + math.log(1 / 6), abs=0.02)
