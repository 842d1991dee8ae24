import hashlib
import random

import numpy as np
import pytest

from parchmint.llm import spotsigs


def brute_signatures(text):
    import re

    import xxhash

    words = re.findall(r"[^\W_]+", (text or "").lower())
    found, last = [], -spotsigs.GAP
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS or i - last == spotsigs.GAP:
            last = i
            found.append(f"{w} {' '.join([x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN])}")
    return sorted({xxhash.xxh32_intdigest(x) for x in found})


def texts(n=40, seed=1):
    rng = random.Random(seed)
    words = ["the", "a", "of", *(f"w{k}" for k in range(30))]
    return [" ".join(rng.choices(words, k=rng.randrange(200))) for _ in range(n)] + [None, "", "the", "Ünï_cödé 😀 the x", " ".join(f"v{k}" for k in range(30)), "the " * 20]


def test_signatures():
    for t in texts():
        assert spotsigs.signatures(t).tolist() == brute_signatures(t)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.8, 1.0])
def test_pruned_jaccard(threshold):
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 900, rng.integers(0, 700)).astype(np.uint32) * 4_000_000)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 900, rng.integers(0, 60)).astype(np.uint32) * 4_000_000]))
        whole = len({*a.tolist()} & {*b.tolist()}) / len({*a.tolist()} | {*b.tolist()}) if len(a) or len(b) else 1.0
        assert spotsigs.jaccard(a, b, threshold) == pytest.approx(whole if whole >= threshold - 1e-12 else 0.0)
        if whole >= threshold > 0 and threshold < 1:
            assert abs(spotsigs.length_class(len(a), threshold) - spotsigs.length_class(len(b), threshold)) <= 1


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        sets = [set(brute_signatures(x)) for x in (t, half, following)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] or s else 1.0 for s in sets[1:]]
        out.append((i, len(t), hashlib.sha256(half.encode()).hexdigest(), *("".join(f"{x:08x}" for x in sorted(s)) for s in sets[:2]), *like))
    return out


@pytest.mark.parametrize("n", [1, 2, 46])
def test_edited_and_next(make, n):
    rows = list(zip(random.Random(2).sample(range(-50, 1000), 46), texts(), strict=True))[:n]
    assert sorted(tuple(r)[:7] for r in spotsigs.near_duplicates(make(rows)).collect()) == brute(rows)


def test_hot_doc_ids(make, spark):
    """One doc_id and the null one hold two thirds of the rows: they get several ranges, and each text one next."""
    rows = [(k, f"the plain w{k}") for k in range(100)] + [(50, f"the same id x{k}") for k in range(150)] + [(None, f"the id is null {k}") for k in range(150)]
    docs = make(rows).repartition(4)
    got = spotsigs.near_duplicates(docs).collect()
    assert len(got) == 400
    ids = spotsigs._sets(docs).select("doc_id", "version", "id")
    parts = spotsigs.Parts(ids, 32)
    from pyspark.sql import functions as F

    sizes = {r.p: r["count"] for r in ids.select(parts.of(F.col("doc_id"), F.col("version")).alias("p")).groupBy("p").count().collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 60
    # Each edited text holds the start of the next text in the order of doc_id and version.
    order = sorted(((r.doc_id is None, r.doc_id or 0, r.version), r.text) for r in spotsigs._plain(docs).collect())
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 400][1][: len(t) // 2]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want


def test_odd_rows(odd, none):
    got = spotsigs.near_duplicates(odd).collect()
    assert len(got) == 10 and spotsigs.near_duplicates(none).collect() == []
    assert all(r.fingerprint == "" and r.n_chars in (0, 4) for r in got if r.doc_id in (2, 3, 4))
    equal = {}
    for r in got:
        equal.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(equal[38]) == 1
    assert {r.n_chars for r in spotsigs.fingerprints(odd).collect()} == {r.n_chars for r in got}


def test_near_duplicates_anywhere(make, monkeypatch):
    """Near-copies far apart, of several lengths, hot sets and equal ones, against all pairs."""
    rng = random.Random(3)
    base = [" ".join(rng.choices(["the", "a", "of", *(f"w{k}" for k in range(400))], k=rng.choice([3, 12, 60, 300]))) for _ in range(60)]
    rows = list(enumerate(base + [None, "", "the"]))
    for k in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 3, 8])):
            words.insert(rng.randrange(len(words)), f"new{rng.randrange(99)}")
        rows.append((1000 + k, " ".join(words)))
    hot = "the red fox of a long tale and the blue bird of the old tree in a deep wood with the grey wolf " * 2
    rows += [(2000 + k, f"{hot} the end{k}") for k in range(30)]
    sets = [(i, set(brute_signatures(t))) for i, t in rows]
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    want = {i: [j for j, t in sets if j != i and like(s, t) >= 0.8 - 1e-12] for i, s in sets}
    got = {r.doc_id: r for r in spotsigs.near_duplicates(make(rows)).collect()}
    assert {i: (r.n_near, r.first_near) for i, r in got.items()} == {i: (len(x), min([i, *x])) for i, x in want.items()}
    assert sum(any(abs(i - j) > 1 for j in x) for i, x in want.items()) > 60
    assert sorted(tuple(r)[:7] for r in got.values()) == brute(rows)
    # Small parts and small matrices: the same.
    monkeypatch.setattr(spotsigs, "MATRIX_CELLS", 64)
    sets = spotsigs._sets(make(rows))
    ids = {r.doc_id: r.id for r in sets.collect()}
    found = {r.id: (r.n_near, r.first_near) for r in spotsigs.near_sets(sets, split=3).collect()}
    assert {i: found.get(ids[i], (0, i)) for i in want} == {i: (len(x), min([i, *x])) for i, x in want.items()}
