import math
import random
from collections import Counter

import pytest

from parchmint.llm import decontam


def items(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(3, 40))) + ". " + " ".join(rng.choices(words, k=4)) + ".") for i in range(n)]


def brute_impacts(rows):
    tf = [(i, t, Counter(decontam.words_of(t))) for i, t in rows]
    n, df = len(tf), Counter(w for _, _, c in tf for w in c)
    mean = sum(sum(c.values()) for _, _, c in tf) / n
    out = {}
    for i, t, c in tf:
        dl = sum(c.values())
        w = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)) for x, f in c.items()}
        out[i, t] = {x: v / sum(w.values()) for x, v in w.items()}
    return out


def test_impacts(spark):
    rows = items()
    got = {}
    for r in decontam.impacts(spark.createDataFrame([*rows, rows[0], (None, None), (99, " .,")], "item_id long, text string")).collect():
        got.setdefault((r.item_id, r.text), {})[r.term] = r.impact
    want = brute_impacts(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_wand_equals_exhaustive_search():
    rng = random.Random(2)
    index = decontam.Index([(i, t, w) for (i, t), w in brute_impacts(items()).items()])
    for _ in range(400):
        own = [index.terms[w] for w in index.parts[rng.randrange(60)][0] if rng.random() < 0.8]
        terms = sorted({*own, *rng.sample(range(len(index.terms)), rng.randrange(40))})
        scores = Counter()
        for t in terms:
            for n, w in zip(*index.postings[t], strict=True):
                scores[n] += w
        for threshold in (0.1, 0.4, 0.7):
            want = {n for n, s in scores.items() if s >= threshold}
            assert {n for n, _ in index.search(terms, threshold)} == want
            assert not want or index.may_match(decontam.np.array(terms, int), threshold)


def brute_hits(docs, rows, passage=decontam.PASSAGE):
    impacts, out = brute_impacts(rows), set()
    for d, text in docs:
        words = decontam.words_of(text)
        for s in range(0, max(1, len(words) - passage // 2), passage // 2):
            own = words[s : s + passage]
            for (i, t), w in impacts.items():
                if sum(w.get(x, 0) for x in set(own)) >= decontam.THRESHOLD - 1e-9:
                    parts = decontam.question_and_answer(t)
                    share = [len(decontam.shingles(p, k) & decontam.shingles(own, k)) / len(decontam.shingles(p, k)) for p in parts for k in [min(5, len(p))]]
                    if min(share) >= decontam.OVERLAP:
                        out.add((d, i))
    return out


def documents(rows, seed=3):
    rng = random.Random(seed)
    vocabulary = [w for _, t in rows for w in t.split()]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randrange(400))
        if d % 3 == 0:
            at = rng.randrange(len(words) + 1)
            leak = rows[rng.randrange(len(rows))][1].split()
            if d % 2:
                leak = leak[: len(leak) // 2]
            words[at:at] = leak
        docs.append((d, " ".join(words)))
    return docs


@pytest.mark.parametrize("shard", [decontam.SHARD_POSTINGS, 200])
def test_hits_equal_brute_force(make, spark, shard):
    rows = items()
    docs = documents(rows)
    got = decontam.contaminated(make(docs), spark.createDataFrame(rows, "item_id long, text string"), shard_postings=shard).collect()
    want = brute_hits(docs, rows)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 8


def test_clean_and_odd_rows(odd, none, spark):
    held = spark.createDataFrame([(0, "The cat sat on the mat. And the dog ran."), (1, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, held).collect()} == {(1, 0)}
    kept = decontam.clean(odd, held)
    assert kept.columns == odd.columns and kept.count() == 8
    empty = held.limit(0)
    assert decontam.contaminated(odd, empty).collect() == [] and decontam.clean(odd, empty).count() == 10
    assert decontam.contaminated(none, held).collect() == [] and decontam.clean(none, held).count() == 0
