import itertools
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import xxhash

from parchmint.llm import common, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    links = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    label = list(range(len(fps)))
    for _ in fps:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label, links


def test_fingerprint():
    for text in ("", None, "one", "One two", "A b\x0bC\x1cd e É", "x y z w", " ".join(map(str, range(3000)))):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_trie_links_equal_brute_force():
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({near(rng, s, rng.randrange(6)) for s in seeds for _ in range(12)})
    keys = np.array(fps, np.uint64)
    got = {tuple(sorted(p)) for u, v in simhash.trie_links(keys, None, np.array([[0, len(keys), 0, len(keys)]])) for p in zip(u.tolist(), v.tolist(), strict=True)}
    assert got == set(brute_components(fps)[1])


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    # A chain of near fingerprints, a large group of them, strangers, and fingerprint zero.
    chain = [seeds[0]]
    for _ in range(12):
        chain.append(near(rng, chain[-1], 3))
    fps = [*chain, *(near(rng, seeds[1], rng.randrange(4)) for _ in range(60)), *seeds, 0, 0, 1, seeds[3], seeds[3]]
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i, 0, np.uint64(f).astype(np.int64).item()) for i, f in zip(ids, fps, strict=True)], "doc_id long, version long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    label, links = brute_components(fps)
    first = {k: min(i for i, x in zip(ids, label, strict=True) if x == k) for k in set(label)}
    linked = {f: len({g for a, b in links for g in (fps[a], fps[b]) if f in (fps[a], fps[b]) and g != f}) for f in fps}
    for split in (simhash.SPLIT, 4):
        got = {r.doc_id: (r.fingerprint, r.component_id, r.n_links) for r in simhash.near_duplicates(rows, split).collect()}
        assert got == {i: (f"{f:016x}", first[k], linked[f]) for i, f, k in zip(ids, fps, label, strict=True)}


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {2: 2, 3: 2, 4: 2, None: 2}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # One row of a group; both texts of id 1 are groups of their own.
    assert sorted((r.doc_id or 0, r.text[:9] if r.text else r.text) for r in kept.collect()) == sorted([(1, "the cat s"), (1, "another t"), (2, None), (0, "a text wi"), (5, "w0 the w1"), (6, "é")])
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


def test_rows_without_any_id(make):
    rows = simhash.near_duplicates(make([(None, "a b c d"), (None, "a b c d")])).collect()
    assert [r.component_id for r in rows] == [None, None]
    assert simhash.keep_one(make([(None, "a b c d"), (None, "a b c d")])).count() == 1


def test_query_on_fixture(spark, make, tmp_path):
    from parchmint.llm.queries import queries

    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]] + texts[:5] + [None, ""]
    make(enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op3_simhash_trie_join"](spark, str(tmp_path)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    label, _ = brute_components(fps)
    assert got == {i: (f"{f:016x}", k) for i, (f, k) in enumerate(zip(fps, label, strict=True))}


def test_few_files_for_few_rows(spark, make):
    """Checkpoints have the files that their rows need, however many shuffle partitions there are."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(30)]
    texts += [t + " w1" for t in texts[:20]] + texts[:10] + [texts[0]] * 20
    docs = make(list(enumerate(texts))).repartition(3)
    rounds = [(i, i + 1) for i in range(40)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    # The folder is set once a session; what is new in it counts.
    root = simhash.cut_lineage(spark.range(1)).sparkSession.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    files = lambda: {str(f) for f in Path(root).rglob("part-*")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 37)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        before = files()
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
        made = Counter(str(Path(f).parent) for f in files() - before)
        assert made and max(made.values()) <= 3
        stars = common.connected_components(spark.createDataFrame(rounds, "a long, b long"), files=common.files_for(spark, len(rounds)))
        assert {tuple(r) for r in stars.collect()} == {(i, 0) for i in range(41)}
        assert max(Counter(str(Path(f).parent) for f in files() - before).values()) <= 3
        assert [common.files_for(spark, n) for n in (0, 1, common.FILE_ROWS, common.FILE_ROWS + 1, 1 << 40)] == [1, 1, 1, 2, 37]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(brute_components([brute_fingerprint(t) for t in texts])[0]))
