import random

import corpus_pipeline
from parchmint.llm import decontam, linededup


def tables(spark, path, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ta", "re", "su") for b in ("ren", "sol", "ver", "dan", "pim", "tok", "lus")]
    sentence = lambda n: " ".join(rng.choices(words, k=n)) + "."
    items = [(i, f"{sentence(14)} {sentence(6)}") for i in range(8)]
    docs = []
    for i in range(160):
        lines = [sentence(rng.randrange(6, 14)).capitalize() for _ in range(rng.randrange(3, 9))]
        if i % 16 == 5:
            lines = [x.upper() + "!! !!" for x in lines]
        if i % 16 == 7:
            lines.insert(1, items[i % 8][1])
        docs.append((i, "\n".join(lines)))
    docs += [(160 + k, docs[k * 3][1]) for k in range(5)] + [(165 + k, docs[k * 3][1].replace("\n", " ", 1)) for k in range(5)] + [(170, None), (171, "")]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 16 != 5), 0) for i, _ in docs if i < 160], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(docs), items


def test_stages(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    read = lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, now, left = read().columns, read(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id: r.text for r in now.collect()})
    good, cut, single, clean = left
    junk = {i for i in docs if i < 160 and i % 16 == 5}
    assert not junk & good.keys() and len(good) >= len(docs) - len(junk) - 6
    # Line dedup against its brute force; nothing is dropped.
    from tests.llm.test_linededup import brute

    assert cut == brute(list(good.items()))[0]
    # Exact copies are gone, their first stays.
    assert all(160 + k not in single or cut[160 + k] not in ("", docs[k * 3]) for k in range(1, 5))
    assert {i for i in single if i < 160} == {i for i in cut if i < 160}
    leaking = {i for i, t in single.items() if any(x in (t or "") for _, x in items)}
    assert leaking and clean.keys() == single.keys() - leaking
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == clean.keys()
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces)
    assert decontam.SHINGLE == 5 and decontam.OVERLAP == 0.8 and linededup.WINDOW == 3


def test_odd_inputs(spark, tmp_path, odd, none):
    """Nulls, repeated rows and ids, a very long text and clashing columns through every stage, and empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "another text under the same id. another text"), (None, None)], "item_id long, text string")
    for name, docs, some_labels, some_items in (("odd", odd, labels, items), ("empty", none, labels.limit(0), items.limit(0))):
        path = f"{tmp_path}/{name}"
        some_labels.write.parquet(f"{path}/labels.parquet")
        some_items.write.parquet(f"{path}/benchmark.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            left = out.count()
            # One row of each of the six groups of near-copies; one text is a benchmark item; too few labels reject nothing.
            want = {"near_dedup": 6, "decontaminate": 9}.get(stage_name, 10)
            assert left == (want if name == "odd" else 0), stage_name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
        assert sum(r.start == 0 for r in pieces) == (10 if name == "odd" else 0)


def test_contract(spark):
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(names)
