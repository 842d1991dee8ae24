"""Every registered query on small tables, against its SQL where it has one."""

import math
import random

import duckdb
import pytest

from parchmint.plans import queries as plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    words = ["le", "roi", "que", "con", "conte", "per", "et", "an", "ou", "é", "ñu", "Grant", ".", "année", "fu", "Ça", "x2"]
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(rng.randrange(1, 5))), "fr", f"src{i % 4}") for i in range(40)]
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return path, con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, tables, name):
    path, con = tables
    df = plans.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in plans.ORACLES:
        result = con.sql(plans.ORACLES[name])
        assert sorted(result.columns) == columns
        want = sorted((tuple(plain(v) for _, v in sorted(zip(result.columns, r, strict=True))) for r in result.fetchall()), key=repr)
        assert got == want
    else:
        assert got


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("parchmint.llm", "corpus_pipeline")) else find(name, *a))
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.ORACLES)


def test_bootstraps_draw_a_thousand_resamples(spark, tables, monkeypatch):
    drawn, intervals = [], plans.metrics.intervals
    monkeypatch.setattr(plans.metrics, "intervals", lambda sums, alpha: drawn.append(sums.count()) or intervals(sums, alpha))
    for name in ("bootstrap_ci", "evaluation_report"):
        plans.QUERIES[name](spark, tables[0])
    assert drawn == [1000, 1000]
