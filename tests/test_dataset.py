from parchmint.operators import dataset, split


def test_manifest(spark, tmp_path):
    lines = spark.createDataFrame([(f"m{k % 4}", f"p{k % 2}.xml", k, f"l{k}", "ꝯte" if k % 3 else "bien") for k in range(24)], "manuscript string, source_xml string, line_no long, line_id string, text string")
    parts = split.split_manuscripts([f"m{k}" for k in range(4)])
    rows = dataset.manifest(lines, dataset.split_frame(spark, parts))
    assert rows.count() == 24
    dataset.write_manifest(rows, f"{tmp_path}/manifest")
    back = spark.read.parquet(f"{tmp_path}/manifest")
    rates = {r.split: (r.lines, r.abbreviated) for r in dataset.manifest_rates(back).collect()}
    assert rates == {"train": (12, 8), "val": (6, 4), "test": (6, 4)}
    first = dataset.manifest(lines, dataset.split_frame(spark, parts), limit=5)
    assert {r.split: r.lines for r in dataset.manifest_rates(first).collect()} == {"train": 5, "val": 5, "test": 5}
    assert back.where("split = 'val'").inputFiles() and "PartitionFilters" in back.where("split = 'val'")._jdf.queryExecution().executedPlan().toString()


def test_rules_report(spark):
    n = {r["mode"]: r["count"] for r in dataset.rules_report(spark).groupBy("mode").count().collect()}
    assert n == {"diplomatic": 20, "normalized": 85, "both": 6}
