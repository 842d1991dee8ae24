"""Line manifests by split, and the rule table as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import normalize as N
from parchmint.functions import text as T


def manifest(lines: DataFrame, splits: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines of the manuscripts in ``splits`` (manuscript, split), with their marks.

    ``lines`` has (manuscript, source_xml, line_no, line_id, text) and any box
    columns, which are kept. With ``limit``, the first lines of each split in order
    of manuscript, file and line.
    """
    rows = lines.join(splits.select("manuscript", "split").distinct(), "manuscript")
    rows = rows.withColumns({"has_abbreviation": T.has_abbreviation(F.col("text")), "abbreviations": T.abbreviations(F.col("text"))})
    if limit is None:
        return rows
    nth = F.row_number().over(Window.partitionBy("split").orderBy("manuscript", "source_xml", "line_no"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def write_manifest(rows: DataFrame, path: str) -> None:
    """One folder a split, so that reading one split reads nothing else."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def manifest_rates(rows: DataFrame) -> DataFrame:
    """Lines, abbreviated lines and their rate by split."""
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("lines"), F.count_if("has_abbreviation").alias("abbreviated"), F.avg(F.col("has_abbreviation").cast("double")).alias("rate"))


def split_frame(spark: SparkSession, parts: dict[str, list[str]]) -> DataFrame:
    """(manuscript, split) of a split as ``split.split_manuscripts`` makes it."""
    return spark.createDataFrame([(m, s) for s, ms in parts.items() for m in ms], "manuscript string, split string")


def rules_report(spark: SparkSession, rules: DataFrame | None = None) -> DataFrame:
    """All rules in order with their mode: a rule table's (or the built-in ones), then the editorial tags."""
    if rules is None:
        own = [(i, a, b) for i, (a, b) in enumerate((*N.DIPLOMATIC, *N.GRAPHIC))]
        rules = spark.createDataFrame(own, "ordinal long, pattern string, replacement string")
        rules = rules.withColumn("mode", F.when(T.has_abbreviation(F.col("pattern")), "diplomatic").otherwise("normalized"))
    tags = [(1_000_000 + i, p, "", "both", k) for i, (p, k) in enumerate(zip(N.EDITORIAL, N.EDITORIAL_KINDS, strict=True))]
    tags = spark.createDataFrame(tags, "ordinal long, pattern string, replacement string, mode string, kind string")
    return rules.select("ordinal", "pattern", "replacement", "mode", F.lit(None).cast("string").alias("kind")).unionByName(tags)
