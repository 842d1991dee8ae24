"""Review flags and journals over streams of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.operators.contract import needs_review, with_errors
from parchmint.sources.lines import LINE_SCHEMA
from parchmint.sources.sinks import JOURNAL_SCHEMA


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Deliverable lines as JSON lines arriving in a folder."""
    return spark.readStream.schema(f"{LINE_SCHEMA}, ts timestamp").json(path)


def flagged(lines: DataFrame) -> DataFrame:
    """Flags and contract errors; row by row, so the same plan serves batches and streams."""
    abbreviated = T.has_abbreviation(F.col("transcription"))
    out = lines.withColumn("has_abbreviation", abbreviated).withColumn("needs_review", needs_review(F.col("transcription"), F.col("confidence"), F.col("has_abbreviation")))
    return with_errors(out)


def review_rate(lines: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Lines and review rate by time window; lines later than ``late`` are left out, as state ends there."""
    windows = flagged(lines).withWatermark("ts", late).groupBy(F.window("ts", every))
    return windows.agg(F.count(F.lit(1)).alias("lines"), F.avg(F.col("needs_review").cast("double")).alias("review_rate")).select("window.start", "window.end", "lines", "review_rate")


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(JOURNAL_SCHEMA).json(path)
