"""Review flags and the contract of deliverable lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import text as T

THRESHOLD, MIN_LENGTH, DISCORD = 0.6, 5, 0.3


def needs_review(text: Column, confidence: Column, abbreviated: Column, second: Column | None = None, threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> Column:
    """Short, unsure, abbreviated and rather unsure, or far from a second transcription."""
    flag = (F.length(T.strip(text)) < min_length) | (confidence < threshold) | (abbreviated & (confidence < 1.2 * threshold))
    if second is not None:
        apart = F.levenshtein(text, second) / F.greatest(F.lit(1), F.length(text)) > DISCORD
        flag = flag | F.coalesce(apart, F.lit(False))
    return F.coalesce(flag, F.lit(False))


def errors() -> Column:
    """Messages of all rules that a deliverable line breaks, in order; empty if it is valid."""
    missing = [F.when(F.col(c).isNull(), f"{c} is missing") for c in ("image_id", "line_id", "transcription", "confidence", "needs_review", "polygon", "page_xml_ref")]
    blank = [F.when(F.col(c) == "", f"{c} is empty") for c in ("image_id", "line_id", "page_xml_ref")]
    rest = [
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence"), "confidence is outside [0, 1]"),
        F.when(F.size("polygon") < 3, "polygon has fewer than 3 points"),
        F.when(F.exists("polygon", lambda p: p.isNull() | (F.size(p) != 2)), "polygon point is not a pair of numbers"),
    ]
    return F.filter(F.array(*missing, *blank, *rest), lambda m: m.isNotNull())


def with_errors(lines: DataFrame) -> DataFrame:
    return lines.withColumn("errors", errors())


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """Lines from JSON text; a value of the wrong type is an error of its own, ``not_json``.

    Extra fields are allowed and ignored.
    """
    from parchmint.sources.lines import LINE_SCHEMA

    parsed = raw.withColumn("_x", F.from_json(column, f"{LINE_SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    out = with_errors(parsed.select("_x.*"))
    return out.withColumn("errors", F.when(F.col("_bad").isNotNull(), F.array_prepend("errors", F.lit("not_json"))).otherwise(F.col("errors"))).drop("_bad")


def deliverables(lines: DataFrame, predictions: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Deliverable lines with their errors.

    ``lines`` has (ordinal, line_no, manuscript, source, line_id, text) and
    predictions (ordinal, text, confidence, polygon, second), all optional:
    without one the text itself counts, with confidence 1 and the unit square.
    The review flag is set before the confidence is rounded.
    """
    rows = lines.select("ordinal", "line_no", "manuscript", "source", "line_id", "text")
    if predictions is not None:
        rows = rows.join(predictions.select("ordinal", F.col("text").alias("p"), F.col("confidence").alias("c"), F.col("polygon").alias("g"), F.col("second").alias("s")), "ordinal", "left")
    else:
        rows = rows.selectExpr("*", "CAST(NULL AS string) p", "CAST(NULL AS double) c", "CAST(NULL AS array<array<double>>) g", "CAST(NULL AS string) s")
    square = F.expr("array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 1D))")
    text, sure = F.coalesce("p", "text"), F.coalesce(F.col("c").cast("double"), F.lit(1.0))
    flag = T.has_abbreviation(F.col("text"))
    out = rows.select(
        "ordinal", F.concat_ws("_", "manuscript", "source").alias("image_id"),
        F.coalesce(F.when(F.col("line_id") != "", F.col("line_id")), F.format_string("line_%04d", "line_no")).alias("line_id"), text.alias("transcription"),
        F.round(sure, 4).alias("confidence"), needs_review(text, sure, flag, F.col("s"), threshold).alias("needs_review"), flag.alias("has_abbreviation"),
        F.coalesce("g", square).alias("polygon"), F.concat(F.lit("segmentations/"), F.col("source"), F.lit(".xml")).alias("page_xml_ref"),
    )
    return with_errors(out)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid lines, and the others with their errors."""
    ok = F.size("errors") == 0
    return checked.where(ok).drop("errors"), checked.where(~ok)


def error_summary(checked: DataFrame) -> DataFrame:
    """Lines by their first error; valid ones under ``valid``."""
    return checked.groupBy(F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def review_summary(lines: DataFrame) -> DataFrame:
    r, a = F.col("needs_review"), F.col("has_abbreviation")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(r).alias("review"), F.avg(r.cast("double")).alias("review_rate"), F.count_if(a).alias("abbreviated"), F.count_if(a & r).alias("abbreviated_review"))


def leaks(train: DataFrame, test: DataFrame, key: str = "image_id") -> DataFrame:
    """Keys that are in both splits; there should be none."""
    return train.select(key).intersect(test.select(key))
