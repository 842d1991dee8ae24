"""Corpus profiles and abbreviation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import text as T


def manuscript_profile(lines: DataFrame) -> DataFrame:
    """Pages, lines and line lengths of each manuscript."""
    size = F.length("text")
    return lines.groupBy("manuscript").agg(
        F.countDistinct("image_id").alias("pages"), F.count(F.lit(1)).alias("lines"),
        F.avg(size).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"),
    )


def corpus_totals(lines: DataFrame) -> DataFrame:
    """One row over ``manuscript_profile``: the second level of the same aggregate."""
    return manuscript_profile(lines).agg(F.count(F.lit(1)).alias("manuscripts"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def abbreviation_rates(lines: DataFrame, by: str = "manuscript") -> DataFrame:
    flag = T.has_abbreviation(F.col("text"))
    return lines.groupBy(by).agg(F.count(F.lit(1)).alias("lines"), F.count_if(flag).alias("abbreviated"), F.avg(flag.cast("double")).alias("rate"))


def abbreviation_counts(lines: DataFrame) -> DataFrame:
    """Marks by manuscript with their count and first place; ``manuscript`` null is the whole corpus."""
    marks = lines.select("manuscript", "ordinal", F.posexplode(T.abbreviations(F.col("text"))).alias("at", "mark"))
    # A place is one sortable number, so that both levels are hash aggregates of longs.
    return marks.rollup("mark", "manuscript").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).where("mark IS NOT NULL")


def top_abbreviations(lines: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent marks of each manuscript and (null) of the corpus, ties by mark."""
    # The window sees one row a mark and manuscript, not one a line.
    rank = F.row_number().over(Window.partitionBy("manuscript").orderBy(F.desc("n"), "mark"))
    return abbreviation_counts(lines).select("manuscript", "mark", "n").withColumn("rank", rank).where(F.col("rank") <= k)


def char_frequencies(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.select(F.explode(T.characters(F.col(text))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def alphabet(predictions: DataFrame, references: DataFrame, charset: DataFrame | None = None, names: bool = True) -> DataFrame:
    """Characters of both sides with class, code point and frequencies; ``missing`` if predictions lack it."""
    from parchmint.functions.normalize import unicode_name

    p = char_frequencies(predictions).withColumnRenamed("n", "freq_predictions")
    r = char_frequencies(references).withColumnRenamed("n", "freq_references")
    out = p.join(r, "char", "full").na.fill(0, ["freq_predictions", "freq_references"])
    out = out.withColumns({"codepoint": T.codepoint(F.col("char")), "class": T.char_class(F.col("char")), "missing": (F.col("freq_references") > 0) & (F.col("freq_predictions") == 0)})
    if charset is not None:
        out = out.join(charset.select("char", F.lit(True).alias("in_charset")).distinct(), "char", "left").na.fill(False, ["in_charset"])
    return out.withColumn("unicode_name", unicode_name(F.col("char"))) if names else out


def alphabet_order(alphabet_: DataFrame) -> DataFrame:
    """By class in its reporting order, then falling frequency, then character."""
    rank = F.array_position(F.array(*map(F.lit, T.CLASSES)), F.col("class"))
    return alphabet_.orderBy(rank, F.desc("freq_references"), "char")


def alphabet_summary(alphabet_: DataFrame) -> DataFrame:
    return alphabet_.agg(
        F.count_if(F.col("freq_predictions") > 0).alias("in_predictions"), F.count_if(F.col("freq_references") > 0).alias("in_references"),
        F.count(F.lit(1)).alias("total"), F.count_if("missing").alias("missing"),
    )


def missing_characters(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Characters of the references that no prediction has."""
    return char_frequencies(references).join(char_frequencies(predictions), "char", "left_anti")
