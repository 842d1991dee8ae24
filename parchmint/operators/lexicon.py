"""Frequency lexicon, dictionary and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.functions.normalize import normalize_text, without_accents

FREQ_MIN = 2


def token_rows(lines: DataFrame, text: str = "clean") -> DataFrame:
    """One row a token: lower-case form, manuscript prefix, the line's flag and the token's place."""
    rows = lines.select("ordinal", T.manuscript_of(F.coalesce("manuscript", "image_id")).alias("manuscript"), "has_abbreviation", F.posexplode(T.tokens(F.col(text))).alias("at", "token"))
    return rows.select(F.lower("token").alias("form"), "manuscript", "has_abbreviation", "ordinal", "at")


def lexicon(*sources: DataFrame, text: str = "clean") -> DataFrame:
    """(form, freq, manuscripts, has_abbreviation, hapax, first_ordinal) over all sources in order.

    ``has_abbreviation`` is that of the first line where the form occurs. Tokens
    are counted by form and manuscript first, so that a frequent form reaches the
    final step as one row a manuscript and task, not one a token.
    """
    rows = [token_rows(s, text).withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    tokens = reduce(DataFrame.unionByName, rows)
    by_manuscript = tokens.groupBy("form", "manuscript", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.min_by(F.col("has_abbreviation").cast("int"), F.col("ordinal")).alias("flag")
    )
    place = F.struct("source", "first")
    return by_manuscript.groupBy("form").agg(
        F.sum("n").alias("freq"), F.sort_array(F.collect_set("manuscript")).alias("manuscripts"),
        F.min_by("flag", place).cast("boolean").alias("has_abbreviation"), F.min("first").alias("first_ordinal"),
    ).withColumn("hapax", F.col("freq") == 1)


def hapax_rate(lexicon_: DataFrame) -> DataFrame:
    return lexicon_.agg(F.count(F.lit(1)).alias("forms"), F.count_if("hapax").alias("hapax"), F.avg(F.col("hapax").cast("double")).alias("rate"))


def dictionary_from_lines(lines: DataFrame, fallback: DataFrame | None = None, min_length: int = 2) -> DataFrame:
    """Distinct forms of two letters and more of diplomatically cleaned lines, and a fallback's."""
    forms = lines.select(F.explode(T.tokens(normalize_text(F.col("text")))).alias("t")).select(F.lower("t").alias("form")).where(F.length("form") >= min_length).distinct()
    return forms if fallback is None else forms.union(fallback.select("form")).distinct()


def dictionary_lookup(lexicon_: DataFrame, dictionary: DataFrame, freq_min: int = FREQ_MIN) -> DataFrame:
    """Forms of at least ``freq_min`` with ``known``: in the dictionary as they are, or without accents.

    Two equi-joins, as a join on either condition would compare all pairs.
    """
    forms = lexicon_.where(F.col("freq") >= freq_min).withColumn("bare", without_accents(F.col("form")))
    entries = dictionary.select("form").distinct()
    exact = forms.join(entries.withColumn("_exact", F.lit(True)), "form", "left")
    both = exact.join(entries.select(F.col("form").alias("bare"), F.lit(True).alias("_bare")), "bare", "left")
    return both.withColumn("known", F.coalesce("_exact", "_bare", F.lit(False))).drop("_exact", "_bare", "bare")


def coverage(looked_up: DataFrame) -> DataFrame:
    """Coverage over forms: overall, and for forms with and without abbreviation.

    ``rate_plain`` keeps the conventional denominator, which counts known
    abbreviated forms too; ``rate_plain_exact`` leaves them out.
    """
    n = looked_up.agg(
        F.count(F.lit(1)).alias("forms"), F.count_if("known").alias("known"),
        F.count_if(F.col("known") & F.col("has_abbreviation")).alias("known_abbr"), F.count_if(~F.col("known") & F.col("has_abbreviation")).alias("unknown_abbr"),
    )
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    forms, known, ka, ua = (F.col(c) for c in ("forms", "known", "known_abbr", "unknown_abbr"))
    return n.select(
        "forms", "known", (forms - known).alias("unknown"), share(known, forms).alias("rate"),
        F.when(forms == 0, 0.0).otherwise((known - ka) / F.greatest(F.lit(1), forms - ua)).alias("rate_plain"),
        share(known - ka, forms - ua - ka).alias("rate_plain_exact"), share(ka, ka + ua).alias("rate_abbr"),
    )


def unknown_forms(looked_up: DataFrame) -> DataFrame:
    """Forms that the dictionary lacks, with the likely reason."""
    reason = (
        F.when(T.has_abbreviation(F.col("form")), "unexpanded_abbreviation")
        .when(F.length("form") <= 2, "fragment")
        .when((F.col("freq") <= 3) & ~F.col("has_abbreviation"), "probable_error")
        .otherwise("rare_or_dialectal")
    )
    return looked_up.where(~F.col("known")).withColumn("reason", reason)


def unknown_reasons(unknown: DataFrame) -> DataFrame:
    return unknown.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_unknown(unknown: DataFrame, k: int = 500) -> DataFrame:
    """The most frequent unknown forms; ties in order of first occurrence, then form."""
    return unknown.orderBy(F.desc("freq"), "first_ordinal", "form").limit(k)
