"""Named entities: a pluggable annotator, its filters and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import text as T

TYPES = ("LOC", "MISC", "ORG", "PER")
MIN_SCORE = 0.80
RAW = "array<struct<entity_group:string,word:string,score:double,start:int,end:int>>"

# Grammatical words that annotators mistake for entities.
STOP_WORDS = (
    "si", "se", "ce", "cil", "cel", "cist", "ceste", "les", "des", "del", "dou", "au", "es", "que", "qui", "ou", "en", "de", "le", "la",
    "li", "sire", "dame", "seigneur", "conme", "comme", "et", "est", "fu", "a", "e", "i", "u", "q", "s", "b", "c", "d", "f", "g", "h", "j",
    "k", "l", "m", "n", "o", "p", "r", "t", "v", "w", "x", "y", "z", "ne", "ni", "or", "mais", "car", "tant", "lors", "puis",
    "bien", "moult", "tres", "tout", "toute", "tous", "grant", "petit", "sa", "son", "ses", "mon", "ton", "lor", "nostre", "vostre",
)


def kept_entities(raw: Column) -> Column:
    """Entities of the four types, longer than two letters, sure enough and no stop word; scores to four places."""
    kind = lambda e: F.regexp_replace(F.upper(e["entity_group"]), "^[BI]-", "")
    word = lambda e: T.strip(e["word"])
    good = F.filter(raw, lambda e: kind(e).isin(*TYPES) & (F.length(word(e)) > 2) & (e["score"] >= MIN_SCORE) & ~F.lower(word(e)).isin(*STOP_WORDS))
    return F.transform(good, lambda e: F.struct(word(e).alias("word"), kind(e).alias("type"), F.round(e["score"], 4).alias("score"), e["start"].alias("start"), e["end"].alias("end")))


def annotate(lines: DataFrame, annotator: Callable[[], Callable[[str], list[dict]]], text: str = "text") -> DataFrame:
    """``lines`` with ``entities`` by a Python annotator, made once a task by ``annotator()``.

    A text on which it fails has no entities.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = annotator()

        def one(t: str | None) -> list[dict]:
            try:
                return [{k: e.get(k) for k in ("entity_group", "word", "score", "start", "end")} for e in find(t)] if t else []
            except Exception:
                return []

        for batch in batches:
            yield batch.map(one)

    raw = F.pandas_udf(run, RAW)
    return lines.withColumn("entities", kept_entities(raw(F.col(text))))


def annotate_by_gazetteer(lines: DataFrame, gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """(ordinal, manuscript, word, type): tokens of the lines that a gazetteer (form, type) lists, as entities.

    An equi-join on the lower-case token; adaptive execution picks its strategy
    from the gazetteer's size.
    """
    tokens = lines.select("ordinal", T.manuscript_of(F.coalesce("manuscript", F.lit("unknown"))).alias("manuscript"), F.posexplode(T.tokens(F.col(text))).alias("at", "word"))
    tokens = tokens.withColumn("form", F.lower("word")).where((F.length("word") > 2) & ~F.col("form").isin(*STOP_WORDS))
    return tokens.join(gazetteer.select("form", "type").distinct(), "form").select("ordinal", "at", "manuscript", "word", "type")


def entity_rows(annotated: DataFrame) -> DataFrame:
    """One row an entity of lines with ``entities``."""
    name = T.manuscript_of(F.coalesce("manuscript", F.lit("unknown"))).alias("manuscript")
    return annotated.select("ordinal", name, F.posexplode("entities").alias("at", "e")).select("ordinal", "at", "manuscript", "e.word", "e.type")


def _types(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("type"))


def entities_by_type(rows: DataFrame) -> DataFrame:
    """Total and distinct entities of all four types, also those without any."""
    n = rows.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.lower("word")).alias("distinct_forms"))
    return _types(rows.sparkSession).join(n, "type", "left").na.fill(0)


def entities_by_manuscript(rows: DataFrame) -> DataFrame:
    """One column a type, zero-filled."""
    return rows.groupBy("manuscript").pivot("type", list(TYPES)).agg(F.count(F.lit(1))).na.fill(0)


def top_entities(rows: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent forms of each type, ties by first occurrence."""
    n = rows.groupBy("type", F.lower("word").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    # One row a form and type, not one an entity.
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "first", "form"))).where(F.col("rank") <= k).drop("first")
