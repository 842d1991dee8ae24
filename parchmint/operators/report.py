"""The evaluation report: all measures of a prediction as one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.operators import metrics


def evaluation(rates: DataFrame, n_bootstrap: int = 1000, position: str = "position") -> DataFrame:
    """(cer, wer, intervals, characters, share) of lines with cer and wer.

    Every part is an aggregate of the same rows, which are computed once; each
    is one row, or one a measure or mark, before they meet.
    """
    rates = rates.select("cer", "wer", "has_abbreviation", "reference", position).persist()
    one = lambda df, name: df.select(F.struct("*").alias(name))
    many = lambda df, name, *order: df.agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias(name))
    parts = [
        one(metrics.stratified(rates, "cer"), "cer"),
        one(metrics.stratified(rates, "wer"), "wer"),
        many(metrics.bootstrap(rates, n_bootstrap, position=position), "intervals", "measure"),
        many(metrics.errors_by_character(rates).withColumn("order", -F.col("mean_cer")), "characters", "order", "mark"),
        rates.agg(F.avg(F.col("has_abbreviation").cast("double")).alias("share")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.withColumn("conclusion", conclusion())


def conclusion() -> Column:
    """What the numbers say about abbreviations, as a sentence."""
    d = F.col("cer.delta")
    trend = F.when(d > 0, "higher").otherwise("comparable or lower")
    weight = F.when(d > 0.05, "clearly degrade").otherwise("moderately affect")
    delta = F.element_at(F.filter("intervals", lambda i: i["measure"] == "delta"), 1)
    band = F.when(delta["lower"].isNotNull(), F.format_string(" (95%% interval [%.3f, %.3f])", delta["lower"], delta["upper"])).otherwise("")
    marks = F.array_join(F.transform(F.slice("characters", 1, 3), lambda c: c["mark"]), ", ")
    text = F.concat(
        F.format_string("The overall character error rate is %.3f. ", "cer.overall"),
        F.format_string("On lines with abbreviation marks it is %s (%.3f) than on others (%.3f)", trend, F.col("cer.abbreviated"), F.coalesce("cer.plain", F.lit(0.0))), band,
        F.lit(". The marks with most errors are: "), F.when(marks == "", "none").otherwise(marks),
        F.format_string(". Abbreviated lines are %.1f%% of the corpus and ", F.col("share") * 100), weight, F.lit(" recognition."),
    )
    return F.when(F.col("cer.abbreviated").isNull(), "No abbreviated lines: nothing to conclude.").otherwise(text)
