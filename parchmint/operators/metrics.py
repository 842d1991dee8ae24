"""Error rates, their spread, and token precision and recall of predicted lines."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import text as T


def pair_lines(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Predictions with their reference: by line_id, else by position.

    Both have (ordinal, line_id, text); a missing line_id counts as the position.
    Of references with one line_id the last wins; lines without partner go.
    """
    key = F.coalesce(F.col("line_id"), F.col("position").cast("string"))
    p = predictions.withColumn("key", key)
    r = references.withColumn("key", key)
    by_id = r.groupBy("key").agg(F.max_by("text", "position").alias("by_id"))
    by_position = r.select(F.col("position"), F.col("text").alias("by_position"))
    out = p.join(by_id, "key", "left").join(by_position, "position", "left").withColumn("reference", F.coalesce("by_id", "by_position"))
    return out.where("reference IS NOT NULL").drop("key", "by_id", "by_position")


def line_rates(pairs: DataFrame) -> DataFrame:
    """``pairs`` (prediction, reference) with cer and wer, each computed once."""
    return pairs.withColumns({"cer": T.cer(F.col("prediction"), F.col("reference")), "wer": T.wer(F.col("prediction"), F.col("reference"))})


def stratified(rates: DataFrame, rate: str = "cer", flag: str = "has_abbreviation") -> DataFrame:
    """Mean rate over all lines and both strata, and their difference; null for an empty stratum."""
    f = F.col(flag)
    return rates.agg(
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("overall"), F.avg(F.when(f, F.col(rate))).alias("abbreviated"), F.avg(F.when(~f, F.col(rate))).alias("plain"),
        F.count_if(f).alias("n_abbreviated"), F.count_if(~f).alias("n_plain"),
    ).withColumn("delta", F.col("abbreviated") - F.col("plain"))


def errors_by_character(rates: DataFrame) -> DataFrame:
    """Mean cer by abbreviation mark of the reference; a line counts once per occurrence."""
    marks = rates.where("has_abbreviation").select("cer", F.explode(T.abbreviations(F.col("reference"))).alias("mark"))
    return marks.groupBy("mark").agg(F.avg("cer").alias("mean_cer"), F.count(F.lit(1)).alias("n"))


def mcnemar_counts(errors: DataFrame, e1: str = "e1", e2: str = "e2") -> DataFrame:
    """(b, c, chi2): lines that only the first, only the second gets wrong, and the corrected statistic."""
    a, b = F.col(e1), F.col(e2)
    n = errors.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    total = F.col("b") + F.col("c")
    return n.withColumn("chi2", F.when(total == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / total))


def mcnemar(errors: DataFrame, e1: str = "e1", e2: str = "e2") -> dict:
    """The test's one row, with its p-value: the tail of chi-square with one degree of freedom."""
    r = mcnemar_counts(errors, e1, e2).first()
    p = math.erfc(math.sqrt(r.chi2 / 2)) if r.b + r.c else 1.0
    return {"b": r.b, "c": r.c, "chi2": round(r.chi2, 4), "p_value": round(p, 4), "significant": p < 0.05}


def token_scores(pairs: DataFrame) -> DataFrame:
    """Token precision, recall and F1 of each line by multiset overlap; lines empty on both sides go."""

    def scores(x: Column) -> Column:
        n = F.struct(T.multiset_overlap(x["a"], x["b"]).alias("tp"), F.size(x["a"]).alias("np"), F.size(x["b"]).alias("nr"))
        share = lambda k, of: F.when(of > 0, k / of).otherwise(0.0)
        f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        rates = lambda y: F.struct(share(y["tp"], y["np"]).alias("precision"), share(y["tp"], y["nr"]).alias("recall"), (y["np"] + y["nr"]).alias("n"))
        return T.let(n, lambda y: T.let(rates(y), lambda z: F.struct(z["precision"].alias("precision"), z["recall"].alias("recall"), f1(z["precision"], z["recall"]).alias("f1"), z["n"].alias("n"))))

    # Generated rather than projected: a later filter on a score then can't be
    # pushed below and make the whole expression run twice.
    both = F.struct(T.tokens(F.col("prediction")).alias("a"), T.tokens(F.col("reference")).alias("b"))
    out = pairs.select("*", F.inline(F.transform(F.array(both), scores))).where("n > 0")
    return out.drop("n")


def token_summary(scores: DataFrame) -> DataFrame:
    """Macro averages by stratum: all lines, abbreviated, plain."""
    strata = F.explode(F.array(F.lit("all"), F.when(F.col("has_abbreviation"), "abbreviated").otherwise("plain"))).alias("stratum")
    return scores.select(strata, "precision", "recall", "f1").groupBy("stratum").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("lines")
    )


def worst_lines(scores: DataFrame, k: int = 20, below: float = 0.5) -> DataFrame:
    """Lines under ``below``, lowest F1 (to four places) first, then source order."""
    return scores.where(F.col("f1") < below).orderBy(F.round("f1", 4), "ordinal").limit(k)


def pair_summary(rates: DataFrame) -> DataFrame:
    """Perfect lines, mean rate and worst rate; empty references divide by one."""
    rate = F.levenshtein("prediction", "reference") / F.greatest(F.lit(1), F.length("reference"))
    return rates.select(rate.alias("r")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("r") == 0).alias("perfect"), F.avg("r").alias("mean_rate"), F.max("r").alias("worst_rate"))


def worst_pairs(rates: DataFrame, k: int = 5) -> DataFrame:
    return rates.orderBy(F.desc("cer"), "ordinal").limit(k)


#: Draws of the bootstrap are numbers below this prime.
PRIME = (1 << 31) - 1
#: A draw's count is the number of these that it reaches: cumulative Poisson(1)
#: probabilities times the prime; further ones are below one in ten million.
CUTS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * PRIME) for k in range(10)]


def draw_factors(n: int) -> np.ndarray:
    """(factor, shift) of each resample, from a hash of its number."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    return np.array([(1 + number(f"a{r}") % (PRIME - 1), number(f"b{r}") % PRIME) for r in range(n)], np.int64).reshape(-1, 2)


def bootstrap(rates: DataFrame, n: int = 1000, alpha: float = 0.05, position: str = "position") -> DataFrame:
    """Percentile intervals of the mean cer by the Poisson bootstrap, for any number of lines.

    Each line counts Poisson(1) times in each of ``n`` resamples, by a hash of
    its position that each resample multiplies and shifts modulo a prime. So no
    resample is ever held whole and nothing is joined: a task multiplies the
    counts of some lines in all resamples by their rates, and only one row a
    resample and task is shuffled.
    """
    factor, shift = draw_factors(n).T
    cuts = np.array(CUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, n))
        for batch in batches:
            h, cer, flag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            values = np.stack([np.ones(len(h)), cer, flag, flag * cer])
            for at in range(0, len(h), 256):
                draws = (h[at : at + 256, None] * factor + shift) % PRIME
                sums += values[:, at : at + 256] @ np.searchsorted(cuts, draws, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *map(pa.array, sums)], ["rep", "k", "x", "kf", "xf"])

    h = F.conv(F.substring(F.md5(F.col(position).cast("string")), 1, 8), 16, 10).cast("long") % PRIME
    rows = rates.select(h.alias("h"), F.coalesce("cer", F.lit(0.0)).alias("cer"), F.col("has_abbreviation").cast("double").alias("f"))
    rows = rows.mapInArrow(run, "rep long, k double, x double, kf double, xf double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("k", "x", "kf", "xf")])
    mean = lambda x, k: F.try_divide(F.col(x), F.col(k))
    sums = rows.withColumns({"kp": F.col("k") - F.col("kf"), "xp": F.col("x") - F.col("xf")})
    sums = sums.select("rep", mean("x", "k").alias("overall"), mean("xf", "kf").alias("abbreviated"), mean("xp", "kp").alias("plain"))
    return intervals(sums.withColumn("delta", F.col("abbreviated") - F.col("plain")), alpha)


def intervals(resamples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(measure, mean, lower, upper) of resample means; nulls are left out."""
    measures = ("overall", "abbreviated", "plain", "delta")
    rows = resamples.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures])).alias("m")).select("m.measure", "m.x")
    q = F.percentile("x", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return rows.groupBy("measure").agg(F.avg("x").alias("mean"), q.alias("q")).select("measure", "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def bootstrap_exact(rates: DataFrame, n: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The same with resamples drawn with replacement by one seeded generator.

    For test sets of a few hundred lines: the draws (twice n times the lines) are
    made on the driver, and a set of more than 20,000 lines is refused; use
    ``bootstrap`` for those.
    """
    spark = rates.sparkSession
    rows = rates.select("ordinal", "has_abbreviation").orderBy("ordinal").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 lines; use bootstrap()")
    rng = random.Random(seed)
    strata = {"overall": [r.ordinal for r in rows], "abbreviated": [r.ordinal for r in rows if r.has_abbreviation], "plain": [r.ordinal for r in rows if not r.has_abbreviation]}
    draws = [(rep, m, rng.choice(own)) for rep in range(n) for m, own in strata.items() for _ in own]
    drawn = spark.createDataFrame(draws, "rep int, measure string, ordinal long").join(rates.select("ordinal", "cer"), "ordinal")
    means = drawn.groupBy("rep").pivot("measure", list(strata)).agg(F.avg("cer"))
    return intervals(means.withColumn("delta", F.col("abbreviated") - F.col("plain")), alpha)
