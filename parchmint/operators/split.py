"""Splits by manuscript, content hashes and early stopping."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_manuscripts(names: list[str], val: float = 0.15, test: float = 0.15, seed: int = 42) -> dict[str, list[str]]:
    """Seeded split of a list of manuscripts by their number: the last go to test, those before to val."""
    names = list(names)
    random.Random(seed).shuffle(names)
    n_val, n_test = max(1, round(len(names) * val)), max(1, round(len(names) * test))
    cut = len(names) - n_test
    return {"train": names[: cut - n_val], "val": names[cut - n_val : cut], "test": names[cut:]}


def split_of(key: Column, val: float = 0.15, test: float = 0.15, seed: int = 42) -> Column:
    """The split of a key by its hash: needs no list, and never changes as keys are added."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def with_file_hash(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows with the SHA-256 of their content."""
    return files.withColumn("sha256", F.sha2("content", 256))


def folder_hash(files: DataFrame, *by: str) -> DataFrame:
    """One digest a folder or split: SHA-256 over names and digests in order of path."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(~F.col("path").contains(".chocomufin")).select(*by, F.struct("path", name.alias("name"), "sha256").alias("f"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: F.concat(f["name"], f["sha256"])), "")
    return rows.groupBy(*by).agg(F.sha2(joined, 256).alias("sha256"), F.count(F.lit(1)).alias("files"))


def early_stop(log: DataFrame, patience: int = 3, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """Best value and stopping epoch of each run: after ``patience`` epochs without a strictly lower value."""
    own = Window.partitionBy(run).orderBy(epoch)
    before = F.min(metric).over(own.rowsBetween(Window.unboundedPreceding, -1))
    seen = log.withColumn("better", F.col(metric) < F.coalesce(before, F.lit(float("inf"))))
    last = F.max(F.when(F.col("better"), F.col("nth"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumn("nth", F.row_number().over(own)).withColumn("since", F.col("nth") - F.coalesce(last, F.lit(0)))
    stop = seen.groupBy(run).agg(F.coalesce(F.min(F.when(F.col("since") >= patience, F.col("nth"))), F.max("nth")).alias("stop_nth"))
    out = seen.join(stop, run).where(F.col("nth") <= F.col("stop_nth"))
    return out.groupBy(run).agg(F.min(metric).alias("best"), F.max(epoch).alias("stopped"))
