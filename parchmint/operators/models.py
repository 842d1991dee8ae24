"""Recognition models as pluggable functions over image bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from parchmint.operators import metrics


def transcribe(lines: DataFrame, model: Callable[[], Callable[[list[bytes]], list[str]]], batch: int = 8, image: str = "image") -> DataFrame:
    """``lines`` with ``prediction``; ``model()`` is made once a task and called on batches of images."""
    schema = StructType([*lines.schema.fields, StructField("prediction", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = model()
        for pdf in frames:
            images = [bytes(b) for b in pdf[image]]
            yield pdf.assign(prediction=[t for k in range(0, len(images), batch) for t in read(images[k : k + batch])])

    return lines.mapInPandas(run, schema)


def baseline(lines: DataFrame, model: Callable[[], Callable[[list[bytes]], list[str]]], limit: int | None = None) -> DataFrame:
    """Stratified character error rate of a model on labelled line images (all, or the first ``limit``)."""
    if limit is not None:
        lines = lines.orderBy("ordinal").limit(limit)
    return metrics.stratified(metrics.line_rates(transcribe(lines, model).withColumnRenamed("text", "reference")))
