"""Overlap of layout polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def raster(polygon, height: int, width: int) -> np.ndarray:
    """Pixels of a polygon, its border included: even-odd rule by rows, edges drawn."""
    mask = np.zeros((height, width), bool)
    p = np.array([list(q) for q in polygon], float).astype(np.int64)
    if not len(p):
        return mask
    q = np.roll(p, -1, axis=0)
    columns = np.arange(width)
    for y in range(max(0, p[:, 1].min()), min(height, p[:, 1].max() + 1)):
        crossing = (p[:, 1] <= y) != (q[:, 1] <= y)
        if crossing.any():
            a, b = p[crossing], q[crossing]
            x = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            mask[y] = ((columns[:, None] >= np.sort(x)[None]).sum(1) % 2).astype(bool)
    for (x0, y0), (x1, y1) in zip(p.tolist(), q.tolist(), strict=True):
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        t = np.arange(n + 1) / n
        xs, ys = np.floor(x0 + (x1 - x0) * t + 0.5).astype(int), np.floor(y0 + (y1 - y0) * t + 0.5).astype(int)
        ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        mask[ys[ok], xs[ok]] = True
    return mask


def iou(a, b, height: int = 1000, width: int = 1000) -> float:
    """Intersection over union of two polygons' pixels on a canvas; 0 if one is empty."""
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    x, y = raster(a, height, width), raster(b, height, width)
    union = (x | y).sum()
    return float((x & y).sum() / union) if union else 0.0


def polygon_iou(a: Column, b: Column, height: int = 1000, width: int = 1000) -> Column:
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([iou(p, q, height, width) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def rectangle_iou(a: list[Column], b: list[Column]) -> Column:
    """The same for rectangles (x1, y1, x2, y2) within the canvas, from pixel counts alone."""
    area = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1
    common = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return common / (area(a) + area(b) - common)


def iou_summary(pairs: DataFrame, column: str = "iou") -> DataFrame:
    x = F.col(column)
    return pairs.agg(
        F.count(x).alias("pairs"), F.avg(x).alias("mean_iou"), F.min(x).alias("min_iou"), F.max(x).alias("max_iou"),
        F.avg((x >= 0.75).cast("double")).alias("share_75"), F.avg((x >= 0.85).cast("double")).alias("share_85"),
    )
