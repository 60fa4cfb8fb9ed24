"""Sorts, limits, top-k and sampling (K1–K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def downsample_points(points: DataFrame, keys: Sequence[str], order: str, point_count: int | None,
                      value: str = "prediction", ts: str = "ts") -> DataFrame:
    """K3: drop rows with a missing timestamp or non-finite value, then keep the rows at
    index round(i/(p−1)·last) for i in 0..p−1 (half-even, de-duplicated; p = 1 → last).
    Keeps everything when ``point_count`` is None or ≥ the row count.

    Per series the kept rows are a set of ordinals, so the selection is a filter on a
    ``row_number`` (the sequence of points is bounded by the forecast step count)."""
    v = F.col(value).cast("double")
    clean = points.filter(F.col(ts).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    if point_count is None:
        return clean
    if point_count < 1:
        raise ValueError("point_count must be at least 1")
    w = Window.partitionBy(*keys).orderBy(order)
    ranked = (clean.withColumn("_idx", F.row_number().over(w) - 1)
              .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    last = F.col("_cnt") - 1
    if point_count == 1:
        chosen = F.array(last)
    else:
        chosen = F.transform(F.sequence(F.lit(0), F.lit(point_count - 1)),
                             lambda i: F.bround(i.cast("double") / F.lit(point_count - 1) * last, 0).cast("long"))
    keep = (F.col("_cnt") <= F.lit(point_count)) | F.array_contains(chosen, F.col("_idx").cast("long"))
    return ranked.filter(keep).drop("_idx", "_cnt")


def head_sample(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """K5: deterministic head — the ``k`` first rows by an explicit order (a top-k, not a cap)."""
    return df.orderBy(*order).limit(k)


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """K6: the ``k`` largest scores (ties by name); Spark plans TakeOrderedAndProject."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)
