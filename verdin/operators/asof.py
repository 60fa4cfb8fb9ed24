"""Nearest-time matching with a tolerance (J6) and its summary.

A range join made equi: time is cut into buckets as wide as the tolerance, each
prediction is offered to its own and both neighbouring buckets (3 rows per
prediction), actuals stay in one bucket, so an equi-join on ``(keys, bucket)``
followed by ``|Δt| ≤ tolerance`` finds every candidate.  A grouped ``min_by`` per
prediction then keeps an exact hit first, else the smallest gap, ties to the
earliest-inserted actual.  The predictions side is never multiplied by more than 3
and AQE's skew-join splits a bucket that holds a large share of the actuals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.functions.timefuncs import epoch_micros


def nearest_match(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], tolerance_seconds: float,
                  pred_id: Sequence[str], pred_ts: str = "ts", actual_ts: str = "actual_ts",
                  actual_value: str = "actual", actual_order: Sequence = ()) -> DataFrame:
    """Left-join each prediction to its nearest actual within the tolerance (nulls when none)."""
    tol_us = int(round(tolerance_seconds * 1e6))
    width = max(tol_us, 1)
    p = predictions.withColumn("_pus", epoch_micros(pred_ts))
    a = actuals.withColumn("_aus", epoch_micros(actual_ts)).withColumn("_bucket", F.floor(F.col("_aus") / width))
    offered = p.withColumn("_bucket", F.explode(F.array(
        F.floor(F.col("_pus") / width) - 1, F.floor(F.col("_pus") / width), F.floor(F.col("_pus") / width) + 1)))
    a_cols = [F.col(k).alias(f"_a_{k}") for k in keys] + [
        "_bucket", "_aus", F.col(actual_ts).alias("matched_ts"), F.col(actual_value).alias("actual")] + [
        F.col(c).alias(f"_ord{i}") for i, c in enumerate(actual_order)]
    cond = [offered["_bucket"] == F.col("_b_bucket")] + [offered[k] == F.col(f"_a_{k}") for k in keys]
    aa = a.select(*a_cols).withColumnRenamed("_bucket", "_b_bucket")
    cand = offered.join(aa, cond).withColumn("_gap", F.abs(F.col("_pus") - F.col("_aus"))) \
        .filter(F.col("_gap") <= tol_us)
    # nearest candidate per prediction as a grouped min_by (partial aggregation), so a
    # prediction with very many candidates is reduced map-side instead of sorted in one task
    order_key = F.struct(F.col("_gap"), *[F.col(f"_ord{i}") for i in range(len(actual_order))])
    best = (cand.groupBy(*pred_id)
            .agg(F.min_by(F.struct("matched_ts", "actual"), order_key).alias("_best"))
            .select(*pred_id, "_best.matched_ts", "_best.actual"))
    return predictions.join(best, list(pred_id), "left")


def postfactum_errors(matched: DataFrame, prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    """Signed error = actual − prediction (6 dp) and MAPE % (4 dp) where the actual is non-zero."""
    err = F.col(actual) - F.col(prediction)
    return (matched.withColumn("abs_error", F.bround(err, 6))
            .withColumn("ape", F.when(F.col(actual).isNotNull() & (F.col(actual) != 0),
                                      F.bround(F.abs(err) / F.abs(F.col(actual)) * 100, 4))))


def comparison_summary(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points, matched count, mean absolute error and mean MAPE over matched points."""
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count("actual").alias("matched"),
        F.bround(F.avg(F.abs("abs_error")), 6).alias("mean_abs_error"),
        F.bround(F.avg("ape"), 4).alias("mean_ape"))
