"""Evaluation metrics as grouped aggregates (M10–M12, A12, L6 gain).

Every metric is one ``groupBy(keys).agg`` with partial aggregation, so metrics for
thousands of models or series are computed in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT_EPS = 2.220446049250313e-16


def primary_metric_name(task_type: str) -> str:
    """Rmse for regression (lower is better), f1_weighted otherwise."""
    return "rmse" if task_type == "regression" else "f1_weighted"


def lower_is_better(metric: str) -> bool:
    return metric == "rmse"


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), k: int = 1) -> DataFrame:
    """R, mse, rmse, mae, r2 and Gaussian AIC/BIC/AICc with ``k`` parameters (≥ 1), 6 dp."""
    k = max(int(k), 1)
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    pairs = df.select(*keys, yy.alias("_y"), pp.alias("_p")).select("*", (F.col("_y") - F.col("_p")).alias("_e"))
    # pairs without two finite numbers are no observation; a filter would be pushed below the model and predict every row again
    finite = ~F.isnan("_e") & (F.abs("_e") < float("inf"))
    g = pairs.select(*keys, *[F.when(finite, F.col(c)).alias(c) for c in ("_y", "_p", "_e")]).groupBy(*keys).agg(
        F.count("_e").alias("n"),
        F.sum(F.col("_e") * F.col("_e")).alias("_rss"),
        F.avg(F.abs("_e")).alias("_mae"),
        F.covar_pop("_y", "_p").alias("_cov"),
        F.stddev_pop("_y").alias("_sy"), F.stddev_pop("_p").alias("_sp"),
        F.var_pop("_y").alias("_vy"))
    if keys:
        g = g.where(F.col("n") > 0)
    n = F.col("n").cast("double")
    mse = F.col("_rss") / n
    sstot = F.col("_vy") * n
    r2 = (F.when(sstot > 0, 1 - F.col("_rss") / sstot)
          .when(F.col("_rss") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    # null for a flat series; deviations whose product underflows to zero give null as well
    r = F.when((F.col("n") >= 2) & (F.col("_sy") > 0) & (F.col("_sp") > 0),
               F.try_divide("_cov", F.col("_sy") * F.col("_sp")))
    sigma2 = F.greatest(mse, F.lit(FLOAT_EPS))
    aic = n * F.log(sigma2) + 2.0 * k
    bic = n * F.log(sigma2) + k * F.log(n)
    denom = n - k - 1
    aicc = F.when(denom > 0, aic + (2.0 * k * (k + 1)) / denom)
    out = g.select(*keys, "n", F.bround(r, 6).alias("r"), F.bround(mse, 6).alias("mse"),
                   F.bround(F.sqrt(mse), 6).alias("rmse"), F.bround("_mae", 6).alias("mae"),
                   F.bround(r2, 6).alias("r2"), F.bround(aic, 6).alias("aic"), F.bround(bic, 6).alias("bic"),
                   F.bround(aicc, 6).alias("aicc"), F.lit(k).alias("k"))
    return out


def per_label_scores(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predicted count, true positives, precision, recall and F1 per label
    (zero division → 0), from two grouped counts joined on (keys, label)."""
    a = F.col(actual).cast("string")
    p = F.col(predicted).cast("string")
    base = df.select(*keys, a.alias("_a"), p.alias("_p"))
    sup = base.groupBy(*keys, F.col("_a").alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.sum((F.col("_a") == F.col("_p")).cast("long")).alias("tp"))
    pc = base.groupBy(*keys, F.col("_p").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    j = sup.join(pc, [*keys, "label"], "full_outer").na.fill(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1)


def classification_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted F1 (6 dp)."""
    s = per_label_scores(df, actual, predicted, keys)
    g = s.groupBy(*keys).agg(F.sum("support").alias("n"), F.sum("tp").alias("_tp"),
                             F.sum(F.col("f1") * F.col("support")).alias("_wf1"))
    return g.select(*keys, "n", F.bround(F.col("_tp") / F.col("n"), 6).alias("accuracy"),
                    F.bround(F.col("_wf1") / F.col("n"), 6).alias("f1_weighted"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """A12 in long form: one row per (actual, predicted) pair with its count."""
    return df.groupBy(*keys, F.col(actual).cast("string").alias("actual"),
                      F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def improvement(current: Column, candidate: Column, metric: str, minimum_gain: float) -> dict[str, Column]:
    """L6 gain of a candidate over the current model on the same evaluation slice."""
    lower = lower_is_better(metric)
    gain = (current - candidate) if lower else (candidate - current)
    rel = (F.when(current != 0, gain / F.abs(current)).when(gain > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return {
        "absolute_gain": F.bround(gain, 6),
        "relative_gain": F.bround(rel, 6),
        "relative_gain_percent": F.bround(rel * 100.0, 4),
        "is_better": gain > 0,
        "meets_threshold": (gain > 0) & (rel >= F.lit(float(minimum_gain))),
    }
