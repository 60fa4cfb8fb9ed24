"""Model-quality queries: regression/classification metrics, confusion matrix,
improvement gate and stratified split (M5, M10–M12, A12, L6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import metrics as M
from verdin.operators import ml
from verdin.plans.registry import register
from verdin.sources.tables import table

# Stand-in models: fixed linear pricing rules (thousands per unit of quantity).
CURRENT_RATE = 4.765
CANDIDATE_RATE = 4.5
LENGTH_THRESHOLD = 2000


def priced_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                     (F.col("l_extendedprice") / 1000.0).alias("y"),
                     (F.col("l_quantity") * CURRENT_RATE).alias("p"),
                     (F.col("l_quantity") * CANDIDATE_RATE).alias("p_candidate"))


def _reg_sql(pcol: str, group: str) -> str:
    return f"""
g AS (SELECT {group}, count(*) AS n, sum((y - {pcol}) * (y - {pcol})) AS rss, avg(abs(y - {pcol})) AS mae,
             corr(y, {pcol}) AS c, stddev_pop(y) AS sy, stddev_pop({pcol}) AS sp, var_pop(y) AS vy FROM b GROUP BY 1)"""


_BASE_SQL = f"""b AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 1000.0 AS y, l_quantity * {CURRENT_RATE} AS p,
  l_quantity * {CANDIDATE_RATE} AS p_candidate FROM lineitem)"""


@register("regression_metrics", f"""
WITH {_BASE_SQL}, {_reg_sql("p", "l_returnflag")}
SELECT l_returnflag, n, CASE WHEN n >= 2 AND sy > 0 AND sp > 0 THEN round_even(c, 6) END AS r,
  round_even(rss / n, 6) AS mse, round_even(sqrt(rss / n), 6) AS rmse, round_even(mae, 6) AS mae,
  round_even(CASE WHEN vy * n > 0 THEN 1 - rss / (vy * n) WHEN rss = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
  round_even(n * ln(greatest(rss / n, 2.220446049250313e-16)) + 2.0, 6) AS aic,
  round_even(n * ln(greatest(rss / n, 2.220446049250313e-16)) + ln(n), 6) AS bic,
  CASE WHEN n - 2 > 0 THEN round_even(n * ln(greatest(rss / n, 2.220446049250313e-16)) + 2.0 + 4.0 / (n - 2), 6) END
    AS aicc,
  1 AS k
FROM g
""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """M10 per return flag: extended price (thousands) vs a fixed per-unit pricing rule."""
    return M.regression_metrics(priced_lines(spark, sf), "y", "p", ["l_returnflag"], k=1)


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    j = lab.join(d, "doc_id")
    return j.withColumn("predicted", (F.col("n_chars") >= LENGTH_THRESHOLD).cast("int"))


_CLS_BASE = f"""b AS (SELECT CAST(l.quality AS VARCHAR) AS a,
  CAST(CAST(d.n_chars >= {LENGTH_THRESHOLD} AS INTEGER) AS VARCHAR) AS p
  FROM labels l JOIN documents d USING (doc_id))"""


@register("classification_metrics", f"""
WITH {_CLS_BASE},
s AS (SELECT a AS label, count(*) AS support, sum(CASE WHEN a = p THEN 1 ELSE 0 END) AS tp FROM b GROUP BY 1),
pc AS (SELECT p AS label, count(*) AS predicted FROM b GROUP BY 1),
j AS (SELECT coalesce(s.label, pc.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(predicted, 0) AS predicted FROM s FULL OUTER JOIN pc ON s.label = pc.label),
f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM j),
f1 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM f)
SELECT CAST(sum(support) AS BIGINT) AS n, round_even(sum(tp) / sum(support), 6) AS accuracy,
  round_even(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f1
""")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Document quality labels vs a length rule — accuracy and weighted F1."""
    return M.classification_metrics(labelled_docs(spark, sf), "quality", "predicted")


@register("confusion_matrix", f"""
WITH {_CLS_BASE} SELECT a AS actual, p AS predicted, count(*) AS count FROM b GROUP BY 1, 2
""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A12 (long form) for the document quality rule."""
    return M.confusion_matrix(labelled_docs(spark, sf), "quality", "predicted")


@register("improvement_gate", f"""
WITH {_BASE_SQL},
g AS (SELECT l_linestatus, round_even(sqrt(avg((y - p) * (y - p))), 6) AS current_rmse,
             round_even(sqrt(avg((y - p_candidate) * (y - p_candidate))), 6) AS candidate_rmse FROM b GROUP BY 1),
h AS (SELECT *, current_rmse - candidate_rmse AS gain,
        CASE WHEN current_rmse <> 0 THEN (current_rmse - candidate_rmse) / abs(current_rmse)
             WHEN current_rmse - candidate_rmse > 0 THEN 1.0 ELSE 0.0 END AS rel FROM g)
SELECT l_linestatus, current_rmse, candidate_rmse, round_even(gain, 6) AS absolute_gain,
  round_even(rel, 6) AS relative_gain, round_even(rel * 100.0, 4) AS relative_gain_percent,
  gain > 0 AS is_better, gain > 0 AND rel >= 0.01 AS meets_threshold
FROM h
""")
def improvement_gate(spark: SparkSession, sf: str) -> DataFrame:
    """L6 + M12: challenger vs champion rmse per line status, 1 % minimum relative gain."""
    lines = priced_lines(spark, sf)
    a = M.regression_metrics(lines, "y", "p", ["l_linestatus"]).select("l_linestatus", F.col("rmse").alias("current_rmse"))
    b = M.regression_metrics(lines, "y", "p_candidate", ["l_linestatus"]).select(
        "l_linestatus", F.col("rmse").alias("candidate_rmse"))
    j = a.join(b, "l_linestatus")
    gain = M.improvement(F.col("current_rmse"), F.col("candidate_rmse"), "rmse", 0.01)
    return j.select("l_linestatus", "current_rmse", "candidate_rmse", *[v.alias(k) for k, v in gain.items()])


@register("stratified_split", """
WITH j AS (SELECT l.doc_id, l.quality FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '42')) AS rk,
             count(*) OVER (PARTITION BY quality) AS n FROM j)
SELECT doc_id, quality, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r
""")
def stratified_split_query(spark: SparkSession, sf: str) -> DataFrame:
    """M5: seeded stratified 80/20 split of labelled documents."""
    return ml.seeded_split(labelled_docs(spark, sf).select("doc_id", "quality"), "doc_id", 0.2, stratify="quality")
