"""Drift queries (L9): KS on numeric columns, Jensen–Shannon on categorical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import drift
from verdin.plans.registry import register
from verdin.sources.tables import table

CUTOFF = "1998-01-01 00:00:00"
NUMERIC = ("o_totalprice", "o_custkey")
CATEGORICAL = ("o_orderstatus", "o_orderpriority")


def periods(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reference = orders before 1998, current = orders from 1998 on (early vs late)."""
    o = table(spark, sf, "orders")
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut)


def _ks_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v, o_orderdate < TIMESTAMP '{CUTOFF}' AS is_ref "
        f"FROM orders WHERE {c} IS NOT NULL AND o_orderdate IS NOT NULL" for c in NUMERIC)
    return f"""
WITH u AS ({parts}),
c AS (SELECT column_name, v, count(*) FILTER (WHERE is_ref) AS c_ref, count(*) FILTER (WHERE NOT is_ref) AS c_cur
      FROM u GROUP BY 1, 2),
s AS (SELECT *, sum(c_ref) OVER (PARTITION BY column_name ORDER BY v) AS cr,
             sum(c_cur) OVER (PARTITION BY column_name ORDER BY v) AS cc,
             sum(c_ref) OVER (PARTITION BY column_name) AS n_ref, sum(c_cur) OVER (PARTITION BY column_name) AS n_cur
      FROM c)
SELECT column_name, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
  round_even(max(abs(cr / n_ref - cc / n_cur)), 6) AS statistic,
  round_even(1.358 * sqrt((n_ref + n_cur) / (n_ref * n_cur)), 6) AS threshold,
  max(abs(cr / n_ref - cc / n_cur)) > 1.358 * sqrt((n_ref + n_cur) / (n_ref * n_cur)) AS drifted
FROM s GROUP BY column_name, n_ref, n_cur"""


def _js_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, o_orderdate < TIMESTAMP '{CUTOFF}' AS is_ref "
        f"FROM orders WHERE {c} IS NOT NULL AND o_orderdate IS NOT NULL" for c in CATEGORICAL)
    return f"""
WITH u AS ({parts}),
c AS (SELECT column_name, v, count(*) FILTER (WHERE is_ref) AS c_ref, count(*) FILTER (WHERE NOT is_ref) AS c_cur
      FROM u GROUP BY 1, 2),
s AS (SELECT *, c_ref / sum(c_ref) OVER (PARTITION BY column_name) AS p,
             c_cur / sum(c_cur) OVER (PARTITION BY column_name) AS q FROM c),
m AS (SELECT *, (p + q) / 2 AS mm FROM s),
g AS (SELECT column_name, count(*) AS categories,
        0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / mm) ELSE 0 END)
        + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / mm) ELSE 0 END) AS js FROM m GROUP BY 1)
SELECT column_name, categories, round_even(js, 6) AS js_divergence, js > 0.1 AS drifted FROM g"""


@register("drift_numeric", _ks_sql())
def drift_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """L9 numeric: two-sample KS statistic from exact distributed cumulative counts."""
    ref, cur = periods(spark, sf)
    return drift.ks_statistics(ref, cur, NUMERIC)


@register("drift_categorical", _js_sql())
def drift_categorical(spark: SparkSession, sf: str) -> DataFrame:
    """L9 categorical: Jensen–Shannon divergence of category shares."""
    ref, cur = periods(spark, sf)
    return drift.js_divergence(ref, cur, CATEGORICAL)


@register("drift_summary", f"""
WITH k AS ({_ks_sql()}), j AS ({_js_sql()}),
t AS (SELECT drifted FROM k UNION ALL SELECT drifted FROM j)
SELECT count(*) AS columns_tested, count(*) FILTER (WHERE drifted) AS drifted_columns,
  round_even(count(*) FILTER (WHERE drifted) / count(*), 6) AS drift_share FROM t
""")
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    """L9 + J11: drifted column count and share over the common columns."""
    ref, cur = periods(spark, sf)
    return drift.drift_report(ref, cur, NUMERIC, CATEGORICAL)


@register("monitor_champion", f"""
WITH k AS ({_ks_sql()}), j AS ({_js_sql()}),
n AS (SELECT count(*) FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS n_ref, count(*) FILTER (o_orderdate >= TIMESTAMP '{CUTOFF}') AS n_cur FROM orders)
SELECT 'orders' AS project_id, 'before' AS reference_id, 'after' AS current_id, false AS same_dataset, t.* FROM (
  SELECT column_name, 'ks' AS test, n_ref, n_cur, statistic, drifted, true AS testable, NULL AS reason FROM k
  UNION ALL SELECT column_name, 'jensen_shannon', n.n_ref, n.n_cur, js_divergence, drifted, true, NULL FROM j, n
  UNION ALL SELECT 'remark', 'jensen_shannon', 0, n.n_cur, NULL, false, false, 'no values in the reference' FROM n) t
""")
def monitor_champion(spark: SparkSession, sf: str) -> DataFrame:
    """L9 as a flow: the champion's stored dataset against the project's latest one, column by column; one column has no
    values on the champion's side."""
    import datetime as dt
    import uuid

    from verdin.operators import flows, lifecycle
    from verdin.session import scratch_table_path
    from verdin.sources import tabular
    reg = lifecycle.Registry(spark, scratch_table_path(spark, f"monitor-{uuid.uuid4().hex[:12]}"))
    for version, part, remark in (("before", 0, None), ("after", 1, "late")):
        frame = periods(spark, sf)[part].select(*NUMERIC, *CATEGORICAL, F.lit(remark).cast("string").alias("remark"))
        tabular.save_dataset(frame, reg.root, "orders", version)
        tabular.register_dataset_version(spark, reg.root, frame, "orders", version, "o_totalprice")
        if part == 0:
            reg.register_model("orders", "m1", version, "regression", "rmse", 1.0, created_at=dt.datetime(2024, 1, 1))
    return flows.monitor(reg, "orders")
