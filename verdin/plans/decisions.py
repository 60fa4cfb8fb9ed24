"""Decision queries: forecast risk (flagship), factors, sampling, facts and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import decide
from verdin.operators.sampling import downsample_points
from verdin.operators.series import HISTORY_TAIL_ROWS, sequenced
from verdin.plans.inputs import hourly_events
from verdin.plans.registry import register

HORIZON = 24      # forecast points per series (the last day)
SEASON = 24       # seasonal-naive lag: prediction = value one day earlier


def seasonal_backtest(spark: SparkSession, sf: str):
    """Per series: the last HORIZON hours become forecast points predicted by the value
    SEASON positions back; the HISTORY_TAIL_ROWS rows before them are the recent history."""
    hourly = hourly_events(spark, sf)
    seq = sequenced(hourly, ["series_id"], ["ts"], halo=SEASON,
                    compute=lambda f, w: f.withColumn("prediction", F.lag("y", SEASON).over(w)))
    cut = F.col("_n") - HORIZON
    points = seq.filter(F.col("_pos") > cut).select(
        "series_id", (F.col("_pos") - cut).cast("int").alias("step"), "ts", "prediction", F.col("y").alias("actual"))
    history = seq.filter((F.col("_pos") <= cut) & (F.col("_pos") > cut - HISTORY_TAIL_ROWS))
    return points, history


def _forecast_decisions(spark: SparkSession, sf: str, rule_set: str = "forecast_default") -> DataFrame:
    points, history = seasonal_backtest(spark, sf)
    baseline = decide.forecast_baseline(history, ["series_id"], "ts", "y")
    return decide.forecast_decisions(points, baseline, ["series_id"], rule_set)


_R6 = lambda c: F.bround(F.col(c), 6).alias(c)


def forecast_risk_df(spark: SparkSession, sf: str, rule_set: str = "forecast_default") -> DataFrame:
    d = _forecast_decisions(spark, sf, rule_set)
    return d.select(
        "series_id", "step", "ts", _R6("prediction"), "risk_level", "rule_id", "scenario_id",
        "strong_positive_count", "medium_positive_count", "negative_count",
        F.concat_ws("|", F.col("top_factors.feature")).alias("factor_order"),
        _R6("recent_mean"), _R6("recent_std"), _R6("recent_p75"), _R6("recent_p90"), _R6("last_actual"))


_BACKTEST_SQL = """
WITH s AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS y
  FROM events GROUP BY 1, 2
), q AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
         count(*) OVER (PARTITION BY series_id) AS n,
         lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS prediction
  FROM s
), hist AS (SELECT * FROM q WHERE pos <= n - 24 AND pos > n - 24 - 240),
b AS (
  SELECT series_id, avg(y) AS recent_mean,
         CASE WHEN stddev_pop(y) < 1e-9 THEN greatest(abs(avg(y)) * 0.05, 1.0) ELSE stddev_pop(y) END AS recent_std,
         quantile_cont(y, 0.75) AS recent_p75, quantile_cont(y, 0.9) AS recent_p90,
         arg_max(y, ts) AS last_actual
  FROM hist GROUP BY 1
), pts AS (
  SELECT q.series_id, CAST(q.pos - (q.n - 24) AS INTEGER) AS step, q.ts, q.prediction, b.*
  EXCLUDE (series_id),
  coalesce(lag(q.prediction) OVER (PARTITION BY q.series_id ORDER BY q.pos), b.last_actual) AS prev
  FROM q JOIN b USING (series_id) WHERE q.pos > q.n - 24
), d AS (
  SELECT *,
    prediction - recent_mean AS d0, 0.35 * recent_std AS pos0, -0.35 * recent_std AS neg0,
    prediction - prev AS d1, 0.25 * recent_std AS pos1, -0.25 * recent_std AS neg1,
    prediction - recent_p90 AS d2, 0.0 AS pos2, -0.75 * recent_std AS neg2,
    CASE WHEN hour(ts) IN (7, 8, 9, 10, 17, 18, 19, 20, 21) THEN 1.0 ELSE -1.0 END AS d3
  FROM pts
), f AS (
  SELECT *,
    CASE WHEN d0 >= pos0 THEN 'positive' WHEN d0 <= neg0 THEN 'negative' ELSE 'neutral' END AS dir0,
    CASE WHEN d1 >= pos1 THEN 'positive' WHEN d1 <= neg1 THEN 'negative' ELSE 'neutral' END AS dir1,
    CASE WHEN d2 >= pos2 THEN 'positive' WHEN d2 <= neg2 THEN 'negative' ELSE 'neutral' END AS dir2,
    CASE WHEN d3 >= 1.0 THEN 'positive' ELSE 'negative' END AS dir3,
    CASE WHEN d0 >= pos0 OR d0 <= neg0 THEN abs(d0) / greatest(abs(pos0), abs(neg0), 1.0) ELSE 0.0 END AS r0,
    CASE WHEN d1 >= pos1 OR d1 <= neg1 THEN abs(d1) / greatest(abs(pos1), abs(neg1), 1.0) ELSE 0.0 END AS r1,
    CASE WHEN d2 >= pos2 OR d2 <= neg2 THEN abs(d2) / greatest(abs(pos2), abs(neg2), 1.0) ELSE 0.0 END AS r2,
    1.0 AS r3
  FROM d
), g AS (
  SELECT *,
    round_even(least(r0, 9.999999), 6) AS i0, round_even(least(r1, 9.999999), 6) AS i1,
    round_even(least(r2, 9.999999), 6) AS i2, round_even(least(r3, 9.999999), 6) AS i3,
    CASE WHEN r0 >= 0.66 THEN 'strong' WHEN r0 >= 0.33 THEN 'medium' ELSE 'weak' END AS s0,
    CASE WHEN r1 >= 0.66 THEN 'strong' WHEN r1 >= 0.33 THEN 'medium' ELSE 'weak' END AS s1,
    CASE WHEN r2 >= 0.66 THEN 'strong' WHEN r2 >= 0.33 THEN 'medium' ELSE 'weak' END AS s2,
    CASE WHEN r3 >= 0.66 THEN 'strong' WHEN r3 >= 0.33 THEN 'medium' ELSE 'weak' END AS s3,
    CASE WHEN prediction >= recent_p90 OR prediction >= recent_mean + recent_std THEN 'high'
         WHEN prediction >= recent_p75 OR prediction >= recent_mean + recent_std * 0.35 THEN 'medium'
         ELSE 'low' END AS risk_level
  FROM f
), h AS (
  SELECT *,
    CAST((i0 > 0 AND dir0 = 'positive' AND s0 = 'strong') AS INTEGER)
    + CAST((i1 > 0 AND dir1 = 'positive' AND s1 = 'strong') AS INTEGER)
    + CAST((i2 > 0 AND dir2 = 'positive' AND s2 = 'strong') AS INTEGER)
    + CAST((i3 > 0 AND dir3 = 'positive' AND s3 = 'strong') AS INTEGER) AS strong_positive_count,
    CAST((i0 > 0 AND dir0 = 'positive' AND s0 = 'medium') AS INTEGER)
    + CAST((i1 > 0 AND dir1 = 'positive' AND s1 = 'medium') AS INTEGER)
    + CAST((i2 > 0 AND dir2 = 'positive' AND s2 = 'medium') AS INTEGER)
    + CAST((i3 > 0 AND dir3 = 'positive' AND s3 = 'medium') AS INTEGER) AS medium_positive_count,
    CAST((i0 > 0 AND dir0 = 'negative') AS INTEGER) + CAST((i1 > 0 AND dir1 = 'negative') AS INTEGER)
    + CAST((i2 > 0 AND dir2 = 'negative') AS INTEGER) + CAST((i3 > 0 AND dir3 = 'negative') AS INTEGER)
      AS negative_count,
    array_to_string(list_transform(list_sort(list_filter([
        {'k': -i0, 'i': 0, 'f': 'deviation_from_recent_mean'},
        {'k': -i1, 'i': 1, 'f': 'deviation_from_previous_point'},
        {'k': -i2, 'i': 2, 'f': 'above_recent_p90'},
        {'k': -i3, 'i': 3, 'f': 'peak_hour'}], lambda x: x.k < 0)), lambda x: x.f), '|') AS factor_order
  FROM g
)
"""

_FORECAST_RULES_SQL = """
    CASE
      WHEN risk_level = 'high' THEN 'forecast_high_load_shedding'
      WHEN risk_level = 'medium' AND strong_positive_count >= 1 THEN 'forecast_medium_capacity_reallocation'
      WHEN risk_level = 'medium' AND negative_count >= 2 THEN 'forecast_medium_preventive_maintenance'
      WHEN risk_level = 'medium' THEN 'forecast_medium_watch_peak_window'
      WHEN risk_level = 'low' AND strong_positive_count >= 1 THEN 'forecast_low_watch_peak_window'
      WHEN risk_level = 'low' THEN 'forecast_low_observe'
      ELSE 'forecast_fallback_observe' END"""

_FORECAST_SCENARIO_SQL = """
    CASE
      WHEN risk_level = 'high' THEN 'load_shedding'
      WHEN risk_level = 'medium' AND strong_positive_count >= 1 THEN 'capacity_reallocation'
      WHEN risk_level = 'medium' AND negative_count >= 2 THEN 'preventive_maintenance'
      WHEN risk_level = 'medium' THEN 'watch_peak_window'
      WHEN risk_level = 'low' AND strong_positive_count >= 1 THEN 'watch_peak_window'
      ELSE 'observe' END"""

FORECAST_RISK_SQL = _BACKTEST_SQL + f"""
SELECT series_id, step, ts, round(prediction, 6) AS prediction, risk_level,
  {_FORECAST_RULES_SQL} AS rule_id,
  {_FORECAST_SCENARIO_SQL} AS scenario_id,
  strong_positive_count, medium_positive_count, negative_count, factor_order,
  round(recent_mean, 6) AS recent_mean, round(recent_std, 6) AS recent_std,
  round(recent_p75, 6) AS recent_p75, round(recent_p90, 6) AS recent_p90, round(last_actual, 6) AS last_actual
FROM h
"""


@register("forecast_risk", FORECAST_RISK_SQL)
def forecast_risk(spark: SparkSession, sf: str) -> DataFrame:
    """D9–D11 + A13 + W14 + D3 on hourly event series with seasonal-naive predictions."""
    return forecast_risk_df(spark, sf)


_FORECAST_FIELDS = {"risk_level", "strong_positive_count", "medium_positive_count", "negative_count", "prediction",
                    "confidence"}


def _forecast_rules_sql(rule_set: str) -> str:
    from verdin.plans.sqlgen import rule_case_sql
    return _BACKTEST_SQL + f"""
SELECT series_id, step, ts, round(prediction, 6) AS prediction, risk_level,
  {rule_case_sql(rule_set, "rule_id", _FORECAST_FIELDS)} AS rule_id,
  {rule_case_sql(rule_set, "scenario", _FORECAST_FIELDS)} AS scenario_id,
  strong_positive_count, medium_positive_count, negative_count, factor_order,
  round(recent_mean, 6) AS recent_mean, round(recent_std, 6) AS recent_std,
  round(recent_p75, 6) AS recent_p75, round(recent_p90, 6) AS recent_p90, round(last_actual, 6) AS last_actual
FROM h
"""


@register("forecast_risk_conservative", _forecast_rules_sql("forecast_conservative"))
def forecast_risk_conservative(spark: SparkSession, sf: str) -> DataFrame:
    """D11 with the conservative forecast rule set (Q11: selectable rule set)."""
    return forecast_risk_df(spark, sf, "forecast_conservative")


@register("forecast_factors", _BACKTEST_SQL + """,
u AS (
  SELECT series_id, step, unnest([
    {'k': -i0, 'i': 0, 'f': 'deviation_from_recent_mean', 'd': dir0, 's': s0},
    {'k': -i1, 'i': 1, 'f': 'deviation_from_previous_point', 'd': dir1, 's': s1},
    {'k': -i2, 'i': 2, 'f': 'above_recent_p90', 'd': dir2, 's': s2},
    {'k': -i3, 'i': 3, 'f': 'peak_hour', 'd': dir3, 's': s3}]) AS x FROM g)
SELECT series_id, step, CAST(row_number() OVER (PARTITION BY series_id, step ORDER BY x.k, x.i) AS INTEGER) AS rank,
  x.f AS feature, x.d AS direction, x.s AS strength, -x.k AS impact_score
FROM u WHERE x.k < 0
""")
def forecast_factors(spark: SparkSession, sf: str) -> DataFrame:
    """D10 + K2: ranked forecast factors per point (impact > 0, descending)."""
    d = _forecast_decisions(spark, sf)
    ex = d.select("series_id", "step", F.posexplode("top_factors").alias("pos", "f"))
    return ex.select("series_id", "step", (F.col("pos") + 1).cast("int").alias("rank"),
                     F.col("f.feature").alias("feature"), F.col("f.direction").alias("direction"),
                     F.col("f.strength").alias("strength"), F.col("f.impact_score").alias("impact_score"))


POINT_COUNT = 7


@register("downsample_points", f"""
WITH {_BACKTEST_SQL.strip()[5:].split("), hist AS")[0]}),
pts AS (SELECT series_id, CAST(pos - (n - 24) AS INTEGER) AS step, ts, prediction FROM q
        WHERE pos > n - 24 AND ts IS NOT NULL AND prediction IS NOT NULL AND isfinite(prediction)),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY step) - 1 AS idx,
             count(*) OVER (PARTITION BY series_id) AS cnt FROM pts)
SELECT series_id, step, ts, round(prediction, 6) AS prediction FROM r
WHERE cnt <= {POINT_COUNT} OR list_contains(list_transform(range({POINT_COUNT}),
  lambda i: CAST(round_even(i / {POINT_COUNT - 1}.0 * (cnt - 1), 0) AS BIGINT)), idx)
""")
def downsample_points_query(spark: SparkSession, sf: str) -> DataFrame:
    """K3: evenly sample 7 of each series' forecast points (first and last always kept)."""
    points, _ = seasonal_backtest(spark, sf)
    out = downsample_points(points.select("series_id", "step", "ts", "prediction"), ["series_id"], "step", POINT_COUNT)
    return out.select("series_id", "step", "ts", _R6("prediction"))
