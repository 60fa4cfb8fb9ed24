"""Time-axis and series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.functions import timefuncs as tf
from verdin.operators import asof, merge, temporal
from verdin.operators.series import (LAG_CANDIDATES, ROLLING_CANDIDATES, autoregressive_features, chrono_split,
                                     eval_tail, history_window, series_gate)
from verdin.plans.decisions import seasonal_backtest
from verdin.plans.inputs import hourly_events
from verdin.plans.registry import register
from verdin.sources.tables import table


def duration_sql(seconds_expr: str) -> str:
    s = f"CAST(round({seconds_expr}) AS BIGINT)"
    return (f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} <= 0 THEN '0 мин' "
            f"WHEN {s} % 86400 = 0 THEN CAST({s} // 86400 AS VARCHAR) || ' дн' "
            f"WHEN {s} % 3600 = 0 THEN CAST({s} // 3600 AS VARCHAR) || ' ч' "
            f"WHEN {s} % 60 = 0 THEN CAST({s} // 60 AS VARCHAR) || ' мин' "
            f"ELSE CAST({s} AS VARCHAR) || ' сек' END")


def temporal_context_sql(tbl: str, col: str) -> str:
    return f"""
WITH u AS (SELECT DISTINCT {col} AS t FROM {tbl} WHERE {col} IS NOT NULL),
d AS (SELECT epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t)) AS du FROM u),
m AS (SELECT du FROM d WHERE du > 0 GROUP BY du ORDER BY count(*) DESC, du ASC LIMIT 1),
b AS (SELECT count({col}) AS rows_with_timestamp, count(DISTINCT {col}) AS unique_timestamps,
             min({col}) AS start, max({col}) AS "end" FROM {tbl}),
x AS (SELECT b.*, (SELECT du FROM m) AS freq_us, epoch_us("end") - epoch_us(start) AS span_us FROM b)
SELECT '{col}' AS column_name, rows_with_timestamp, unique_timestamps, start, "end",
  round_even(freq_us / 6e7, 6) AS frequency_minutes,
  CASE WHEN freq_us IS NOT NULL THEN CAST(round_even(span_us / freq_us, 0) AS BIGINT) + 1 END AS expected_points,
  coalesce(freq_us IS NOT NULL AND CAST(round_even(span_us / freq_us, 0) AS BIGINT) + 1 > unique_timestamps, false)
    AS has_gaps,
  {duration_sql("span_us / 1e6")} AS range_label,
  {duration_sql("freq_us / 1e6")} AS frequency_label
FROM x
"""


@register("temporal_context", temporal_context_sql("orders", "o_orderdate"))
def temporal_context_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A6 on the daily order dates."""
    return temporal.temporal_context(spark, table(spark, sf, "orders"), "o_orderdate")


@register("temporal_context_events", temporal_context_sql("events", "ts"))
def temporal_context_events(spark: SparkSession, sf: str) -> DataFrame:
    """A6 on irregular event timestamps (modal gap over unique timestamps)."""
    return temporal.temporal_context(spark, table(spark, sf, "events"), "ts")


def events_as_text(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
                     F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
                     (F.hour("ts") + 1).alias("hour_of_day"), "event_type", "value")


def _rate_sql(col: str) -> str:
    from verdin.plans.sqlgen import _ts_parse
    p = _ts_parse(f"CAST({col} AS VARCHAR)")
    guard = f"NOT coalesce(regexp_full_match(trim(CAST({col} AS VARCHAR)), '^\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?$'), false)"
    parsed = f"CASE WHEN {guard} THEN CAST({p} AS TIMESTAMP) END"
    return f"avg(CASE WHEN {parsed} IS NOT NULL THEN 1.0 ELSE 0.0 END)", f"count(DISTINCT {parsed})"


_TEXT_EVENTS = """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, strftime(ts, '%Y-%m-%d') AS day_text,
  CAST(hour(ts) + 1 AS INTEGER) AS hour_of_day, event_type, value FROM events"""


def _time_axis_sql() -> str:
    parts = []
    for pos, c in ((1, "ts_text"), (2, "day_text"), (4, "event_type")):
        r, d = _rate_sql(c)
        parts.append(f"SELECT '{c}' AS column_name, {pos} AS position, {r} AS parse_rate, {d} AS distinct_parsed FROM t")
    body = " UNION ALL ".join(parts)
    return f"""
WITH t AS ({_TEXT_EVENTS}), c AS ({body}),
e AS (SELECT *, parse_rate >= 0.8 AND distinct_parsed > 1 AS eligible FROM c)
SELECT column_name, CAST(position AS INTEGER) AS position, round_even(parse_rate, 6) AS parse_rate, distinct_parsed,
  eligible, eligible AND row_number() OVER (ORDER BY eligible DESC, parse_rate DESC, position ASC) = 1 AS chosen
FROM e
"""


@register("time_axis_pick", _time_axis_sql())
def time_axis_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Score every text column of events-as-text as a direct time axis and pick one."""
    c = temporal.direct_candidates(events_as_text(spark, sf), target="value")
    return c.withColumn("parse_rate", F.bround("parse_rate", 6))


@register("date_hour_timestamps", """
SELECT event_id, CASE WHEN hour_of_day BETWEEN 0 AND 23
  THEN CAST(strptime(day_text, '%Y-%m-%d') AS TIMESTAMP) + to_hours(CAST(hour_of_day AS BIGINT)) END AS ts_built
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_text, CAST(hour(ts) + 1 AS INTEGER) AS hour_of_day FROM events)
""")
def date_hour_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + J3: detect the hour column (0–23 vs 1–24 offset) and build day + hour timestamps."""
    df = events_as_text(spark, sf).select("event_id", "day_text", "hour_of_day")
    hours = temporal.hour_candidates(df)
    hcol, off = hours[0]
    d = temporal.TimestampDescriptor("date_hour_columns", date_column="day_text", hour_column=hcol, hour_offset=off)
    return df.select("event_id", temporal.build_timestamp(df, d).alias("ts_built"))


@register("dedupe_by_timestamp", """
SELECT time_bucket(INTERVAL '10 minutes', ts) AS ts10, count(*) AS n_rows,
  arg_max(user_id, CASE WHEN user_id IS NOT NULL THEN event_id END) AS user_id,
  arg_max(event_type, CASE WHEN event_type IS NOT NULL THEN event_id END) AS event_type,
  arg_max(value, CASE WHEN value IS NOT NULL THEN event_id END) AS value
FROM events WHERE ts IS NOT NULL GROUP BY 1
""")
def dedupe_by_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """One row per 10-minute timestamp, last non-null value per column by event order."""
    ev = table(spark, sf, "events").withColumn("ts10", tf.floor_to("ts", 600))
    return temporal.last_non_null_per_timestamp(ev, [], "ts10", "event_id", ["user_id", "event_type", "value"])


def _source_frame(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    ev = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return (ev.groupBy(tf.floor_to("ts", 3600).alias("ts"))
            .agg(F.bround(F.sum("value"), 6).alias("value"), F.count_distinct("user_id").cast("double").alias("users")))


def prepare_for_merge(df: DataFrame, ordinal: str) -> DataFrame:
    """Attach the inferred time axis as ``timestamp`` (J1/J2 → J3), drop the source time
    column and keep one row per timestamp (J4)."""
    d = temporal.infer_descriptor(df.drop(ordinal))
    if d is None:
        raise ValueError("could not infer a time axis")
    src = d.timestamp_column or d.date_column
    out = df.withColumn("timestamp", temporal.build_timestamp(df, d)).drop(src)
    cols = [c for c in out.columns if c not in ("timestamp", ordinal)]
    return temporal.last_non_null_per_timestamp(out, [], "timestamp", ordinal, cols).drop("n_rows")


@register("multi_source_merge", """
WITH c AS (SELECT date_trunc('hour', ts) AS timestamp, round(sum(value), 6) AS value, CAST(count(DISTINCT user_id) AS DOUBLE) AS users
           FROM events WHERE event_type = 'click' GROUP BY 1),
v AS (SELECT date_trunc('hour', ts) AS timestamp, round(sum(value), 6) AS value, CAST(count(DISTINCT user_id) AS DOUBLE) AS users
      FROM events WHERE event_type = 'view' GROUP BY 1),
p AS (SELECT date_trunc('hour', ts) AS timestamp, round(sum(value), 6) AS value, CAST(count(DISTINCT user_id) AS DOUBLE) AS users
      FROM events WHERE event_type = 'purchase' GROUP BY 1),
m1 AS (SELECT coalesce(c.timestamp, v.timestamp) AS timestamp, coalesce(c.value, v.value) AS value,
              coalesce(c.users, v.users) AS users, v.value AS value__view, v.users AS users__view
       FROM c FULL OUTER JOIN v ON c.timestamp = v.timestamp),
m2 AS (SELECT coalesce(m1.timestamp, p.timestamp) AS timestamp, coalesce(m1.value, p.value) AS value,
              coalesce(m1.users, p.users) AS users, value__view, users__view,
              p.value AS value__purchase, p.users AS users__purchase
       FROM m1 FULL OUTER JOIN p ON m1.timestamp = p.timestamp)
SELECT * FROM m2 WHERE value IS NOT NULL
""")
def multi_source_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Three hourly sources (click, view, purchase) merged on an inferred time axis."""
    frames = []
    for kind in ("click", "view", "purchase"):
        f = _source_frame(spark, sf, kind)
        f = f.withColumn("_ord", tf.epoch_seconds("ts"))
        frames.append((f"{kind}.csv", prepare_for_merge(f, "_ord")))
    return merge.merge_on_time(frames, key="timestamp", target="value")


_SERIES_CTE = """
s AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS y FROM events GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
             count(*) OVER (PARTITION BY series_id) AS n,
             lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS prediction FROM s),
pts AS (SELECT series_id, CAST(pos - (n - 24) AS INTEGER) AS step, ts, prediction FROM q WHERE pos > n - 24)"""

_MATCH_SQL = f"""
WITH {_SERIES_CTE},
cand AS (
  SELECT p.series_id, p.step, e.ts AS matched_ts, e.value AS actual,
    row_number() OVER (PARTITION BY p.series_id, p.step
                       ORDER BY abs(epoch_us(e.ts) - epoch_us(p.ts)), e.event_id) AS rk
  FROM pts p JOIN events e ON e.event_type = p.series_id AND abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 1800000000),
m AS (SELECT p.series_id, p.step, p.ts, round(p.prediction, 6) AS prediction, c.matched_ts, c.actual
      FROM pts p LEFT JOIN (SELECT * FROM cand WHERE rk = 1) c USING (series_id, step)),
r AS (SELECT *, round_even(actual - prediction, 6) AS abs_error,
        CASE WHEN actual IS NOT NULL AND actual <> 0 THEN round_even(abs(actual - prediction) / abs(actual) * 100, 4) END
          AS ape FROM m)"""


def _postfactum(spark: SparkSession, sf: str) -> DataFrame:
    points, _ = seasonal_backtest(spark, sf)
    points = points.select("series_id", "step", "ts", F.bround("prediction", 6).alias("prediction"))
    actuals = table(spark, sf, "events").select(F.col("event_type").alias("series_id"),
                                                F.col("ts").alias("actual_ts"), F.col("value").alias("actual"),
                                                "event_id")
    matched = asof.nearest_match(points, actuals, ["series_id"], tolerance_seconds=1800,
                                 pred_id=["series_id", "step"], actual_order=["event_id"])
    return asof.postfactum_errors(matched)


@register("postfactum_match", _MATCH_SQL + "\nSELECT * FROM r")
def postfactum_match(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast points matched to the nearest raw event within half the hourly cadence."""
    return _postfactum(spark, sf)


@register("postfactum_summary", _MATCH_SQL + """
SELECT series_id, count(*) AS points, count(actual) AS matched, round_even(avg(abs(abs_error)), 6) AS mean_abs_error,
  round_even(avg(ape), 4) AS mean_ape FROM r GROUP BY 1""")
def postfactum_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Matched count, mean absolute error and MAPE per series."""
    return asof.comparison_summary(_postfactum(spark, sf), ["series_id"])


@register("timeline_merge", f"""
WITH {_SERIES_CTE},
u AS (
  SELECT series_id, ts, y AS actual, NULL::DOUBLE AS fitted, NULL::DOUBLE AS forecast FROM q WHERE pos <= n - 24
  UNION ALL SELECT series_id, ts, NULL, prediction, NULL FROM q WHERE pos <= n - 24 AND prediction IS NOT NULL
  UNION ALL SELECT series_id, ts, NULL, NULL, prediction FROM pts)
SELECT series_id, ts, max(actual) AS actual, round(max(fitted), 6) AS fitted, round(max(forecast), 6) AS forecast
FROM u GROUP BY 1, 2
""")
def timeline_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Actual, fitted and forecast streams aligned per (series, ts) in one shuffle."""
    from verdin.operators.series import sequenced
    hourly = hourly_events(spark, sf)
    seq = sequenced(hourly, ["series_id"], ["ts"], halo=24,
                    compute=lambda f, w: f.withColumn("prediction", F.lag("y", 24).over(w)))
    hist = seq.filter(F.col("_pos") <= F.col("_n") - 24)
    streams = {
        "actual": hist.select("series_id", "ts", F.col("y").alias("value")),
        "fitted": hist.filter(F.col("prediction").isNotNull()).select("series_id", "ts", F.col("prediction").alias("value")),
        "forecast": seq.filter(F.col("_pos") > F.col("_n") - 24).select("series_id", "ts", F.col("prediction").alias("value")),
    }
    out = merge.timeline(streams, ["series_id"], "ts")
    return out.select("series_id", "ts", "actual", F.bround("fitted", 6).alias("fitted"),
                      F.bround("forecast", 6).alias("forecast"))


@register("datetime_features", """
SELECT o_orderkey, coalesce(CAST(epoch(o_orderdate) AS BIGINT), 0) AS o_orderdate__ts,
  CAST(coalesce(hour(o_orderdate), 0) AS INTEGER) AS o_orderdate__hour,
  CAST(coalesce(isodow(o_orderdate) - 1, 0) AS INTEGER) AS o_orderdate__dayofweek,
  CAST(coalesce(month(o_orderdate), 0) AS INTEGER) AS o_orderdate__month
FROM orders
""")
def datetime_features(spark: SparkSession, sf: str) -> DataFrame:
    """X1 projection of o_orderdate."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", *tf.datetime_projection(F.col("o_orderdate"), "o_orderdate"))




def _time_text(ts, kind, props):
    hm = F.concat(F.hour(ts).cast("string"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"))
    hms = F.concat(hm, F.lit(":"), F.lpad(F.second(ts).cast("string"), 2, "0"))
    return F.when(kind == "error", props).when(kind == "click", hms).otherwise(hm)


@register("time_minutes", r"""
WITH t AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN props
    WHEN event_type = 'click' THEN CAST(hour(ts) AS VARCHAR) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0')
         || ':' || lpad(CAST(CAST(floor(second(ts)) AS BIGINT) AS VARCHAR), 2, '0')
    ELSE CAST(hour(ts) AS VARCHAR) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') END AS time_text
  FROM events),
p AS (SELECT *, string_split(trim(time_text), ':') AS parts FROM t)
SELECT event_id, time_text, round_even(coalesce(CASE WHEN len(parts) IN (2, 3)
    AND regexp_full_match(parts[1], '[+-]?\d+') AND regexp_full_match(parts[2], '[+-]?\d+')
    AND (len(parts) = 2 OR regexp_full_match(parts[3], '[+-]?\d+'))
  THEN CAST(CAST(parts[1] AS BIGINT) * 60 + CAST(parts[2] AS BIGINT) AS DOUBLE)
       + (CASE WHEN len(parts) = 3 THEN CAST(parts[3] AS BIGINT) ELSE 0 END) / 60.0 END, 0.0), 6) AS minutes
FROM p
""")
def time_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """X2 on time-of-day strings rendered from events (error rows carry non-time text → 0.0)."""
    ev = table(spark, sf, "events")
    t = ev.select("event_id", _time_text(F.col("ts"), F.col("event_type"), F.col("props")).alias("time_text"))
    return t.select("event_id", "time_text", F.bround(F.coalesce(tf.time_to_minutes("time_text"), F.lit(0.0)), 6)
                    .alias("minutes"))


def _calendar_sql(ts: str) -> str:
    hf = f"(hour({ts}) + minute({ts}) / 60.0)"
    wd = f"CAST(isodow({ts}) - 1 AS DOUBLE)"
    mo = f"CAST(month({ts}) AS DOUBLE)"
    cols = {
        "timestamp_unix": f"CAST(epoch({ts}) AS DOUBLE)", "hour": hf, "minute": f"CAST(minute({ts}) AS DOUBLE)",
        "dayofweek": wd, "dayofyear": f"CAST(dayofyear({ts}) AS DOUBLE)", "month": mo,
        "is_weekend": f"CASE WHEN {wd} >= 5 THEN 1.0 ELSE 0.0 END",
        "hour_sin": f"sin(2 * pi() * {hf} / 24.0)", "hour_cos": f"cos(2 * pi() * {hf} / 24.0)",
        "weekday_sin": f"sin(2 * pi() * {wd} / 7.0)", "weekday_cos": f"cos(2 * pi() * {wd} / 7.0)",
        "month_sin": f"sin(2 * pi() * {mo} / 12.0)", "month_cos": f"cos(2 * pi() * {mo} / 12.0)",
    }
    return ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in cols.items())


@register("calendar_features", f"""
SELECT ts, {_calendar_sql("ts")} FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events)
""")
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    """X3 calendar and cyclic features for every hourly timestamp."""
    hours = table(spark, sf, "events").select(tf.floor_to("ts", 3600).alias("ts")).distinct()
    feats = tf.calendar_features(F.col("ts"))
    return hours.select("ts", *[(F.bround(c, 6) + F.lit(0.0)).alias(n) for c, n in zip(feats, tf.CALENDAR_COLUMNS)])


def _window_sql(lags, widths, diff=True, digits=6) -> str:
    w = "PARTITION BY series_id ORDER BY ts"
    out = [f"lag(y, {k}) OVER ({w}) AS target_lag_{k}" for k in lags]
    for n in widths:
        fr = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out += [f"round(avg(y) OVER {fr}, {digits}) AS target_roll_mean_{n}",
                f"round(stddev_pop(y) OVER {fr}, {digits}) AS target_roll_std_{n}",
                f"min(y) OVER {fr} AS target_roll_min_{n}", f"max(y) OVER {fr} AS target_roll_max_{n}"]
    if diff:
        out.append(f"coalesce(lag(y, 1) OVER ({w}) - lag(y, 2) OVER ({w}), 0.0) AS target_diff_1")
    return ", ".join(out)


_HOURLY = "(SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS y FROM events GROUP BY 1, 2)"


def _round_features(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for c in df.columns:
        if c.startswith("target_roll_mean") or c.startswith("target_roll_std"):
            cols.append(F.bround(c, digits).alias(c))
        elif c == "target_diff_1":
            cols.append(F.bround(c, 6).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


@register("lag_features", f"""
SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS position,
  {", ".join(f"lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ts) AS target_lag_{k}" for k in LAG_CANDIDATES)},
  round(coalesce(lag(y, 1) OVER (PARTITION BY series_id ORDER BY ts) - lag(y, 2) OVER (PARTITION BY series_id ORDER BY ts), 0.0), 6) AS target_diff_1
FROM {_HOURLY}
""")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    """W1 + W3 per hourly event series (all rows, with 1-based position)."""
    from verdin.operators.series import diff_column, lag_columns, sequenced
    hourly = hourly_events(spark, sf)
    out = sequenced(hourly, ["series_id"], ["ts"], halo=max(LAG_CANDIDATES),
                    compute=lambda f, w: f.select("*", *lag_columns("y", w, LAG_CANDIDATES), diff_column("y", w)))
    out = out.withColumnRenamed("_pos", "position").drop("_n")
    return _round_features(out)


@register("rolling_features", f"""
SELECT series_id, ts, y, {_window_sql([], ROLLING_CANDIDATES, diff=False)} FROM {_HOURLY}
""")
def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling mean/std/min/max over the previous 3–48 rows, current row excluded."""
    from verdin.operators.series import rolling_columns, sequenced
    hourly = hourly_events(spark, sf)
    out = sequenced(hourly, ["series_id"], ["ts"], halo=max(ROLLING_CANDIDATES),
                    compute=lambda f, w: f.select("*", *rolling_columns("y", w, ROLLING_CANDIDATES)))
    return _round_features(out.drop("_pos", "_n"))


@register("feature_table", f"""
SELECT * EXCLUDE (position) FROM (
  SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS position,
    {_window_sql(LAG_CANDIDATES, ROLLING_CANDIDATES)}, {_calendar_sql("ts")}
  FROM {_HOURLY}) WHERE position > 48
""".replace("coalesce(lag(y, 1) OVER (PARTITION BY series_id ORDER BY ts) - lag(y, 2) OVER (PARTITION BY series_id ORDER BY ts), 0.0) AS target_diff_1",
            "round(coalesce(lag(y, 1) OVER (PARTITION BY series_id ORDER BY ts) - lag(y, 2) OVER (PARTITION BY series_id ORDER BY ts), 0.0), 6) AS target_diff_1"))
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Supervised table (lags, rolling stats, diff, calendar) with rows past the required history."""
    feats = autoregressive_features(hourly_events(spark, sf), ["series_id"], "ts", "y")
    cal = tf.calendar_features(F.col("ts"))
    out = feats.select("*", *[(F.bround(c, 6) + F.lit(0.0)).alias(n) for c, n in zip(cal, tf.CALENDAR_COLUMNS)]).drop("_pos", "_n")
    return _round_features(out)


@register("series_gate", f"""
WITH a AS (SELECT series_id, count(*) AS n_rows FROM {_HOURLY} GROUP BY 1),
b AS (SELECT *, greatest(2, {", ".join(f"CASE WHEN {k} < n_rows THEN {k} ELSE 2 END" for k in sorted(set(LAG_CANDIDATES + ROLLING_CANDIDATES)))}) AS required_history FROM a)
SELECT series_id, n_rows, required_history, n_rows - required_history AS feature_rows,
  (n_rows >= 12 AND n_rows > 1 AND n_rows > required_history + 4 AND n_rows - required_history >= 8
   AND (n_rows - required_history) - greatest(1, CAST(round_even((n_rows - required_history) * 0.2, 0) AS BIGINT)) >= 6)
   AS eligible
FROM b
""")
def series_gate_query(spark: SparkSession, sf: str) -> DataFrame:
    """W5 eligibility gates per hourly series."""
    return series_gate(hourly_events(spark, sf), ["series_id"]).select(
        "series_id", "n_rows", F.col("required_history").cast("long").alias("required_history"),
        F.col("feature_rows").cast("long").alias("feature_rows"), "eligible")


@register("cadence", f"""
WITH d AS (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS gap FROM {_HOURLY})
SELECT series_id, quantile_cont(gap, 0.5) AS median_gap_s,
  greatest(1, CAST(round_even(quantile_cont(gap, 0.5) / 60.0, 0) AS BIGINT)) AS cadence_minutes
FROM d WHERE gap > 0 GROUP BY 1
""")
def cadence(spark: SparkSession, sf: str) -> DataFrame:
    """Median positive gap per hourly series in whole minutes."""
    return temporal.cadence_minutes(hourly_events(spark, sf), ["series_id"], "ts")


@register("cadence_orders", """
WITH u AS (SELECT DISTINCT o_orderdate AS t FROM orders WHERE o_orderdate IS NOT NULL),
d AS (SELECT epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS gap FROM u)
SELECT quantile_cont(gap, 0.5) AS median_gap_s,
  greatest(1, CAST(round_even(quantile_cont(gap, 0.5) / 60.0, 0) AS BIGINT)) AS cadence_minutes
FROM d WHERE gap > 0
""")
def cadence_orders(spark: SparkSession, sf: str) -> DataFrame:
    """W6 on the whole order-date axis (no series key)."""
    o = table(spark, sf, "orders").select("o_orderdate")
    return temporal.cadence_minutes(o, [], "o_orderdate")


@register("chrono_split", f"""
WITH q AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
                  count(*) OVER (PARTITION BY series_id) AS n FROM {_HOURLY})
SELECT series_id, ts, CASE WHEN pos > n - greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) THEN 'test' ELSE 'train' END
  AS split FROM q
""")
def chrono_split_query(spark: SparkSession, sf: str) -> DataFrame:
    """Chronological 80/20 split per hourly series."""
    return chrono_split(hourly_events(spark, sf), ["series_id"], ["ts"]).select("series_id", "ts", "split")


@register("history_window_30d", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
""")
def history_window_30d(spark: SparkSession, sf: str) -> DataFrame:
    """Orders within 30 days of the last order date."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return history_window(o, [], "o_orderdate", 30)


@register("eval_tail", """
WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER () AS n
           FROM orders)
SELECT o_orderkey, CASE WHEN pos > n - greatest(2, CAST(round_even(n * 0.2, 0) AS BIGINT)) THEN 'evaluation'
  ELSE 'train' END AS role FROM q
""")
def eval_tail_query(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 20 % of orders (at least 2) are reserved for evaluation."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return eval_tail(o, [], ["o_orderdate", "o_orderkey"], 0.2).select("o_orderkey", "role")


@register("union_dedupe", """
SELECT DISTINCT * FROM (
  SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
  UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01')
""")
def union_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """History (before 1999) plus an overlapping new batch (from mid-1998), duplicates dropped."""
    o = table(spark, sf, "orders")
    hist = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).withColumn("_ord", F.lit(0))
    batch = o.filter(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).withColumn("_ord", F.lit(1))
    return merge.append_dedupe(hist, batch, "_ord").drop("_ord")


@register("forecast_request", f"""
WITH d AS (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS gap FROM {_HOURLY}),
c AS (SELECT series_id, greatest(1, CAST(round_even(quantile_cont(gap, 0.5) / 60.0, 0) AS BIGINT)) AS cadence_minutes
      FROM d WHERE gap > 0 GROUP BY 1),
r AS (SELECT *, CAST(least(greatest(round(cadence_minutes * 7.5 / 10.0) * 10, 10.0), 1440.0) AS INTEGER) AS interval_minutes
      FROM c)
SELECT series_id, cadence_minutes, interval_minutes,
  CAST(greatest(ceil(interval_minutes / greatest(cadence_minutes, 1)), 1) AS INTEGER) AS steps FROM r
""")
def forecast_request(spark: SparkSession, sf: str) -> DataFrame:
    """A request of 7.5 cadences per series, rounded to 10 minutes in [10, 1440],
    turned into a step count."""
    from verdin.functions.numeric import forecast_steps, normalize_interval
    c = temporal.cadence_minutes(hourly_events(spark, sf), ["series_id"], "ts").select("series_id", "cadence_minutes")
    r = c.withColumn("interval_minutes", normalize_interval(F.col("cadence_minutes") * 7.5))
    return r.withColumn("steps", forecast_steps(F.col("interval_minutes"), F.col("cadence_minutes")))


@register("forecast_points", """
WITH r AS (SELECT o_orderkey, o_totalprice / 100.0 - 200 AS asked, 1 + o_custkey % 97 AS cadence, o_totalprice / 1000.0 - 20 AS preferred FROM orders),
i AS (SELECT *, CASE WHEN asked > 0 THEN CAST(least(greatest(round(asked / 10) * 10, 10), 1440) AS INTEGER) ELSE 120 END AS interval_minutes FROM r),
s AS (SELECT *, CAST(greatest(1, ceil(interval_minutes / cadence)) AS INTEGER) AS steps FROM i),
n AS (SELECT s.o_orderkey, arg_min(c.n, (abs(c.n - s.preferred), c.n)) AS near FROM s JOIN (SELECT unnest(range(1, 721)) AS n) c ON c.n <= s.steps WHERE s.preferred > 0 GROUP BY 1)
SELECT o_orderkey, interval_minutes, steps, CAST(steps * cadence AS BIGINT) AS total_minutes, CAST(coalesce(near, least(steps, 720)) AS INTEGER) AS point_count,
       round_even(steps * cadence / coalesce(near, least(steps, 720)), 6) AS display_step_minutes FROM s LEFT JOIN n USING (o_orderkey)
""")
def forecast_points(spark: SparkSession, sf: str) -> DataFrame:
    """A request per order (interval, cadence and wished point count from its columns, some of them not usable), shaped; the SQL searches
    the allowed counts one by one."""
    from verdin.functions.numeric import request_shape
    o = table(spark, sf, "orders")
    cadence = 1 + F.col("o_custkey") % 97
    return o.select("o_orderkey", *request_shape(F.col("o_totalprice") / 100.0 - 200, cadence, F.col("o_totalprice") / 1000.0 - 20))


@register("temporal_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate IS NOT NULL
""")
def temporal_order(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every order on the time axis (ties by key); orders under way have no time yet and go."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    return temporal.temporal_order(o, "at", "o_orderkey", position="position").select("o_orderkey", "position")


@register("record_time", """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 3 DAY END AS d, CASE WHEN l_linestatus = 'F' THEN l_shipdate - INTERVAL 90 MINUTE END AS c, l_shipdate FROM lineitem)
SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT AS shipped_ts, hour(l_shipdate)::INTEGER AS shipped_hour, (isodow(l_shipdate) - 1)::INTEGER AS shipped_weekday,
       month(l_shipdate)::INTEGER AS shipped_month, CAST(coalesce(d, c, l_shipdate) AS TIMESTAMP) AS record_time FROM r
""")
def record_time(spark: SparkSession, sf: str) -> DataFrame:
    """X4 + X14: order lines through the temporal projector, kept as records (as in a holdout table); the time of a record is its
    ``timestamp``, else its ``date``, else the projected epoch."""
    from verdin.functions.timefuncs import record_time_of
    from verdin.operators.ml import TemporalProjector
    at = F.col("l_shipdate").cast("timestamp_ntz")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", (at + F.expr("INTERVAL 3 DAY")).cast("string")).alias("timestamp"),
        F.when(F.col("l_linestatus") == "F", (at - F.expr("INTERVAL 90 MINUTE")).cast("string")).alias("date"), F.col("l_shipdate").alias("shipped"))
    projected = TemporalProjector(datetimeCols=["shipped"]).transform(li)
    rec = projected.withColumn("record", F.struct(*[c for c in projected.columns if not c.startswith("l_")]))
    return rec.select("l_orderkey", "l_linenumber", F.col("shipped__ts").alias("shipped_ts"), F.col("shipped__hour").alias("shipped_hour"),
                      F.col("shipped__dayofweek").alias("shipped_weekday"), F.col("shipped__month").alias("shipped_month"),
                      record_time_of(rec, "record").alias("record_time"))
