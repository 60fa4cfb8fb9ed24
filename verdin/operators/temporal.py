"""Time axis: descriptor inference, timestamp building, dedupe, cadence, temporal context
(J1–J4, W6, W9, A6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.functions.text import duration_label
from verdin.functions.timefuncs import as_timestamp, epoch_micros, from_epoch_seconds, parse_timestamp
from verdin.operators.profile import one_row_join, type_family
from verdin.operators.series import sequenced

# Hour-column name hints.
HOUR_NAME_HINTS = ("час", "hour")


@dataclass(frozen=True)
class TimestampDescriptor:
    strategy: str                      # "datetime_column" | "date_hour_columns"
    timestamp_column: str | None = None
    date_column: str | None = None
    hour_column: str | None = None
    hour_offset: int = 0


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def direct_candidates(df: DataFrame, target: str | None = None) -> DataFrame:
    """J1 scores: for each non-numeric column, parse rate over all rows and distinct parsed
    values; one aggregate job.  Typed timestamps parse at their non-null rate."""
    cols = [f for f in df.schema.fields if f.name != target and type_family(f.dataType) != "numeric"
            and type_family(f.dataType) != "boolean"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, position int, parse_rate double, "
                                                   "distinct_parsed long, eligible boolean, chosen boolean")
    aggs = []
    for i, f in enumerate(cols):
        ts = as_timestamp(_q(f.name), f.dataType)
        aggs += [F.avg(ts.isNotNull().cast("double")).alias(f"r{2 * i}"),
                 F.count_distinct(ts).alias(f"d{2 * i + 1}")]
    row = df.agg(*aggs)
    pos = {f.name: i for i, f in enumerate(df.schema.fields)}
    stacked = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(pos[f.name]).alias("position"),
                 F.col(f"r{2 * i}").alias("parse_rate"), F.col(f"d{2 * i + 1}").alias("distinct_parsed"))
        for i, f in enumerate(cols)]))
    out = row.select(stacked.alias("c")).select("c.*")
    out = out.withColumn("eligible", (F.col("parse_rate") >= 0.8) & (F.col("distinct_parsed") > 1))
    # one row per candidate column: the ranking window is bounded by the column count
    from pyspark.sql import Window
    w = Window.orderBy(F.col("eligible").desc(), F.col("parse_rate").desc(), F.col("position").asc())
    return out.withColumn("chosen", F.col("eligible") & (F.row_number().over(w) == 1))


def hour_candidates(df: DataFrame, target: str | None = None) -> list[tuple[str, int]]:
    """J2 hour columns: name contains a hint and ≥80 % of numeric values are in 0–23 (offset 0)
    or 1–24 (offset 1).  One aggregate job over the named columns."""
    named = [c for c in df.columns if c != target and any(h in c.lower() for h in HOUR_NAME_HINTS)]
    if not named:
        return []
    aggs = []
    for c in named:
        x = _q(c).try_cast("double")
        aggs += [F.count(x), F.count_if(x.between(0, 23)), F.count_if(x.between(1, 24))]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(named):
        n, a, b = row[3 * i], row[3 * i + 1], row[3 * i + 2]
        if n == 0:
            continue
        if a / n >= 0.8:
            out.append((c, 0))
        elif b / n >= 0.8:
            out.append((c, 1))
    return out


def build_timestamp(df: DataFrame, d: TimestampDescriptor) -> Column:
    """Direct parse, or day(date) + (hour − offset) hours with hours outside 0–23 → null."""
    if d.strategy == "datetime_column":
        return as_timestamp(_q(d.timestamp_column), df.schema[d.timestamp_column].dataType)
    day = as_timestamp(_q(d.date_column), df.schema[d.date_column].dataType)
    day = F.to_date(day).cast("timestamp_ntz")
    hours = _q(d.hour_column).try_cast("double") - F.lit(d.hour_offset)
    ok = hours.between(0, 23)
    return F.when(ok, F.timestamp_add("SECOND", (hours * 3600).cast("long"), day))


def infer_descriptor(df: DataFrame, target: str | None = None) -> TimestampDescriptor | None:
    """J1 then J2 (two small aggregate jobs; only the descriptor reaches the driver)."""
    best = direct_candidates(df, target).filter("chosen").select("column_name").first()
    if best is not None:
        return TimestampDescriptor("datetime_column", timestamp_column=best["column_name"])
    hours = hour_candidates(df, target)
    if not hours:
        return None
    dates = direct_candidates(df.drop(*[h for h, _ in hours]), target).filter("eligible") \
        .orderBy("position").select("column_name").collect()
    for drow in dates:
        for hcol, off in hours:
            d = TimestampDescriptor("date_hour_columns", date_column=drow["column_name"], hour_column=hcol,
                                    hour_offset=off)
            ts = build_timestamp(df, d)
            r = df.agg(F.avg(ts.isNotNull().cast("double")).alias("r"), F.count_distinct(ts).alias("n")).first()
            if r["r"] is not None and r["r"] >= 0.8 and r["n"] > 1:
                return d
    return None


def last_non_null_per_timestamp(df: DataFrame, keys: Sequence[str], ts: str, ordinal: str,
                                columns: Sequence[str]) -> DataFrame:
    """One row per (keys, ts); every column takes its last non-null value by input
    ordinal.  A grouped aggregate with map-side combine: a timestamp that holds a third
    of the rows is pre-reduced per partition before the shuffle."""
    aggs = [F.max_by(_q(c), F.when(_q(c).isNotNull(), F.col(ordinal))).alias(c) for c in columns]
    return (df.filter(F.col(ts).isNotNull()).groupBy(*keys, ts)
            .agg(F.count(F.lit(1)).alias("n_rows"), *aggs))


def temporal_order(df: DataFrame, ts: str | None, ordinal: str, position: str | None = None) -> DataFrame:
    """Drop null timestamps and order by (ts, ordinal); file order when no time axis.  With ``position`` the rows get their
    1-based place in that column (chunked ordinals, many tasks) instead of being sorted."""
    kept = df if ts is None else df.filter(F.col(ts).isNotNull())
    order = [ordinal] if ts is None else [ts, ordinal]
    if position is None:
        return kept.orderBy(*order)
    return sequenced(kept, [], order).withColumnRenamed("_pos", position).drop("_n")


def adjacent_deltas(ts_frame: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Gap in microseconds from each unique timestamp to the previous one (per series),
    via the chunked series primitive (no single-partition window)."""
    uniq = ts_frame.select(*keys, ts).filter(F.col(ts).isNotNull()).distinct()

    def compute(frame, w):
        return frame.withColumn("_prev", F.lag(ts).over(w))

    seq = sequenced(uniq, list(keys), [ts], halo=1, compute=compute)
    return seq.withColumn("delta_us", epoch_micros(F.col(ts)) - epoch_micros(F.col("_prev"))).drop("_prev")


def cadence_minutes(series: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Median positive gap in whole minutes (half-even), at least 1; 0 when no gap."""
    from verdin.operators.profile import exact_quantiles
    k = list(keys) or ["_all"]
    s = series if keys else series.withColumn("_all", F.lit(1))
    d = adjacent_deltas(s, k, ts).filter(F.col("delta_us") > 0) \
        .select(*k, (F.col("delta_us") / 1e6).alias("gap_s"))
    med = exact_quantiles(d, "gap_s", [0.5], k).select(*k, F.col("quantile").alias("median_gap_s"))
    out = s.select(*k).distinct().join(med, k, "left")
    mins = F.greatest(F.lit(1), F.bround(F.col("median_gap_s") / 60.0, 0).cast("long"))
    out = out.withColumn("cadence_minutes", F.when(F.col("median_gap_s").isNull(), F.lit(0)).otherwise(mins))
    return out if keys else out.drop("_all")


def temporal_context(spark: SparkSession, df: DataFrame, column: str) -> DataFrame:
    """Start, end, unique timestamps, modal positive gap (smallest on ties), expected
    points = round(span / cadence) + 1, gap flag, range and cadence labels."""
    ts = as_timestamp(_q(column), df.schema[column].dataType)
    parsed = df.select(ts.alias("_ts"))
    basic = parsed.agg(F.count("_ts").alias("rows_with_timestamp"),
                       F.count_distinct("_ts").alias("unique_timestamps"),
                       F.min("_ts").alias("start"), F.max("_ts").alias("end"))
    deltas = adjacent_deltas(parsed, [], "_ts").filter(F.col("delta_us") > 0)
    modal = (deltas.groupBy("delta_us").agg(F.count(F.lit(1)).alias("_c"))
             .agg(F.min_by("delta_us", F.struct(-F.col("_c"), F.col("delta_us"))).alias("freq_us")))
    out = one_row_join(basic, modal)
    span_us = epoch_micros(F.col("end")) - epoch_micros(F.col("start"))
    freq = F.col("freq_us")
    expected = F.bround(span_us / freq, 0).cast("long") + 1
    return out.select(
        F.lit(column).alias("column_name"), "rows_with_timestamp", "unique_timestamps", "start", "end",
        F.bround(freq / 6e7, 6).alias("frequency_minutes"),
        F.when(freq.isNotNull(), expected).alias("expected_points"),
        F.coalesce(freq.isNotNull() & (expected > F.col("unique_timestamps")), F.lit(False)).alias("has_gaps"),
        duration_label(span_us / 1e6).alias("range_label"),
        duration_label(freq / 1e6).alias("frequency_label"))


def epoch_to_ts(seconds: Column) -> Column:
    return from_epoch_seconds(seconds)


__all__ = ["TimestampDescriptor", "direct_candidates", "hour_candidates", "build_timestamp", "infer_descriptor",
           "last_non_null_per_timestamp", "temporal_order", "adjacent_deltas", "cadence_minutes",
           "temporal_context", "parse_timestamp", "epoch_to_ts"]
