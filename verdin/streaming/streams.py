"""Structured Streaming versions of the operators.

The reference has no stream operators; these re-aim batch operators at a stream
the way a Spark user would run them:

* R1 ``stream_decisions`` — stateless scoring → proxy impact → facts → rules.
* R2 ``stream_hourly`` — watermarked tumbling-window aggregation (event time).
* R3 ``stream_postfactum`` — arriving actuals matched to stored forecast points by a
  stream–static bucketed equi-join; the nearest candidate is picked after drain.
* R4 ``stream_drift`` — per-window category counts against a static reference.

Sinks are ``foreachBatch`` writes into ``batch_id=N`` partitions with overwrite of
that partition, so a retried micro-batch replaces its own output (idempotent).
Stream checkpoints live under the shared checkpoint folder.  ``availableNow``
drains everything present and stops, which makes the runs testable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdin.session import scratch_table_path


def _order_key(df: DataFrame, order: str):
    from verdin.functions.timefuncs import epoch_micros
    if df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return epoch_micros(F.col(order)).cast("double")
    return F.col(order).cast("double")


def slice_conditions(df: DataFrame, order: str, slices: int = 4) -> list:
    """Conditions that cut ``df`` into ``slices`` parts along ``order``, between the quantiles of one approximate job; only
    ``slices − 1`` numbers reach the driver.  Rows without an order key come with the first part."""
    key = _order_key(df, order)
    cuts = []
    if slices > 1:
        cuts = df.agg(F.percentile_approx(key, [i / slices for i in range(1, slices)], 10000).alias("q")).first()["q"] or []
    bounds = [None, *cuts, None]
    out = []
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (key > F.lit(lo))
        if hi is not None:
            cond = cond & (key <= F.lit(hi))
        out.append((cond | key.isNull()) if i == 0 else (cond & key.isNotNull()))
    return out


def stage_ordered_files(df: DataFrame, path: str, order: str, slices: int = 4) -> str:
    """Write ``df`` as one folder a slice in ``order``, each by all tasks."""
    for i, cond in enumerate(slice_conditions(df, order, slices)):
        df.filter(cond).write.mode("overwrite").parquet(f"{path}/slice={i:04d}")
    return path


def replay(df: DataFrame, path: str, order: str, slices: int, run: Callable[[], None]) -> None:
    """Stage one slice after the other, each written by all tasks, and ``run()`` (a drain that goes on from its
    checkpoint) after each: a slice is one micro-batch, whatever its files, so no staged row is late."""
    for i, cond in enumerate(slice_conditions(df, order, slices)):
        df.filter(cond).write.mode("overwrite").parquet(f"{path}/slice={i:04d}")
        run()


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """All files that have come since the last batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append",
          transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run ``stream`` with ``availableNow`` into an idempotent per-batch Parquet sink."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id:06d}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def latest_per_key(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode aggregate: the row from the newest batch per key."""
    out = spark.read.option("recursiveFileLookup", "true").parquet(sink)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return out.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk", "batch_id")


def workspace(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------------------
# R2: hourly feed with a watermark


def hourly_feed(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Event-time tumbling windows per event type; rows later than the watermark are
    dropped by Spark (bounded late data)."""
    ts = F.col("ts").cast("timestamp")
    return (events.withColumn("_ets", ts).withWatermark("_ets", watermark)
            .groupBy(F.window("_ets", "1 hour").alias("w"), "event_type")
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")))


def run_hourly(spark: SparkSession, events_static: DataFrame, slices: int = 4) -> DataFrame:
    ws = workspace(spark, "hourly")
    replay(events_static, f"{ws}/input", "ts", slices, lambda: drain(
        hourly_feed(file_stream(spark, f"{ws}/input", events_static.schema)), f"{ws}/sink", f"{ws}/checkpoint", mode="update",
        transform=lambda b: b.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "value", "n")))
    out = latest_per_key(spark, f"{ws}/sink", ["window_start", "event_type"])
    return out.select("window_start", "event_type", F.bround("value", 6).alias("value"), "n")


HOUR = 3_600_000_000    # microseconds


def regular(closed: DataFrame) -> DataFrame:
    """Of closed windows (window_start timestamp with a watermark, event_type, value, n), every hour of each type: keyed state holds
    the hour after the last one emitted; hours without events before a closed window are emitted as empty ones, and an
    event-time timer emits them while nothing comes.  Rows per key and batch are closed hours, not events."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        found = {}
        if not state.hasTimedOut:
            for pdf in frames:
                for start, value, n in zip(pdf["start_us"], pdf["value"], pdf["n"], strict=True):
                    found[int(start)] = (float(value), int(n))
        upto = max([*found, (state.getCurrentWatermarkMs() * 1000 // HOUR - 1) * HOUR if state.exists else -1])
        at = state.get[0] if state.exists else min(found, default=None)
        if at is None:
            return
        hours = list(range(at, upto + 1, HOUR))
        if hours:
            state.update((hours[-1] + HOUR,))
            yield pd.DataFrame({"event_type": [key[0]] * len(hours), "start_us": hours, "value": [found.get(h, (0.0, 0))[0] for h in hours],
                                "n": [found.get(h, (0.0, 0))[1] for h in hours]})
        elif not state.exists:
            state.update((at,))
        # the next hour is due when the watermark has passed its end
        state.setTimeoutTimestamp(max(state.get[0] // 1000 + 2 * HOUR // 1000, state.getCurrentWatermarkMs() + 1))

    micros = F.unix_micros("window_start").alias("start_us")
    return closed.select("event_type", micros, "value", "n", "window_start").groupBy("event_type").applyInPandasWithState(
        step, "event_type string, start_us long, value double, n long", "next long", "append", GroupStateTimeout.EventTimeTimeout)


def run_regular_feed(spark: SparkSession, events_static: DataFrame, slices: int = 4, watermark: str = "2 hours") -> DataFrame:
    """R2 as a regular feed: each type has a row for every hour from its first one to the last hour of the stream, hours without
    events with n = 0.  One stream closes hourly windows (watermark, append); a second one reads the closed windows and fills
    the gaps by keyed state and timers.  After the last slice a mark beyond the end moves both watermarks on."""
    ws = workspace(spark, "regular")
    types = events_static.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    closed_schema = "window_start timestamp, event_type string, value double, n long"
    last = types.agg(F.max("ts").alias("m")).first()["m"]

    def close():
        drain(hourly_feed(file_stream(spark, f"{ws}/input", types.schema), watermark), f"{ws}/closed", f"{ws}/closing", mode="append",
              transform=lambda b: b.select(F.col("w.start").alias("window_start"), "event_type", "value", "n"))

    def fill():
        closed = file_stream(spark, f"{ws}/closed", closed_schema).withWatermark("window_start", "0 seconds")
        drain(regular(closed), f"{ws}/sink", f"{ws}/filling", mode="append")

    def both():
        close()
        fill()

    if last is None:
        return spark.createDataFrame([], "window_start timestamp_ntz, event_type string, value double, n long")
    replay(types, f"{ws}/input", "ts", slices, both)
    import datetime as dt
    mark = "\x00end"
    for days in (2, 4, 6):
        spark.createDataFrame([(last + dt.timedelta(days=days), mark, 0.0)], types.schema).write.mode("overwrite").parquet(f"{ws}/input/slice=end{days}")
        both()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{ws}/sink").where((F.col("event_type") != mark) | F.col("event_type").isNull())
    end = types.agg(F.floor(F.unix_micros(F.max("ts")) / HOUR) * HOUR).first()[0]
    return out.where(F.col("start_us") <= end).select(F.timestamp_micros("start_us").cast("timestamp_ntz").alias("window_start"), "event_type",
                                                      F.bround("value", 6).alias("value"), "n")


# ---------------------------------------------------------------------------
# Stateless scoring and decisions


def run_decisions(spark: SparkSession, docs_static: DataFrame, score: Callable[[DataFrame], DataFrame],
                  slices: int = 4) -> DataFrame:
    """``score`` maps a frame of documents to decision rows; it is applied to each
    micro-batch (stateless), so the streaming plan is the batch plan per batch."""
    ws = workspace(spark, "decisions")
    replay(docs_static, f"{ws}/input", "doc_id", slices, lambda: drain(
        file_stream(spark, f"{ws}/input", docs_static.schema), f"{ws}/sink", f"{ws}/checkpoint", mode="append", transform=score))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{ws}/sink").drop("batch_id")


# ---------------------------------------------------------------------------
# Streaming post-factum matching


def run_postfactum(spark: SparkSession, events_static: DataFrame, points: DataFrame, tolerance_seconds: int,
                   slices: int = 4) -> DataFrame:
    """Each micro-batch of actuals is joined to the static forecast points on
    (series, tolerance bucket) — points are offered to their own and both neighbouring
    buckets — and every candidate within the tolerance is appended.  After the drain
    the nearest candidate per point wins (gap, then event order)."""
    from verdin.functions.timefuncs import epoch_micros
    ws = workspace(spark, "postfactum")
    tol = int(tolerance_seconds * 1_000_000)
    pts = points.withColumn("_pus", epoch_micros("ts"))
    offered = pts.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_pus") / tol) + d for d in (-1, 0, 1)])))
    actual = lambda: (file_stream(spark, f"{ws}/input", events_static.schema).select(F.col("event_type").alias("series_id"), F.col("ts").alias("matched_ts"),
                            F.col("value").alias("actual"), "event_id")
              .withColumn("_aus", epoch_micros("matched_ts")).withColumn("_bucket", F.floor(F.col("_aus") / tol)))
    cand = lambda: (actual().join(offered.select("series_id", "step", "_bucket", "_pus"), ["series_id", "_bucket"])
            .withColumn("_gap", F.abs(F.col("_aus") - F.col("_pus"))).filter(F.col("_gap") <= tol)
            .select("series_id", "step", "_gap", "event_id", "matched_ts", "actual"))
    replay(events_static, f"{ws}/input", "ts", slices, lambda: drain(cand(), f"{ws}/sink", f"{ws}/checkpoint", mode="append"))
    allc = spark.read.option("recursiveFileLookup", "true").parquet(f"{ws}/sink")
    best = (allc.groupBy("series_id", "step")
            .agg(F.min_by(F.struct("matched_ts", "actual"), F.struct("_gap", "event_id")).alias("_b"))
            .select("series_id", "step", "_b.matched_ts", "_b.actual"))
    return points.join(best, ["series_id", "step"], "left")


# ---------------------------------------------------------------------------
# Drift counters per window


def run_drift(spark: SparkSession, events_static: DataFrame, window: str = "1 day", slices: int = 4) -> DataFrame:
    """Per event-time window: category counts from the stream vs the static reference
    shares (whole table), Jensen–Shannon divergence (base 2) per window."""
    ws = workspace(spark, "drift")
    counts = lambda: (file_stream(spark, f"{ws}/input", events_static.schema).withColumn("_ets", F.col("ts").cast("timestamp")).withWatermark("_ets", "2 hours")
              .groupBy(F.window("_ets", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")))
    replay(events_static, f"{ws}/input", "ts", slices, lambda: drain(
        counts(), f"{ws}/sink", f"{ws}/checkpoint", mode="update",
        transform=lambda b: b.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")))
    cur = latest_per_key(spark, f"{ws}/sink", ["window_start", "event_type"])
    from verdin.operators.profile import one_row_join
    ref = one_row_join(events_static.groupBy("event_type").agg(F.count(F.lit(1)).alias("r")),
                       events_static.agg(F.count(F.lit(1)).alias("_rt")))
    ref = ref.select("event_type", (F.col("r") / F.col("_rt")).alias("p"))
    # only categories seen in a window are joined; a reference category absent from the
    # window (q = 0, m = p/2) contributes exactly p/2, added in closed form below
    g = cur.join(F.broadcast(ref), "event_type", "left").na.fill(0.0, ["p"])   # ref: one row per category
    g = g.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("window_start")))
    g = g.withColumn("m", (F.col("p") + F.col("q")) / 2)

    def kl(a):
        return F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / F.col("m"))).otherwise(F.lit(0.0))

    out = g.groupBy("window_start").agg(
        (0.5 * F.sum(kl("p")) + 0.5 * F.sum(kl("q")) + 0.5 * (1 - F.sum("p"))).alias("js"),
        F.sum("n").alias("events"))
    return out.select("window_start", "events", F.bround("js", 6).alias("js_divergence"),
                      (F.col("js") > 0.1).alias("drifted"))
