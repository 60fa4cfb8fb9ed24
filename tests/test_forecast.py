import math

from pyspark.sql import functions as F

from verdin.functions.timefuncs import parse_timestamp
from verdin.operators import forecast


def test_recursive_forecast_hourly_series(spark, hourly_consumption):
    s = hourly_consumption.select(F.lit("energy").alias("series_id"), parse_timestamp("Дата").alias("ts"),
                                  F.col("Электропотребление").alias("y"))
    b = forecast.train_forecaster(s, ["series_id"], num_trees=20)
    assert b.training_rows == 120 - 48 and "rmse" in b.metrics
    state = b.state.first()
    assert state["cadence_minutes"] == 60 and len(state["history"]) == 120
    pts = forecast.recursive_forecast(b, steps=3, horizon_minutes=30).orderBy("step").collect()
    assert [p["step"] for p in pts] == [1, 2, 3]
    assert pts[0]["ts"] < pts[1]["ts"] < pts[2]["ts"]
    assert (pts[1]["ts"] - pts[0]["ts"]).total_seconds() == 1800
    assert pts[0]["warning"] is not None and "30" in pts[0]["warning"]
    assert forecast.recent_history(s, ["series_id"]).count() == 120
    default = forecast.recursive_forecast(b, steps=2).collect()
    assert all(r["horizon_minutes"] == 30 for r in default)   # min(30, cadence 60)


def test_every_eligible_series_is_forecast(spark):
    """Short series use the lags they allow; the forecast set is the gate's eligible set."""
    sizes = {"a": 200, "b": 40, "c": 22, "d": 13, "e": 8, None: 34}
    rows = [(k, i, float((7 * i + 3 * n) % 11)) for k, n in sizes.items() for i in range(n)]
    s = spark.createDataFrame(rows, "series_id string, i int, v double").select(
        "series_id", F.timestamp_add("HOUR", F.col("i"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), F.col("v").alias("y"))
    eligible = {r["series_id"] for r in forecast.series_gate(s, ["series_id"]).filter("eligible").collect()}
    assert {"a", "b", "c", None} <= eligible and "e" not in eligible
    b = forecast.train_forecaster(s, ["series_id"], num_trees=3)
    assert [r.required for r in b.regimes] == sorted({r.required for r in b.regimes}, reverse=True) and len(b.regimes) > 1
    assert b.training_rows == sum(sizes[k] - max(x for x in (1, 2, 3, 6, 12, 24, 48) if x < sizes[k]) for k in eligible)
    points = forecast.recursive_forecast(b, steps=2).collect()
    assert sorted((p["series_id"] or "", p["step"]) for p in points) == sorted((k or "", n) for k in eligible for n in (1, 2))
    assert all(p["prediction"] is not None for p in points)


def test_series_of_any_scale_with_nulls_and_repeats(spark):
    """A daily wave on levels 1 and 1000 (amplitude a fifth): each forecast stays within 5 % of its level."""
    rows = [(k, i, level * (1 + 0.2 * math.sin(2 * math.pi * i / 24))) for k, level in (("small", 1.0), ("large", 1000.0), ("flat", None)) if level for i in range(240)]
    rows += [("flat", i, 7.0) for i in range(60)] + [("small", 5, None), ("small", 500, float("nan")), ("large", 6, None), ("large", 6, -5.0), (None, 3, None)]
    s = spark.createDataFrame(rows, "series_id string, i int, y double").select(
        "series_id", F.timestamp_add("HOUR", F.col("i"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), "y")
    s = s.unionByName(s.limit(1).select("series_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(3.0).alias("y")))
    b = forecast.train_forecaster(s, ["series_id"], num_trees=30, max_depth=8)
    points = forecast.recursive_forecast(b, steps=24, horizon_minutes=60).collect()
    got = {k: {p["step"]: p["prediction"] for p in points if p["series_id"] == k} for k in ("small", "large", "flat")}
    for k, level in (("small", 1.0), ("large", 1000.0)):
        assert len(got[k]) == 24 and all(abs(v - level * (1 + 0.2 * math.sin(2 * math.pi * (239 + step) / 24))) < 0.05 * level for step, v in got[k].items())
    assert all(abs(v - 7.0) < 1e-6 for v in got["flat"].values())
    assert b.training_rows == 2 * (240 - 48) + 60 - 48 and {r["series_id"] for r in b.historical_fit.collect()} == {"small", "large", "flat"}
