import math
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdin.operators import flows, lifecycle
from verdin.session import scratch_table_path
from verdin.sources import tabular


@pytest.fixture
def reg(spark):
    return lifecycle.Registry(spark, scratch_table_path(spark, f"flow-{uuid.uuid4().hex[:8]}"))


def _meter(spark, n=96, shift=0.0):
    t = datetime(2024, 1, 1)
    rows = [(i, (t + timedelta(hours=i)).isoformat(sep=" "), float(i % 24), 100 + shift + 10 * math.sin(i % 24), None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, at string, hour double, load double, empty string")


def test_source_to_stored_version_forecast_and_monitoring(spark, reg):
    first = flows.train_and_register(reg, _meter(spark), "p", "load", "id", {"backend": "forest"}, dataset_id="d1", model_id="m1", unit="kWh", num_trees=3)
    assert first["status"] == "champion" and first["metrics"]["rmse"] >= 0
    top = flows.champion(reg, "p")
    assert (top["model_id"], top["dataset_id"], top["target"], top["unit"], top["dataset_rows"]) == ("m1", "d1", "load", "kWh", 96)
    assert "empty" not in tabular.load_dataset(spark, reg.root, "p", "d1").columns
    assert flows.record_of(reg, "p", "m1")["options"]["effective"]["backend"] == "forest"
    assert spark.read.parquet(f"{first['bundle_path']}/holdout").count() == 20
    assert flows.predict(reg, "p", _meter(spark, 5).drop("load", "empty")).select("prediction_value").count() == 5
    run = flows.forecast_project(reg, "p", steps=3, horizon_minutes=60, num_trees=5)
    points = reg.forecast_run(run).orderBy("step").collect()
    assert [p["step"] for p in points] == [1, 2, 3] and points[0]["unit"] == "kWh" and points[0]["ts"] == datetime(2024, 1, 5)
    same = flows.monitor(reg, "p").collect()
    assert all(r.same_dataset and not r.drifted for r in same) and {r.column_name for r in same} == {"id", "at", "hour", "load"}
    flows.store_dataset(reg, _meter(spark, shift=500.0), "p", "load", "d9")
    now = {r.column_name: r for r in flows.monitor(reg, "p").collect()}
    assert now["load"].drifted and not now["hour"].drifted and not now["load"].same_dataset and now["load"].current_id == "d9"
    with pytest.raises(ValueError, match="already"):
        flows.store_dataset(reg, _meter(spark), "p", "load", "d9")
    with pytest.raises(ValueError, match="no column"):
        flows.store_dataset(reg, _meter(spark), "p", "nothing")


def test_only_a_regression_on_a_time_axis_is_forecast(spark, reg):
    tabular.save_dataset(spark.createDataFrame([(1, 2.0)], "id long, y double"), reg.root, "q", "d")
    tabular.register_dataset_version(spark, reg.root, tabular.load_dataset(spark, reg.root, "q", "d"), "q", "d", "y")
    with pytest.raises(ValueError, match="no champion"):
        flows.forecast_project(reg, "q")
    reg.register_model("q", "m", "d", "binary", "f1_weighted", 0.5)
    with pytest.raises(ValueError, match="regression"):
        flows.forecast_project(reg, "q")
    reg.register_model("q", "n", "d", "binary", "f1_weighted", 0.4)
    assert reg.register_model("q", "o", "d", "regression", "f1_weighted", 0.9) == "champion"
    assert {r.version_id: r.status for r in reg.models("q").collect()} == {"m": "archived", "n": "candidate", "o": "champion"}
    with pytest.raises(ValueError, match="time axis"):
        flows.forecast_project(reg, "q")


def test_deleting_a_project_leaves_nothing_of_it_and_all_of_the_others(spark, reg):
    data = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, y double")
    for p in ("gone", "gone2", "stays"):
        tabular.save_dataset(data, reg.root, p, "d")
        tabular.register_dataset_version(spark, reg.root, data, p, "d", "y")
        reg.register_model(p, "m", "d", "regression", "rmse", 1.0, bundle_path=flows.bundle_path(reg, p, "m"))
        data.write.parquet(f"{flows.bundle_path(reg, p, 'm')}/holdout")
        reg.append_forecast_run("r-" + p, p, spark.createDataFrame([(1, datetime(2024, 1, 1), 1.0)], "step int, ts timestamp_ntz, prediction double"))
        reg.save_comparison(p, spark.createDataFrame([(3, 1)], "points long, matched long"))
    gone = flows.delete_project(reg, "gone")
    assert len(gone) == 6 and flows.delete_project(reg, "gone") == [] and flows.delete_project(reg, "never") == []
    left = {r.project_id for r in reg.models().collect()} | {r.project_id for r in reg.datasets().collect()}
    assert left == {"gone2", "stays"} and reg.forecast_run("r-gone").count() == 0 and reg.latest_comparison("gone").count() == 0
    assert tabular.load_dataset(spark, reg.root, "gone2", "d").count() == 2 and reg.forecast_run("r-stays").count() == 1
    assert reg.latest_comparison("stays").select(F.col("points")).first()[0] == 3


def _regime(spark, lo, hi):
    """Daily rows with a level shift from day 150 on (the shared retraining fixture with ids)."""
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(lo, hi):
        t = start + timedelta(days=i)
        rows.append((i, t.isoformat(), float(i), 10 + (i % 7) * 1.5, float(120 + 2.4 * i + 60 * (i >= 150) + (5 if t.weekday() < 5 else -7))))
    return spark.createDataFrame(rows, "id long, at string, period double, warmth double, target double")


def test_retraining_from_two_sources_and_from_a_stored_version(spark, reg):
    flows.train_and_register(reg, _regime(spark, 0, 150), "r", "target", "id", {"backend": "forest"}, dataset_id="d1", model_id="m1", num_trees=10)
    batch = _regime(spark, 150, 180)
    sources = {"plan.csv": batch.select("at", "period", "target"), "weather.csv": batch.select("at", "warmth", (F.col("warmth") * 2).alias("more"))}
    report = flows.inspect_batch(reg, "r", {"plan.csv": sources["plan.csv"]})
    assert report["missing_inputs"] == report["missing_features"] == ["warmth"] and not report["ready"] and report["problem"] is None
    report = flows.inspect_batch(reg, "r", {"weather.csv": batch.drop("at")})
    assert report["missing_inputs"] == ["at"] and {"at__hour", "at__month"} <= set(report["missing_features"])
    with pytest.raises(ValueError, match="warmth"):
        flows.retrain_project(reg, "r", {"plan.csv": sources["plan.csv"]})
    got = flows.retrain_project(reg, "r", sources, options={"history_scope": "last_30_days", "minimum_relative_improvement": 0.01, "auto_activate": False}, num_trees=10)
    assert got["inspection"]["ready"] and got["inspection"]["extra_columns"] == ["more"]
    assert got["inspection"]["provided"] == {"plan.csv": ["at", "period"], "weather.csv": ["at", "warmth"]} or set(got["inspection"]["provided"]["plan.csv"]) == {"at", "period"}
    s = got["summary"]
    assert (s["historical_rows_selected"], s["new_rows_used_for_training"], s["new_rows_reserved_for_evaluation"], s["candidate_training_rows"]) == (31, 24, 6, 55)
    assert not got["activated"] and flows.champion(reg, "r")["model_id"] == "m1" and reg.datasets("r").count() == 2
    flows.store_dataset(reg, batch, "r", "target", "d2")
    again = flows.retrain_project(reg, "r", dataset_id="d2", options={"minimum_relative_improvement": 0.01}, model_id="m2", num_trees=10)
    s = again["summary"]
    assert (s["historical_rows_selected"], s["new_rows_reserved_for_evaluation"], s["candidate_training_rows"]) == (150, 6, 174) and s["is_better"]
    assert again["activated"] and flows.champion(reg, "r")["model_id"] == "m2" and flows.record_of(reg, "r", "m2")["retraining"]["activated"]
    with pytest.raises(ValueError, match="either"):
        flows.retrain_project(reg, "r")
