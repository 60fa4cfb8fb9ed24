import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verdin.operators import lifecycle
from verdin.session import scratch_table_path
from verdin.sources import tabular


def test_registry_promotion_activation_and_runs(spark):
    reg = lifecycle.Registry(spark, scratch_table_path(spark, f"reg-{uuid.uuid4().hex[:8]}"))
    data = spark.createDataFrame([(1, 2.0), (2, 3.0)], "feature long, target double")
    tabular.register_dataset_version(spark, reg.root, data, "p", "d1", "target")
    assert reg.register_model("p", "m1", "d1", "regression", "rmse", 5.0, created_at=datetime(2024, 1, 1)) == "champion"
    assert reg.register_model("p", "m2", "d1", "regression", "rmse", 6.0, created_at=datetime(2024, 1, 2)) == "candidate"
    assert reg.register_model("p", "m3", "d1", "regression", "rmse", 4.0, created_at=datetime(2024, 1, 3)) == "champion"
    assert reg.register_model("p", "m4", "d1", "regression", "rmse", 1.0, created_at=datetime(2024, 1, 4),
                              mode="candidate") == "candidate"
    status = {r["version_id"]: r["status"] for r in reg.models("p").collect()}
    assert status == {"m1": "archived", "m2": "candidate", "m3": "champion", "m4": "candidate"}
    reg.activate("p", "m2")
    assert reg.champion("p").first()["version_id"] == "m2"
    assert reg.latest_model("p").first()["version_id"] == "m4"
    pts = spark.createDataFrame([(1, datetime(2024, 2, 1), 1.5), (2, datetime(2024, 2, 1, 1), 2.5)],
                                "step int, ts timestamp_ntz, prediction double")
    reg.append_forecast_run("r1", "p", pts, unit="kWh")
    run = reg.forecast_run("r1").orderBy("step").collect()
    assert [r["prediction"] for r in run] == [1.5, 2.5] and run[0]["unit"] == "kWh"
    reg.save_comparison("p", spark.createDataFrame([(2, 2)], "points long, matched long"))
    reg.save_comparison("p", spark.createDataFrame([(3, 1)], "points long, matched long"))
    assert reg.latest_comparison("p").select("points").collect()[0][0] == 3
    assert reg.dataset_summary("p").first()["rows"] == 2
    assert reg.models().filter(F.col("project_id") == "other").count() == 0


def test_names_units_and_summaries(spark):
    reg = lifecycle.Registry(spark, scratch_table_path(spark, f"reg-{uuid.uuid4().hex[:8]}"))
    data = spark.createDataFrame([(1, 2.0)], "feature long, target double")
    for p in ("p", "q"):
        tabular.register_dataset_version(spark, reg.root, data, p, "d1", "target", unit="kg")
        reg.register_model(p, "m1", "d1", "regression", "rmse", 5.0, {"features": ["feature"], "target": "target", "metrics": {"rmse": 5.0}}, name="first")
        reg.register_model(p, "m2", "d1", "regression", "rmse", 6.0)

    def changes(*rows):
        return spark.createDataFrame(list(rows), "project_id string, version_id string, value string")

    reg.rename_models(changes(("p", "m2", "  the   second ")))
    reg.set_units(changes(("p", "d1", " "), ("q", "d1", None)))
    with pytest.raises(ValueError, match="'m9'"):
        reg.rename_models(changes(("p", "m1", "lost"), ("p", "m9", "x")))
    with pytest.raises(ValueError, match="'d7'"):
        reg.rename_datasets(changes(("q", "d7", "x")))
    reg.rename_models(changes())
    got = {(r.project_id, r.version_id): r for r in lifecycle.model_summary(reg.models()).collect()}
    assert {k: r.name for k, r in got.items()} == {("p", "m1"): "first", ("p", "m2"): "the second", ("q", "m1"): "first", ("q", "m2"): None}
    first, bare = got["p", "m1"], got["p", "m2"]
    assert (first.target, first.feature_names, first.metrics, first.primary_metric) == ("target", ["feature"], {"rmse": 5.0}, "rmse")
    assert (bare.target, bare.feature_names, bare.metrics, bare.forecasting.available, bare.forecasting.recent_history_rows) == (None, [], None, False, 0)
    assert [r.unit for r in reg.datasets().collect()] == [None, None]
    assert {r.status for r in reg.models("q").collect()} == {"champion", "candidate"}


def test_forecast_runs_take_the_unit_of_their_dataset(spark):
    reg = lifecycle.Registry(spark, scratch_table_path(spark, f"reg-{uuid.uuid4().hex[:8]}"))
    data = spark.createDataFrame([(1, 2.0)], "feature long, target double")
    for p in ("p", "q"):
        tabular.register_dataset_version(spark, reg.root, data, p, "d1", "target", unit=p + "-old")
        tabular.register_dataset_version(spark, reg.root, data, p, "d2", "target", unit=p + "-new")
    at = datetime(2024, 1, 1)
    pts = spark.createDataFrame([("r1", "p", 1, at, 1.0), ("r2", "q", 1, at, 2.0), ("r3", "none", 1, at, 3.0)],
                                "run_id string, project_id string, step int, ts timestamp_ntz, prediction double")
    reg.append_forecast_runs(pts)
    reg.append_forecast_runs(pts.withColumn("run_id", F.concat("run_id", F.lit("b"))).where("project_id = 'p'"),
                             spark.createDataFrame([("p", "d1")], "project_id string, version_id string"))
    assert {r.run_id: r.unit for r in reg.forecast_runs().collect()} == {"r1": "p-new", "r2": "q-new", "r3": None, "r1b": "p-old"}
    reg.save_comparisons(spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, points long"))
    reg.save_comparisons(spark.createDataFrame([("q", 5)], "project_id string, points long"))
    assert {r.project_id: r.points for r in reg.comparisons().collect()} == {"p": 1, "q": 5}
