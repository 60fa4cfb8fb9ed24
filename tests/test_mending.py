"""Inputs that used to raise or give wrong figures: mixed types, sides without values, NaN, unknown versions."""

import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from verdin.operators import drift, lifecycle, merge, metrics, profile
from verdin.session import scratch_table_path
from verdin.sources import tabular


def test_types_of_one_column_join(spark):
    a = spark.createDataFrame([(1, 1, "2024-01-01", 1.5)], "n int, m int, t string, x double").withColumn("t", F.col("t").cast("date"))
    b = spark.createDataFrame([("2", "n/a", "2024-01-02 03:00:00", "1,5"), (" +3 ", None, "", "7")], "n string, m string, t string, x string")
    c = spark.createDataFrame([(2.5, True)], "n double, m boolean")
    x, y, z = merge.unify_types([a, b, c])
    assert dict(x.dtypes) == {"n": "double", "m": "string", "t": "timestamp_ntz", "x": "string"} and dict(z.dtypes)["n"] == "double"
    assert [(r.n, r.x) for r in y.orderBy("n").collect()] == [(2.0, "1,5"), (3.0, "7")] and y.where("t is null").count() == 1
    assert [f.dtypes for f in merge.unify_types([b, b])] == [b.dtypes, b.dtypes]
    two = merge.unify_types([a, b])
    assert dict(two[0].dtypes)["m"] == "double" and [r.m for r in two[1].collect()] == [None, None]


def _csv(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_collections_with_missing_marks_and_decimal_commas(spark, tmp_path):
    hours = [f"2024-01-01 {h:02d}:00:00" for h in range(6)]
    _csv(tmp_path / "a", "a.csv", "at;load\n" + "".join(f"{t};{100 + i}\n" for i, t in enumerate(hours)))
    _csv(tmp_path / "a", "b.csv", "at;load;cloud\n" + "".join(f"{t};{'n/a' if i else 200 + i};{i}\n" for i, t in enumerate(hours)))
    raw = tabular.read_csv_collection(spark, str(tmp_path / "a"))
    assert dict(raw.dtypes)["load"] == "double" and raw.where("load is null").count() == 5
    merged = tabular.ingest(spark, str(tmp_path / "a"), target="load").orderBy("timestamp").collect()
    assert [r["load"] for r in merged] == [100.0 + i for i in range(6)] and [r["cloud"] for r in merged] == list(range(6))
    _csv(tmp_path / "b", "a.csv", "at;load\n" + "".join(f"{t};{100 + i}\n" for i, t in enumerate(hours)))
    _csv(tmp_path / "b", "b.csv", "at;load\n" + "".join(f"{t};1,{i}\n" for i, t in enumerate(hours)))
    merged = tabular.ingest(spark, str(tmp_path / "b"), target="load").orderBy("timestamp").collect()
    assert [r["load"] for r in merged] == [str(100 + i) for i in range(6)] and "load__b" in merged[0].asDict()


def test_csv_probe_without_the_package_on_the_workers(tmp_path):
    """Run from another folder: the workers get the package from the session."""
    _csv(tmp_path / "in", "a.csv", "x;y\n1;2\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from verdin.session import build_session
from verdin.sources import tabular
spark = build_session(master='local[2]', partitions=2)
print('ROWS', tabular.read_csv_collection(spark, {str(tmp_path / 'in')!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 1" in got.stdout, got.stderr[-2000:]


def test_drift_with_a_side_without_values(spark):
    schema = "a double, b string, c double, d string, e double"
    ref = spark.createDataFrame([(1.0, "x", None, None, 1.0), (2.0, "y", None, None, 2.0)] * 30, schema)
    cur = spark.createDataFrame([(9.0, "z", 1.0, "q", None), (8.0, "z", 2.0, "q", None)] * 30, schema)
    got = {r.column_name: r for r in drift.drift_columns(ref, cur).collect()}
    assert list(got) == list("abcde")
    assert got["a"].drifted and got["a"].statistic == 1.0 and got["b"].drifted and got["a"].testable
    assert [(got[c].testable, got[c].drifted, got[c].statistic) for c in "cde"] == [(False, False, None)] * 3
    assert got["c"].reason == got["d"].reason == "no values in the reference" and got["e"].reason == "no values in the current data"
    assert drift.drift_report(ref, cur, ["a", "c", "e"], ["b", "d"]).first().asDict() == {"columns_tested": 2, "drifted_columns": 2, "drift_share": 1.0}
    for x, y in ((ref.limit(0), cur), (ref, cur.limit(0)), (ref.limit(0), cur.limit(0))):
        assert not any(r.testable or r.drifted for r in drift.drift_columns(x, y).collect())
        assert drift.drift_report(x, y, ["a"], ["b"]).first().asDict() == {"columns_tested": 0, "drifted_columns": 0, "drift_share": None}
    assert drift.ks_statistics(ref, cur.limit(0), ["a"]).first().drifted is False
    mixed = drift.drift_columns(ref.select("a"), cur.select(F.col("a").cast("string").alias("a"))).first()
    assert mixed.test == "ks" and mixed.drifted


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),), (float("inf"),), (None,)], "y double")
    row = profile.target_summary_numeric(df, "y").first()
    assert (row["non_null_values"], row["min"], row["max"], row["mean"], row["median"]) == (10, 0.0, 9.0, 4.5, 4.5)
    bins = profile.target_distribution(df, "y", "regression", bins=3).collect()
    assert sum(r["count"] for r in bins) == 10 and {r["bin"] for r in bins} == {0, 1, 2} and max(r["upper"] for r in bins) == 9.0
    pairs = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (1.0, None), (3.0, 3.0)], "y double, p double")
    assert metrics.regression_metrics(pairs, "y", "p").first()["n"] == 2


def test_unknown_and_repeated_versions_are_errors(spark):
    reg = lifecycle.Registry(spark, scratch_table_path(spark, f"reg-{uuid.uuid4().hex[:8]}"))
    reg.register_model("p", "m1", "d1", "regression", "rmse", 5.0)
    with pytest.raises(ValueError, match="m9"):
        reg.activate("p", "m9")
    with pytest.raises(ValueError, match="already"):
        reg.register_model("p", "m1", "d1", "regression", "rmse", 4.0)
    assert [(r["version_id"], r["status"]) for r in reg.models("p").collect()] == [("m1", "champion")]
