from datetime import datetime

from pyspark.sql import functions as F

from verdin.operators import merge, temporal
from verdin.plans.timeseries import prepare_for_merge


def test_cadence_and_context_of_timestamped_energy(spark, timestamped_energy):
    d = temporal.infer_descriptor(timestamped_energy, target="Потребление")
    assert d.strategy == "datetime_column" and d.timestamp_column == "Дата"
    ts = timestamped_energy.select(temporal.build_timestamp(timestamped_energy, d).alias("ts"))
    cad = temporal.cadence_minutes(ts, [], "ts").first()
    assert cad["cadence_minutes"] == 240
    ctx = temporal.temporal_context(spark, timestamped_energy, "Дата").first()
    assert ctx["frequency_minutes"] == 240.0 and ctx["unique_timestamps"] == 10 and not ctx["has_gaps"]
    assert ctx["frequency_label"] == "4 ч"


def test_hour_only_frame_has_no_time_axis(spark, hour_only_energy):
    assert temporal.infer_descriptor(hour_only_energy, target="Потребление") is None


def test_date_hour_descriptor_with_offset(spark):
    rows = [("2024-01-01", h + 1, float(h)) for h in range(24)] + [("2024-01-02", h + 1, float(h)) for h in range(24)]
    df = spark.createDataFrame(rows, "day string, `Час` long, v double")
    hours = temporal.hour_candidates(df)
    assert hours == [("Час", 0)]            # 1..24 is mostly inside 0..23 → offset 0 wins, 24 → null
    d = temporal.TimestampDescriptor("date_hour_columns", date_column="day", hour_column="Час", hour_offset=1)
    out = df.select(temporal.build_timestamp(df, d).alias("t")).collect()
    assert out[0]["t"] == datetime(2024, 1, 1, 0) and out[23]["t"] == datetime(2024, 1, 1, 23)


def test_last_non_null_per_timestamp(spark):
    rows = [(1, "a", None, 1.0), (2, "a", "x", None), (3, "a", None, None), (4, "b", "y", 2.0)]
    df = spark.createDataFrame(rows, "ord long, t string, c string, v double")
    out = {r["t"]: r for r in temporal.last_non_null_per_timestamp(df, [], "t", "ord", ["c", "v"]).collect()}
    assert out["a"]["c"] == "x" and out["a"]["v"] == 1.0 and out["a"]["n_rows"] == 3
    assert out["b"]["c"] == "y"


def test_merge_energy_and_weather(spark, timestamped_energy, weather):
    e = prepare_for_merge(timestamped_energy.withColumn("_ord", F.monotonically_increasing_id()), "_ord")
    w = prepare_for_merge(weather.withColumn("_ord", F.monotonically_increasing_id()), "_ord")
    m = merge.merge_on_time([("energy.csv", e), ("weather.csv", w)], "timestamp", target="Потребление")
    assert m.count() == 10
    assert {"timestamp", "Потребление", "Температура наружная", "Облачность"} <= set(m.columns)
    assert "Дата" not in m.columns and "dateByOurs" not in m.columns


def test_merge_conflict_alias(spark):
    a = spark.createDataFrame([(datetime(2024, 1, 1), 1.0), (datetime(2024, 1, 2), 2.0)], "timestamp timestamp_ntz, v double")
    b = spark.createDataFrame([(datetime(2024, 1, 2), 5.0), (datetime(2024, 1, 3), 3.0)], "timestamp timestamp_ntz, v double")
    m = {r["timestamp"]: r for r in merge.merge_on_time([("a.csv", a), ("Second file.csv", b)]).collect()}
    assert m[datetime(2024, 1, 2)]["v"] == 2.0 and m[datetime(2024, 1, 2)]["v__second_file"] == 5.0
    assert m[datetime(2024, 1, 3)]["v"] == 3.0


def test_temporal_order_positions_and_rows_without_an_axis(spark):
    from datetime import datetime

    from verdin.operators.temporal import temporal_order
    df = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, None), (3, datetime(2024, 1, 1)), (4, datetime(2024, 1, 2))], "n long, at timestamp_ntz")
    assert [r.n for r in temporal_order(df, "at", "n").collect()] == [3, 1, 4]
    assert {r.n: r.place for r in temporal_order(df, "at", "n", position="place").collect()} == {3: 1, 1: 2, 4: 3}
    assert [r.n for r in temporal_order(df, None, "n").collect()] == [1, 2, 3, 4]


def test_items_attached_by_row(spark):
    from verdin.operators.merge import attach_by_row
    p = spark.createDataFrame([(1, 0.5), (2, 0.7)], "row_id long, prediction double")
    items = spark.createDataFrame([(1, ["a"], "m"), (9, ["z"], "m")], "row_id long, factors array<string>, method string")
    got = {r.row_id: (r.factors, r.method) for r in attach_by_row(p, items, empty=["factors"]).collect()}
    assert got == {1: (["a"], "m"), 2: ([], None)}
