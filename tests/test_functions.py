from datetime import datetime

from pyspark.sql import functions as F

from verdin.functions import numeric, text, timefuncs


def test_time_to_minutes(spark):
    df = spark.createDataFrame([("06:15",), ("06:12",), ("6:12:30",), ("abc",), (None,), ("1:2:3:4",)], "t string")
    out = [r["m"] for r in df.select(timefuncs.time_to_minutes("t").alias("m")).collect()]
    assert out[:3] == [375.0, 372.0, 372.5]
    assert out[3:] == [None, None, None]


def test_datetime_projection_monday_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5, 30),), (None,)], "ts timestamp_ntz")
    rows = df.select(*timefuncs.datetime_projection(F.col("ts"), "d")).collect()
    assert rows[0]["d__ts"] == 1704087000 and rows[0]["d__hour"] == 5
    assert rows[0]["d__dayofweek"] == 0 and rows[0]["d__month"] == 1
    assert tuple(rows[1]) == (0, 0, 0, 0)


def test_parse_timestamp_formats_and_rejections(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("20.03.2026",), ("06:15",), ("",), ("Customer#1",)], "t string")
    out = [r["p"] for r in df.select(timefuncs.parse_timestamp("t").alias("p")).collect()]
    assert out[0] == datetime(2024, 1, 2, 3, 4, 5)
    assert out[1] == datetime(2026, 3, 20)
    assert out[2:] == [None, None, None]


def test_slug_and_collisions(spark):
    df = spark.createDataFrame([(1, "Электроэнергия март"), (2, "  !!! "), (3, "Электроэнергия  март"), (4, "Ёлка")],
                               "id int, name string")
    s = df.select("id", text.slugify(F.col("name")).alias("slug"))
    rows = {r["id"]: r for r in text.unique_slugs(s, "slug", ["id"]).collect()}
    assert rows[1]["slug"] == "электроэнергия-март" and rows[1]["project_id"] == "электроэнергия-март"
    assert rows[2]["slug"] == "project"
    assert rows[3]["project_id"] == "электроэнергия-март-2"
    assert rows[4]["slug"] == "елка"


def test_clean_name_duration_and_round(spark):
    df = spark.createDataFrame([("  a   b ", 86400.0, 2.5e-7), ("   ", 7200.0, 1.0000005), (None, 90.0, float("nan"))],
                               "n string, s double, x double")
    rows = df.select(text.clean_name("n").alias("n"), text.duration_label("s").alias("d"),
                     numeric.safe_round("x").alias("r")).collect()
    assert [r["n"] for r in rows] == ["a b", None, None]
    assert [r["d"] for r in rows] == ["1 дн", "2 ч", "90 сек"]
    assert rows[0]["r"] == 0.0 and rows[2]["r"] is None


def test_request_shape_equals_a_search_through_the_counts(spark):
    import math

    from verdin.functions.numeric import request_shape
    asked = [None, float("nan"), float("inf"), -3.0, 0.0, 4.0, 15.0, 120.0, 1439.0, 5000.0]
    cases = [(a, c, p) for a in asked for c in (0, 1, 7, 60, 2000) for p in (None, float("nan"), float("inf"), 0.0, -1.0, 0.4, 1.5, 2.5, 2.51, 50.0, 719.5, 5000.0)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(cases)], "a double, c int, p double, i int")
    got = {r.i: r for r in df.select("i", *request_shape("a", "c", "p")).collect()}
    for i, (a, c, p) in enumerate(cases):
        usable = a is not None and math.isfinite(a) and a > 0
        interval = min(max(math.floor(a / 10 + 0.5) * 10, 10), 1440) if usable else 120
        cadence = max(c, 1)
        steps = max(1, math.ceil(interval / cadence))
        counts = range(1, min(steps, 720) + 1)
        points = min(counts, key=lambda n: (abs(n - p), n)) if p is not None and math.isfinite(p) and p > 0 else counts[-1]
        r = got[i]
        assert (r.interval_minutes, r.steps, r.total_minutes, r.point_count) == (interval, steps, steps * cadence, points), (a, c, p)
        assert abs(r.display_step_minutes - steps * cadence / points) < 1e-6


def test_time_of_a_record(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from verdin.functions.timefuncs import record_time_of
    rows = [("2024-01-02 03:04:05", "2023-01-01", 1700000000), (None, "2023-01-01", 1700000000), ("nothing", None, 1700000000), (None, None, None)]
    df = spark.createDataFrame(rows, "date string, `Дата` string, made__ts long").select(F.struct("*").alias("record"))
    assert [r[0] for r in df.select(record_time_of(df, "record")).collect()] == [
        datetime(2024, 1, 2, 3, 4, 5), datetime(2023, 1, 1), datetime(2023, 11, 14, 22, 13, 20), None]
    bare = df.select(F.struct(F.lit(1).alias("x")).alias("record"))
    assert bare.select(record_time_of(bare, "record")).first()[0] is None
