from pyspark.sql import functions as F

from tests.conftest import SF0001
from verdin.functions.timefuncs import floor_to
from verdin.sources.tables import table
from verdin.streaming import streams


def test_stream_hourly_equals_batch(spark):
    ev = table(spark, SF0001, "events")
    got = {(r["window_start"], r["event_type"]): (r["value"], r["n"]) for r in streams.run_hourly(spark, ev).collect()}
    exp = (ev.groupBy(floor_to("ts", 3600).alias("w"), "event_type")
           .agg(F.bround(F.sum("value"), 6).alias("v"), F.count(F.lit(1)).alias("n")).collect())
    assert len(got) == len(exp)
    for r in exp:
        v, n = got[(r["w"], r["event_type"])]
        assert n == r["n"] and abs(v - r["v"]) < 1e-6
