"""Stand-in datasets derived from the driver tables.

These only shape rows into the schema an operator expects (a series, a version
table, a scored frame); every operator then runs its full logic on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.functions.timefuncs import floor_to
from verdin.sources.tables import table


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, ts, y): hourly sum of ``events.value`` per event type (J4/R2 shape)."""
    ev = table(spark, sf, "events")
    return (ev.groupBy(F.col("event_type").alias("series_id"), floor_to("ts", 3600).alias("ts"))
            .agg(F.bround(F.sum("value"), 6).alias("y")))


def daily_supplier_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, ts, y): daily extended price per supplier; one series per supplier."""
    li = table(spark, sf, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("series_id"), floor_to("l_shipdate", 86400).alias("ts"))
            .agg(F.bround(F.sum("l_extendedprice"), 4).alias("y")))
