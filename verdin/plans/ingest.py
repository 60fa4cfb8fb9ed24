"""Source/sink queries: the driver tables are written out as files in a fresh scratch
folder under the shared checkpoint directory, then read back through the library's
ingestion path (S1–S5, S8–S11, J5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.functions import timefuncs as tf
from verdin.session import scratch_table_path
from verdin.sources import tabular
from verdin.plans.registry import register
from verdin.sources.tables import table


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _write_csv(df: DataFrame, path: str, sep: str, encoding: str) -> None:
    if encoding.upper() not in ("UTF-8", "ISO-8859-1", "US-ASCII"):
        # Spark 4 writes only a few charsets unless Java charsets are allowed
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


@register("csv_ingest", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal,
  c_mktsegment, 'Клиент ' || c_name AS "Клиент" FROM customer
""")
def csv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S3 + S4: customer written as windows-1251 text with ';' and a Cyrillic column,
    probed (encoding, delimiter) and read back with schema inference."""
    root = _scratch(spark, "csv_ingest")
    c = table(spark, sf, "customer")
    _write_csv(c.withColumn("Клиент", F.concat(F.lit("Клиент "), F.col("c_name"))), f"{root}/customer",
               ";", "windows-1251")
    return tabular.normalize_frame(tabular.read_csv_collection(spark, f"{root}/customer").drop("_source"))


def _hourly_source(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    ev = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return (ev.groupBy(tf.floor_to("ts", 3600).alias("hour"))
            .agg(F.bround(F.sum("value"), 6).alias("value"), F.count_distinct("user_id").cast("double").alias("users"))
            .select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value", "users"))


_SRC = """SELECT date_trunc('hour', ts) AS timestamp, round(sum(value), 6) AS value,
  CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM events WHERE event_type = '{k}' GROUP BY 1"""

# column order of each source; all but the last share encoding and delimiter
_LAYOUT = {"click": ("ts", "value", "users"), "error": ("users", "ts", "value"), "purchase": ("value", "users", "ts"),
           "signup": ("ts", "users", "value"), "view": ("ts", "value", "users", "комментарий")}


def _merge_sql() -> str:
    kinds = list(_LAYOUT)
    steps, extra = [f"{k}_ AS ({_SRC.format(k=k)})" for k in kinds], ""
    before = f"{kinds[0]}_"
    for k in kinds[1:]:
        steps.append(f"""m_{k} AS (SELECT coalesce(a.timestamp, b.timestamp) AS timestamp, coalesce(a.value, b.value) AS value,
          coalesce(a.users, b.users) AS users{extra}, b.value AS value__{k}, b.users AS users__{k}
          {", CASE WHEN b.timestamp IS NOT NULL THEN 'просмотр' END AS \"комментарий\"" if k == "view" else ""}
          FROM {before} a FULL OUTER JOIN {k}_ b ON a.timestamp = b.timestamp)""")
        extra += f", a.value__{k}, a.users__{k}"
        before = f"m_{k}"
    return f"WITH {', '.join(steps)} SELECT * FROM {before} WHERE value IS NOT NULL"


@register("collection_ingest", _merge_sql())
def collection_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S9 + S11 + J5: one hourly source per event type, four of them with one encoding and
    delimiter but headers in different orders, the fifth in windows-1251 with ';' and a
    text column; ingested as one collection and merged on the inferred time axis with
    target ``value``."""
    root = _scratch(spark, "collection")
    for kind, names in _LAYOUT.items():
        rows = _hourly_source(spark, sf, kind).withColumn("комментарий", F.lit("просмотр")).select(*names)
        last = kind == "view"
        _write_csv(rows, f"{root}/{kind}", ";" if last else ",", "windows-1251" if last else "UTF-8")
    return tabular.ingest(spark, f"{root}/*", target="value")


@register("snapshot_roundtrip", "SELECT * FROM orders")
def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Three dataset versions of different schemas saved under project/version folders; one is
    deleted, one read back while the third, with its own schema, stays."""
    root = _scratch(spark, "snapshots")
    tabular.save_dataset(table(spark, sf, "orders"), root, "orders", "v1")
    tabular.save_dataset(table(spark, sf, "customer"), root, "customers", "v1")
    tabular.save_dataset(table(spark, sf, "nation"), root, "nations", "v1")
    tabular.delete_path(spark, tabular.dataset_path(root, "nations"))
    return tabular.load_dataset(spark, root, "orders", "v1")


@register("dataset_registry", """
SELECT 'orders' AS project_id, 'v1' AS version_id, 'o_orderpriority' AS target, count(*) AS rows, 6 AS columns FROM orders
UNION ALL
SELECT 'customers', 'v1', 'c_mktsegment', count(*), 5 FROM customer
""")
def dataset_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Register two dataset versions and read the registry table back."""
    root = _scratch(spark, "registry")
    tabular.register_dataset_version(spark, root, table(spark, sf, "orders"), "orders", "v1", "o_orderpriority")
    tabular.register_dataset_version(spark, root, table(spark, sf, "customer"), "customers", "v1", "c_mktsegment")
    reg = spark.read.parquet(f"{root}/dataset_versions")
    return reg.select("project_id", "version_id", "target", "rows", "columns")


@register("json_records", """
SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice,
  'o_orderdate': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'o_orderpriority': o_orderpriority}) AS VARCHAR) AS record FROM orders
""")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """JSON-safe projection of every order (ISO timestamps, NaN → null)."""
    return tabular.json_safe(table(spark, sf, "orders"))
