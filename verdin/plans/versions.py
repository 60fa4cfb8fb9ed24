"""Version-table queries: numbering, metric history, champion replay, history join,
project summaries, activation, slugs and labels (L1–L4, L10, J7, W12, W13, K4, U2, X5, X6, X8, X9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.functions import text as T
from verdin.functions import timefuncs as tf
from verdin.operators import lifecycle as L
from verdin.plans.registry import register
from verdin.plans.timeseries import duration_sql
from verdin.sources.tables import table


def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in model registry: one model version per order, one project per customer,
    rmse-like metric from the order total, trained on the customer's yearly dataset."""
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("project_id"),
                    F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"),
                    F.lit("regression").alias("task_type"), F.lit("rmse").alias("metric_name"),
                    F.bround(F.col("o_totalprice") / 1000.0, 6).alias("metric_value"),
                    (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("dataset_version_id"))


def dataset_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in dataset registry: one version per customer and order year."""
    m = model_versions(spark, sf)
    return m.groupBy("project_id", "dataset_version_id").agg(F.min("created_at").alias("created_at"),
                                                             F.count(F.lit(1)).alias("rows"))


_MV = """mv AS (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS project_id, o_orderkey AS version_id,
  o_orderdate AS created_at, round_even(o_totalprice / 1000.0, 6) AS metric_value,
  o_custkey * 10000 + year(o_orderdate) AS dataset_version_id FROM orders)"""
_W = "PARTITION BY project_id ORDER BY created_at, version_id"


@register("version_numbers", f"""
WITH {_MV} SELECT project_id, version_id, CAST(row_number() OVER ({_W}) AS INTEGER) AS version_number FROM mv
""")
def version_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Dense version numbers per project."""
    return L.version_numbers(model_versions(spark, sf)).select("project_id", "version_id", "version_number")


@register("metric_delta", f"""
WITH {_MV}, d AS (SELECT *, lag(metric_value) OVER ({_W}) AS previous_value FROM mv)
SELECT project_id, version_id, metric_value, previous_value, round_even(metric_value - previous_value, 6) AS delta,
  CASE WHEN previous_value IS NULL THEN NULL WHEN metric_value > previous_value THEN 'up'
       WHEN metric_value < previous_value THEN 'down' ELSE 'flat' END AS trend,
  CASE WHEN previous_value IS NULL THEN NULL ELSE metric_value < previous_value END AS is_improvement
FROM d
""")
def metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Metric change against the previous version (rmse: down is an improvement)."""
    return L.metric_delta(model_versions(spark, sf), "rmse").select(
        "project_id", "version_id", "metric_value", "previous_value", "delta", "trend", "is_improvement")


_CHAMP = f"""c AS (SELECT *, min(metric_value) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM mv),
p AS (SELECT *, best IS NULL OR metric_value < best AS promoted FROM c),
s AS (SELECT *, max(CASE WHEN promoted THEN struct_pack(c := created_at, v := version_id) END)
                  OVER (PARTITION BY project_id) AS last_promo FROM p),
st AS (SELECT *, CASE WHEN promoted AND struct_pack(c := created_at, v := version_id) = last_promo THEN 'champion'
                      WHEN promoted THEN 'archived' ELSE 'candidate' END AS status FROM s)"""


@register("champion_promotion", f"""
WITH {_MV}, {_CHAMP} SELECT project_id, version_id, promoted, status FROM st
""")
def champion_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """L1: replay registrations; strict improvement promotes, the last promoted is champion."""
    return L.champion_history(model_versions(spark, sf)).select("project_id", "version_id", "promoted", "status")


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    models = L.champion_history(model_versions(spark, sf))
    return models, dataset_versions(spark, sf)


@register("model_history", f"""
WITH {_MV}, {_CHAMP},
ds AS (SELECT dataset_version_id, count(*) AS dataset_rows FROM mv GROUP BY 1)
SELECT st.project_id, st.version_id, st.dataset_version_id, ds.dataset_rows,
  CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, version_id DESC) AS INTEGER) AS history_rank,
  row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, version_id DESC) = 1 AS is_latest,
  status = 'champion' AS is_champion, metric_value
FROM st LEFT JOIN ds USING (dataset_version_id)
""")
def model_history(spark: SparkSession, sf: str) -> DataFrame:
    """J7 + K4: model history joined to dataset versions with latest/champion flags."""
    models, datasets = _registry(spark, sf)
    h = L.model_history(models, datasets)
    return h.select("project_id", "version_id", "dataset_version_id", "dataset_rows", "history_rank", "is_latest",
                    "is_champion", "metric_value")


@register("project_summary", f"""
WITH {_MV}, {_CHAMP},
ds AS (SELECT project_id, dataset_version_id, min(created_at) AS created_at FROM mv GROUP BY 1, 2),
u AS (SELECT project_id, min(created_at) AS created_at FROM
        (SELECT project_id, created_at FROM ds UNION ALL SELECT project_id, created_at FROM mv) GROUP BY 1),
d AS (SELECT project_id, count(*) AS dataset_count, arg_max(dataset_version_id, struct_pack(c := created_at, v := dataset_version_id)) AS latest_dataset_id,
             max(created_at) AS d_last FROM ds GROUP BY 1),
m AS (SELECT project_id, count(*) AS model_count, arg_max(version_id, struct_pack(c := created_at, v := version_id)) AS latest_model_id,
             max(CASE WHEN status = 'champion' THEN version_id END) AS champion_id, max(created_at) AS m_last
      FROM st GROUP BY 1)
SELECT u.project_id, u.created_at, coalesce(dataset_count, 0) AS dataset_count, latest_dataset_id,
  coalesce(model_count, 0) AS model_count, latest_model_id, champion_id,
  greatest(d_last, m_last, u.created_at) AS last_activity
FROM u LEFT JOIN d USING (project_id) LEFT JOIN m USING (project_id)
""")
def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    """L4 + U2: one row per project with counts, latest versions, champion and last activity."""
    models, datasets = _registry(spark, sf)
    return L.project_summary(datasets, models).select(
        "project_id", "created_at", "dataset_count", "latest_dataset_id", "model_count", "latest_model_id",
        "champion_id", "last_activity")


ACTIVATE_VERSION = 7


@register("activate_version", f"""
WITH {_MV}, {_CHAMP},
t AS (SELECT project_id AS tp FROM mv WHERE version_id = {ACTIVATE_VERSION} LIMIT 1)
SELECT project_id, version_id, CASE WHEN version_id = {ACTIVATE_VERSION} THEN 'champion'
  WHEN tp IS NOT NULL AND status = 'champion' THEN 'archived' ELSE status END AS status
FROM st LEFT JOIN t ON st.project_id = t.tp
""")
def activate_version(spark: SparkSession, sf: str) -> DataFrame:
    """L2: activate one version; its project's previous champion is archived."""
    models, _ = _registry(spark, sf)
    return L.activate(models, ACTIVATE_VERSION).select("project_id", "version_id", "status")


@register("slug_ids", r"""
WITH s AS (SELECT p_partkey, CASE WHEN x IS NULL OR x = '' THEN 'project' ELSE x END AS slug FROM (
  SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_name), 'ё', 'е'), '[^a-z0-9а-я]+', '-', 'g'),
                                   '^-+|-+$', '', 'g') AS x FROM part)),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS rk FROM s),
t AS (SELECT *, CASE WHEN rk = 1 THEN slug ELSE slug || '-' || CAST(rk AS VARCHAR) END AS try FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY try ORDER BY rk, p_partkey) AS clash FROM t)
SELECT p_partkey, slug, CASE WHEN clash = 1 THEN try ELSE try || '-' || CAST(clash AS VARCHAR) END AS project_id FROM c
""")
def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Project ids from part names with collision suffixes in part-key order."""
    p = table(spark, sf, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))
    return T.unique_slugs(p, "slug", ["p_partkey"]).select("p_partkey", "slug", "project_id")


@register("display_names", r"""
SELECT p_partkey, nullif(trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\s+', ' ', 'g')), '') AS display_name
FROM part
""")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    """Whitespace-collapsed display names (blank → null)."""
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_type"), F.lit(" "))
    return p.select("p_partkey", T.clean_name(raw).alias("display_name"))


@register("duration_label", f"""
SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS offset_seconds,
  {duration_sql("(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6")} AS label,
  {duration_sql("epoch(time_bucket(INTERVAL '1 minute', ts)) - epoch(TIMESTAMP '2024-01-01')")} AS minute_label
FROM events
""")
def duration_label(spark: SparkSession, sf: str) -> DataFrame:
    """Labels for each event's offset from the start of the month (raw and minute-floored)."""
    ev = table(spark, sf, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    off = (tf.epoch_micros("ts") - tf.epoch_micros(start)) / 1e6
    off_min = tf.epoch_seconds(tf.floor_to("ts", 60)) - tf.epoch_seconds(start)
    return ev.select("event_id", off.alias("offset_seconds"), T.duration_label(off).alias("label"),
                     T.duration_label(off_min).alias("minute_label"))


@register("source_label", """
WITH s AS (SELECT n.n_name, s.s_name, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY s.s_suppkey) AS rk,
                  count(*) OVER (PARTITION BY n.n_nationkey) AS cnt
           FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT n_name, CAST(max(cnt) AS INTEGER) AS files,
  CASE WHEN max(cnt) = 1 THEN max(s_name) || '.csv'
       ELSE CAST(max(cnt) AS VARCHAR) || ' файлов: ' || string_agg(s_name || '.csv', ', ' ORDER BY rk)
            || CASE WHEN max(cnt) > 3 THEN ' и ещё ' || CAST(max(cnt) - 3 AS VARCHAR) ELSE '' END END AS label
FROM s WHERE rk <= 3 GROUP BY n_name
""")
def source_label(spark: SparkSession, sf: str) -> DataFrame:
    """One source label per nation from its suppliers' file names (first three + count).

    Only the first three names per group are gathered (row_number ≤ 3), so the
    collected list is bounded whatever the group size."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey).select("n_nationkey", "n_name", "s_suppkey",
                                                         F.concat("s_name", F.lit(".csv")).alias("file"))
    from verdin.operators.series import sequenced
    # ordinals per nation from the chunked primitive: a nation holding most suppliers is
    # still numbered by many tasks; the count per nation comes with it
    r = sequenced(j, ["n_nationkey"], ["s_suppkey"]).withColumnRenamed("_pos", "rk")
    counts = r.groupBy("n_nationkey").agg(F.max("_n").cast("int").alias("files"))
    top = r.filter(F.col("rk") <= 3).groupBy("n_nationkey", "n_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "file"))), lambda x: x["file"]).alias("names"))
    out = top.join(counts, "n_nationkey")
    return out.select("n_name", "files", T.source_label(F.col("names"), F.col("files")).alias("label"))


DELETED_PROJECT = "cust-7"


@register("project_delete", f"""
WITH {_MV} SELECT project_id, version_id FROM mv WHERE project_id <> '{DELETED_PROJECT}'
""")
def project_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Remove one project's rows from the model-version table (left anti join)."""
    from verdin.operators.merge import remove_project
    m = model_versions(spark, sf).select("project_id", "version_id")
    doomed = spark.createDataFrame([(DELETED_PROJECT,)], "project_id string")
    return remove_project(m, doomed)
