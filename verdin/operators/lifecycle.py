"""Dataset/model version tables and their views.

Version tables are metadata: one row per registered dataset or model.  Views are
windows partitioned by project and grouped aggregates; writes are whole-table
rewrites of these small tables (Parquet, partitioned by project).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdin.functions.text import clean_name
from verdin.operators.metrics import lower_is_better

MODEL_STATUSES = ("champion", "archived", "candidate")


def _order_new_first():
    return [F.col("created_at").desc(), F.col("version_id").desc()]


def version_numbers(df: DataFrame, project: str = "project_id") -> DataFrame:
    """Dense version numbers per project by (created_at, version_id)."""
    w = Window.partitionBy(project).orderBy("created_at", "version_id")
    return df.withColumn("version_number", F.row_number().over(w))


def metric_delta(df: DataFrame, metric: str = "rmse", project: str = "project_id") -> DataFrame:
    """Change of the metric against the previous version of the project and its
    direction (up/down/flat) plus whether that change is an improvement."""
    w = Window.partitionBy(project).orderBy("created_at", "version_id")
    prev = F.lag("metric_value").over(w)
    delta = F.col("metric_value") - prev
    lower = lower_is_better(metric)
    return (df.withColumn("previous_value", prev)
            .withColumn("delta", F.bround(delta, 6))
            .withColumn("trend", F.when(delta.isNull(), F.lit(None)).when(delta > 0, F.lit("up"))
                        .when(delta < 0, F.lit("down")).otherwise(F.lit("flat")))
            .withColumn("is_improvement", F.when(delta.isNull(), F.lit(None))
                        .otherwise((delta < 0) if lower else (delta > 0))))


def champion_history(df: DataFrame, metric: str = "rmse", project: str = "project_id",
                     mode: str = "auto") -> DataFrame:
    """L1 replayed over registration order: a version is promoted when no champion
    exists or it strictly beats the running best; ``candidate`` mode never promotes.
    Final status: the last promoted version is champion, earlier promoted ones are
    archived, the rest stay candidates."""
    w = Window.partitionBy(project).orderBy("created_at", "version_id")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    lower = lower_is_better(metric)
    best_before = F.min("metric_value").over(prior) if lower else F.max("metric_value").over(prior)
    beats = (F.col("metric_value") < best_before) if lower else (F.col("metric_value") > best_before)
    promoted = F.lit(False) if mode == "candidate" else (best_before.isNull() | beats)
    df = df.withColumn("promoted", promoted)
    last_promo = F.max(F.when(F.col("promoted"), F.struct("created_at", "version_id"))).over(Window.partitionBy(project))
    is_champ = F.col("promoted") & (F.struct("created_at", "version_id") == last_promo)
    return df.withColumn("status", F.when(is_champ, F.lit("champion"))
                         .when(F.col("promoted"), F.lit("archived")).otherwise(F.lit("candidate")))


def activate(df: DataFrame, version_id, project: str = "project_id") -> DataFrame:
    """L2: make one version champion and archive the project's current champion."""
    # the version's project comes from a one-row lookup (broadcast of a single row)
    proj =df.filter(F.col("version_id") == F.lit(version_id)).select(F.col(project).alias("_tp")).limit(1)
    j = df.join(F.broadcast(proj), F.col(project) == F.col("_tp"), "left")
    status = (F.when(F.col("version_id") == F.lit(version_id), F.lit("champion"))
              .when(F.col("_tp").isNotNull() & (F.col("status") == "champion"), F.lit("archived"))
              .otherwise(F.col("status")))
    return j.withColumn("status", status).drop("_tp")


def latest(df: DataFrame, project: str = "project_id") -> DataFrame:
    """K4/L3: newest record per project by (created_at, version_id) (Q10 tie-break).
    A grouped ``max_by`` over a struct — no window, so a project with many versions is
    pre-aggregated per partition."""
    cols = [c for c in df.columns if c != project]
    best = df.groupBy(project).agg(F.max_by(F.struct(*cols), F.struct("created_at", "version_id")).alias("_r"))
    return best.select(project, "_r.*")


def model_history(models: DataFrame, datasets: DataFrame, project: str = "project_id") -> DataFrame:
    """Models left-joined to their dataset version, newest first, with latest and
    champion flags."""
    w = Window.partitionBy(project).orderBy(*_order_new_first())
    ds = datasets.select(F.col("dataset_version_id"), F.col("rows").alias("dataset_rows"),
                         F.col("created_at").alias("dataset_created_at"))
    j = models.join(ds, "dataset_version_id", "left")
    return (j.withColumn("history_rank", F.row_number().over(w))
            .withColumn("is_latest", F.col("history_rank") == 1)
            .withColumn("is_champion", F.col("status") == "champion"))


def project_summary(datasets: DataFrame, models: DataFrame, project: str = "project_id") -> DataFrame:
    """L4 + U2: every project seen in either table with counts, latest dataset and model,
    champion, and last activity; grouped aggregates plus ``max_by`` (no driver loop)."""
    from verdin.operators.merge import project_universe
    empty_projects = datasets.select(project, "created_at").limit(0)
    universe = project_universe(empty_projects, datasets.select(project, "created_at"),
                                models.select(project, "created_at"))
    d = datasets.groupBy(project).agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.max_by("dataset_version_id", F.struct("created_at", "dataset_version_id")).alias("latest_dataset_id"),
        F.max("created_at").alias("_d_last"))
    m = models.groupBy(project).agg(
        F.count(F.lit(1)).alias("model_count"),
        F.max_by("version_id", F.struct("created_at", "version_id")).alias("latest_model_id"),
        F.max_by(F.when(F.col("status") == "champion", F.col("version_id")),
                 F.when(F.col("status") == "champion", F.struct("created_at", "version_id"))).alias("champion_id"),
        F.max("created_at").alias("_m_last"))
    out = universe.join(d, project, "left").join(m, project, "left")
    return (out.withColumn("last_activity", F.greatest("_d_last", "_m_last", "created_at"))
            .na.fill(0, ["dataset_count", "model_count"])
            .drop("_d_last", "_m_last"))


def set_texts(df: DataFrame, changes: DataFrame, column: str, keys=("project_id", "version_id")) -> DataFrame:
    """``column`` of the records named in ``changes`` (keys and ``value``) set to the cleaned value (blank → null); all other
    records stay.  One join for any number of changes; of several changes of one record the largest value counts."""
    new = changes.groupBy(*keys).agg(F.struct(clean_name(F.max("value")).alias("v")).alias("_new"))
    return df.join(new, list(keys), "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))) \
        .select(*df.columns)


def _listed(path: str) -> Column:
    return F.from_json(F.get_json_object("record", path), "array<string>")


def model_summary(models: DataFrame) -> DataFrame:
    """Compact view of model records: the columns of the version, and of its training record the target, the primary metric, all
    metrics, the features, and what it can forecast (with sizes in place of the rows it holds).  Missing parts are null, sizes 0."""
    def of(path):
        return F.get_json_object("record", path)

    def size(path):
        return F.coalesce(F.json_array_length(of(path)), F.lit(0))

    forecasting = F.struct(F.coalesce(of("$.forecasting.enabled") == "true", F.lit(False)).alias("available"),
                           of("$.forecasting.default_horizon_minutes").cast("int").alias("default_horizon_minutes"),
                           of("$.forecasting.base_frequency_minutes").cast("int").alias("base_frequency_minutes"),
                           size("$.forecasting.recent_history").alias("recent_history_rows"), size("$.forecasting.historical_fit").alias("historical_fit_rows"),
                           of("$.forecasting.forecasting_model").alias("forecast_model"))
    features = F.coalesce(_listed("$.features"), F.array().cast("array<string>"))
    return models.select("project_id", "version_id", "name", "dataset_version_id", "task_type", of("$.target").alias("target"),
                         F.coalesce(of("$.primary_metric"), F.col("metric_name")).alias("primary_metric"), "metric_value",
                         F.from_json(of("$.metrics"), "map<string,double>").alias("metrics"), "status", features.alias("feature_names"),
                         "created_at", forecasting.alias("forecasting"))


# ---------------------------------------------------------------------------
# Registry tables on shared storage

MODEL_SCHEMA = ("project_id string, version_id string, dataset_version_id string, task_type string, "
                "metric_name string, metric_value double, status string, created_at timestamp_ntz, record string, bundle_path string, name string")
FORECAST_SCHEMA = "run_id string, project_id string, step int, ts timestamp_ntz, prediction double, unit string"


class Registry:
    """Version tables as Parquet under ``root`` partitioned by project (partition pruning on
    every lookup).  A registration rewrites only its project's partition (dynamic partition
    overwrite), after a reliable checkpoint so the read and the overwrite never overlap."""

    def __init__(self, spark, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reads -------------------------------------------------------------
    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":   # any other error must not pass for an empty table
                raise
            return self.spark.createDataFrame([], schema)

    def models(self, project_id: str | None = None) -> DataFrame:
        df = self._read("model_versions", MODEL_SCHEMA)
        return df if project_id is None else df.filter(F.col("project_id") == project_id)

    def datasets(self, project_id: str | None = None) -> DataFrame:
        from verdin.sources.tabular import DATASET_VERSION_SCHEMA
        df = self._read("dataset_versions", DATASET_VERSION_SCHEMA)
        return df if project_id is None else df.filter(F.col("project_id") == project_id)

    def _write_project(self, name: str, df: DataFrame) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("project_id").parquet(f"{self.root}/{name}"))

    # -- L1 / L2 / L5 -------------------------------------------------------
    def register_datasets(self, versions: DataFrame) -> None:
        """S10 for any number of projects at once: append the rows (columns of the dataset table).  A version that is there
        already is an error."""
        from verdin.sources.tabular import DATASET_VERSION_SCHEMA
        rows = versions.select(*[c.split()[0] for c in DATASET_VERSION_SCHEMA.split(", ")]).checkpoint(eager=True)
        self._refuse_known(rows, self.datasets())
        rows.write.mode("append").partitionBy("project_id").parquet(f"{self.root}/dataset_versions")

    @staticmethod
    def _refuse_known(new: DataFrame, old: DataFrame) -> None:
        keys = ["project_id", "version_id"]
        twice = new.groupBy(*keys).count().where("count > 1").select(*keys).unionByName(new.join(old, keys, "left_semi").select(*keys)).limit(1).collect()
        if twice:
            raise ValueError(f"project {twice[0][0]!r} has a version {twice[0][1]!r} already")

    def register_models(self, new: DataFrame) -> None:
        """L1/L5 for any number of projects at once: rows (columns of the model table without status, and ``mode``: auto or candidate)
        join their projects in the order of (created_at, version_id).  One becomes champion where its project has none or it is strictly
        better on the primary metric than the champion so far; the one before is archived; ``candidate`` rows stay candidates.
        Windows over a project's new versions; the projects' partitions are replaced."""
        if "name" not in new.columns:
            new = new.withColumn("name", F.lit(None).cast("string"))
        rows = new.checkpoint(eager=True)
        old = self.models()
        self._refuse_known(rows, old)
        projects = rows.select("project_id").distinct()
        mine = old.join(projects, "project_id", "left_semi").checkpoint(eager=True)
        # negative where larger is better, so that the least value is the best
        sign = F.when(F.col("metric_name") == "rmse", F.lit(1.0)).otherwise(F.lit(-1.0))
        held = mine.where("status = 'champion'").groupBy("project_id").agg(F.min(sign * F.col("metric_value")).alias("_held"))
        w = Window.partitionBy("project_id").orderBy("created_at", "version_id")
        auto = F.when(F.col("mode") != "candidate", sign * F.col("metric_value"))
        ranked = rows.join(held, "project_id", "left").withColumn("_value", auto) \
            .withColumn("_best", F.least("_held", F.min("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)))) \
            .withColumn("_up", F.coalesce(F.col("_value") < F.col("_best"), F.col("_value").isNotNull() & F.col("_best").isNull(), F.lit(False))) \
            .withColumn("_last", F.max(F.when(F.col("_up"), F.struct("created_at", "version_id"))).over(Window.partitionBy("project_id")))
        status = F.when(~F.col("_up"), F.lit("candidate")).when(F.struct("created_at", "version_id") == F.col("_last"), F.lit("champion")).otherwise(F.lit("archived"))
        names = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
        ready = ranked.withColumn("status", status).select(*names)
        ousted = ready.where("status = 'champion'").select("project_id", F.lit(True).alias("_ousted"))
        before = mine.join(ousted, "project_id", "left").withColumn(
            "status", F.when(F.col("_ousted") & (F.col("status") == "champion"), F.lit("archived")).otherwise(F.col("status"))).select(*names)
        self._write_project("model_versions", before.unionByName(ready).checkpoint(eager=True))

    def register_model(self, project_id: str, version_id: str, dataset_version_id: str | None, task_type: str,
                       metric_name: str, metric_value: float, record: dict | None = None,
                       mode: str = "auto", created_at=None, bundle_path: str | None = None, name: str | None = None) -> str:
        """L1/L5 for one version; returns its status."""
        import datetime as dt
        import json
        ts = created_at or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self.register_models(self.spark.createDataFrame(
            [(project_id, version_id, dataset_version_id, task_type, metric_name, float(metric_value), ts, json.dumps(record or {}, default=str), bundle_path, name, mode)],
            MODEL_SCHEMA.replace(" status string,", "") + ", mode string"))
        return self.models(project_id).where(F.col("version_id") == version_id).first()["status"]

    def activate(self, project_id: str, version_id: str) -> None:
        """L2 on the stored table; an unknown version is an error."""
        if not self.models(project_id).where(F.col("version_id") == version_id).limit(1).count():
            raise ValueError(f"project {project_id!r} has no model version {version_id!r}")
        updated = activate(self.models(project_id), version_id).checkpoint(eager=True)
        self._write_project("model_versions", updated)

    def champion(self, project_id: str) -> DataFrame:
        return self.models(project_id).filter(F.col("status") == "champion")

    def latest_model(self, project_id: str) -> DataFrame:
        """L3 (Q10 tie-break on version id)."""
        return latest(self.models(project_id))

    # -- L10 ------------------------------------------------------------------
    def _set_texts(self, name: str, current: DataFrame, changes: DataFrame, column: str) -> None:
        keys = ["project_id", "version_id"]
        changes = changes.select(*keys, F.col("value").cast("string").alias("value")).checkpoint(eager=True)
        unknown = changes.join(current, keys, "left_anti").select(*keys).limit(1).collect()
        if unknown:
            raise ValueError(f"project {unknown[0][0]!r} has no version {unknown[0][1]!r} in {name}")
        mine = current.join(changes.select("project_id").distinct(), "project_id", "left_semi")
        self._write_project(name, set_texts(mine, changes, column).checkpoint(eager=True))

    def rename_models(self, changes: DataFrame) -> None:
        """Names of model versions (project_id, version_id, value); an unknown version is an error and nothing changes."""
        self._set_texts("model_versions", self.models(), changes, "name")

    def rename_datasets(self, changes: DataFrame) -> None:
        """Names of dataset versions, as :meth:`rename_models`."""
        self._set_texts("dataset_versions", self.datasets(), changes, "name")

    def set_units(self, changes: DataFrame) -> None:
        """Units of dataset versions, as :meth:`rename_models`; later forecast runs take the new unit."""
        self._set_texts("dataset_versions", self.datasets(), changes, "unit")

    # -- L7 -------------------------------------------------------------------
    def append_forecast_runs(self, points: DataFrame, dataset_ids: DataFrame | None = None) -> None:
        """L7 for any number of runs at once: points (run_id, project_id, step, ts, prediction) are appended with the unit of the dataset
        version they were forecast from: ``dataset_ids`` (project_id, version_id), by default each project's latest version."""
        ds = self.datasets()
        named = latest(ds) if dataset_ids is None else ds.join(dataset_ids.select("project_id", "version_id").distinct(), ["project_id", "version_id"], "left_semi")
        units = named.select("project_id", "unit")
        names = [c.split()[0] for c in FORECAST_SCHEMA.split(", ")]
        out = points.withColumns({"step": F.col("step").cast("int"), "ts": F.col("ts").cast("timestamp_ntz"), "prediction": F.col("prediction").cast("double")})
        out.join(units, "project_id", "left").select(*names).write.mode("append").partitionBy("project_id").parquet(f"{self.root}/forecast_points")

    def append_forecast_run(self, run_id: str, project_id: str, points: DataFrame, unit: str | None = None) -> None:
        """Append-only forecast points with the dataset unit."""
        out = points.select(F.lit(run_id).alias("run_id"), F.lit(project_id).alias("project_id"),
                            F.col("step").cast("int"), F.col("ts").cast("timestamp_ntz"),
                            F.col("prediction").cast("double"), F.lit(unit).cast("string").alias("unit"))
        out.write.mode("append").partitionBy("project_id").parquet(f"{self.root}/forecast_points")

    def forecast_runs(self, project_id: str | None = None) -> DataFrame:
        df = self._read("forecast_points", FORECAST_SCHEMA)
        return df if project_id is None else df.filter(F.col("project_id") == project_id)

    def forecast_run(self, run_id: str) -> DataFrame:
        return self.forecast_runs().filter(F.col("run_id") == run_id)

    # -- L8 -------------------------------------------------------------------
    def save_comparisons(self, comparisons: DataFrame) -> None:
        """L8 for any number of projects: rows with a ``project_id`` take the place of those projects' snapshots, others keep theirs."""
        self._write_project("comparisons", comparisons)

    def save_comparison(self, project_id: str, comparison: DataFrame) -> None:
        """The latest comparison snapshot, kept per project (the partition is replaced)."""
        self.save_comparisons(comparison.withColumn("project_id", F.lit(project_id)))

    def comparisons(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/comparisons")

    def latest_comparison(self, project_id: str) -> DataFrame:
        return self.comparisons().filter(F.col("project_id") == project_id)

    # -- L12 ------------------------------------------------------------------
    def dataset_summary(self, project_id: str, version_id: str | None = None) -> DataFrame:
        """Metadata of one dataset version, or of the project's latest one (K4)."""
        ds = self.datasets(project_id)
        if version_id is not None:
            return ds.filter(F.col("version_id") == version_id)
        return latest(ds)
