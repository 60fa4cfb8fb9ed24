"""Flows over the registry: train and register (L5), forecast (M17), monitor (L9), delete a project.

Each is a composition of the operators over stored tables: source to snapshot to fitted bundle to registered
version; champion joined to its dataset; snapshots compared column by column.  Only ids, paths and
metrics, one row a version, reach the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.functions.numeric import to_number
from verdin.operators import drift, forecast, ml, search
from verdin.operators.lifecycle import Registry
from verdin.operators.metrics import primary_metric_name
from verdin.operators.temporal import build_timestamp, infer_descriptor
from verdin.options import TrainingOptions
from verdin.sources import tabular


def bundle_path(reg: Registry, project_id: str, version_id: str) -> str:
    return f"{reg.root}/bundles/project_id={project_id}/version_id={version_id}"


def _new_id(kind: str) -> str:
    return f"{kind}-{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"


def store_dataset(reg: Registry, source: DataFrame, project_id: str, target: str, version_id: str | None = None,
                  name: str | None = None, unit: str | None = None) -> str:
    """S4 + S5 + S10: normalise, save a snapshot, register the version; returns its id."""
    version_id = version_id or _new_id("d")
    frame = tabular.normalize_frame(source)
    if target not in frame.columns:
        raise ValueError(f"the source has no column {target!r}")
    if reg.datasets(project_id).where(F.col("version_id") == version_id).limit(1).count():
        raise ValueError(f"project {project_id!r} has a dataset version {version_id!r} already")
    tabular.save_dataset(frame, reg.root, project_id, version_id)
    tabular.register_dataset_version(reg.spark, reg.root, tabular.load_dataset(reg.spark, reg.root, project_id, version_id), project_id, version_id,
                                     target, name, unit)
    return version_id


def train_and_register(reg: Registry, source: DataFrame, project_id: str, target: str, id_col: str, options: TrainingOptions | dict | None = None,
                       dataset_id: str | None = None, model_id: str | None = None, mode: str = "auto", unit: str | None = None,
                       importance: bool = False, **forest_kw) -> dict:
    """Source → snapshot → training (M6) → bundle and holdout table → registered version (L1).  Returns the ids, the status, the
    metrics and the bundle's path."""
    dataset_id = store_dataset(reg, source, project_id, target, dataset_id, unit=unit)
    model_id = model_id or _new_id("m")
    frame = tabular.load_dataset(reg.spark, reg.root, project_id, dataset_id)
    model, holdout, told = search.train(frame, target, id_col, options, importance=importance, **forest_kw)
    path = bundle_path(reg, project_id, model_id)
    tabular.save_model_bundle(reg.spark, model, path)
    tabular.write_holdout(holdout, f"{path}/holdout")
    metric = primary_metric_name(model.task_type)
    record = model.record() | {"id_col": id_col, "options": {k: told[k] for k in ("requested", "effective")}}
    status = reg.register_model(project_id, model_id, dataset_id, model.task_type, metric, model.metrics[metric], record, mode, bundle_path=path)
    return {"dataset_id": dataset_id, "model_id": model_id, "status": status, "metrics": model.metrics, "bundle_path": path, "options": told}


def champions(reg: Registry, project_id: str | None = None) -> DataFrame:
    """A row per project with a champion: its version, dataset version, task, bundle path, and the dataset's target and unit."""
    m = reg.models(project_id).where("status = 'champion'").select(
        "project_id", F.col("version_id").alias("model_id"), F.col("dataset_version_id").alias("dataset_id"), "task_type", "metric_name", "metric_value", "bundle_path", "record")
    d = reg.datasets(project_id).select("project_id", F.col("version_id").alias("dataset_id"), "target", "unit", F.col("rows").alias("dataset_rows"))
    return m.join(d, ["project_id", "dataset_id"], "left")


def champion(reg: Registry, project_id: str) -> dict:
    rows = champions(reg, project_id).collect()       # one row
    if not rows:
        raise ValueError(f"project {project_id!r} has no champion")
    return rows[0].asDict()


def predict(reg: Registry, project_id: str, rows: DataFrame) -> DataFrame:
    """Rows scored by the project's champion, read from its bundle."""
    model = tabular.load_model_bundle(reg.spark, champion(reg, project_id)["bundle_path"])
    return ml.score(model, model.projector.transform(rows))


def series_of(frame: DataFrame, target: str, series_id: str) -> DataFrame:
    """(series_id, ts, y) of an ordinary table: its inferred time axis (J1/J2, J3) and its target as a number.  ValueError without
    a time axis."""
    found = infer_descriptor(frame, target)
    if found is None:
        raise ValueError("forecasting needs a time axis, and none was found")
    return frame.select(F.lit(series_id).alias("series_id"), build_timestamp(frame, found).cast("timestamp_ntz").alias("ts"), to_number(f"`{target}`").alias("y"))


def forecast_project(reg: Registry, project_id: str, steps: int = forecast.DEFAULT_STEPS, horizon_minutes: int | None = None,
                     run_id: str | None = None, **forest_kw) -> str:
    """M14 + M15 + M17 + L7: the champion's dataset, forecast from its inferred time axis and stored as a run; returns the run's id.
    ValueError unless the champion is a regression on a table with a time axis that is long enough."""
    top = champion(reg, project_id)
    if top["task_type"] != "regression":
        raise ValueError(f"only a regression can be forecast; the champion of {project_id!r} is a {top['task_type']} model")
    frame = tabular.load_dataset(reg.spark, reg.root, project_id, top["dataset_id"])
    bundle = forecast.train_forecaster(series_of(frame, top["target"], project_id), ["series_id"], **forest_kw)
    run_id = run_id or _new_id("f")
    reg.append_forecast_run(run_id, project_id, forecast.recursive_forecast(bundle, steps, horizon_minutes), top["unit"])
    return run_id


def monitor(reg: Registry, project_id: str) -> DataFrame:
    """The champion's dataset against the project's latest one, a row per common column (J11), with both version ids and whether they are
    the same dataset (then nothing can have drifted)."""
    reference = champion(reg, project_id)["dataset_id"]
    latest = reg.dataset_summary(project_id).first()["version_id"]
    ref, cur = (tabular.load_dataset(reg.spark, reg.root, project_id, v) for v in (reference, latest))
    out = drift.drift_columns(ref, cur)
    return out.select(F.lit(project_id).alias("project_id"), F.lit(reference).alias("reference_id"), F.lit(latest).alias("current_id"),
                      F.lit(reference == latest).alias("same_dataset"), *out.columns)


def delete_project(reg: Registry, project_id: str) -> list[str]:
    """Every partition of the project in every table and folder of the registry, found from the folders
    themselves; returns the folders that went.  Other projects' folders are not touched."""
    jvm, conf = reg.spark.sparkContext._jvm, reg.spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(reg.root)
    fs = root.getFileSystem(conf)
    gone = []
    for table in [s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []:
        path = f"{table}/project_id={project_id}"
        if fs.exists(jvm.org.apache.hadoop.fs.Path(path)) and tabular.delete_path(reg.spark, path):
            gone.append(path)
    return gone


def record_of(reg: Registry, project_id: str, version_id: str) -> dict:
    """The stored training record of a version."""
    row = reg.models(project_id).where(F.col("version_id") == version_id).select("record").first()
    if row is None:
        raise ValueError(f"project {project_id!r} has no model version {version_id!r}")
    return json.loads(row["record"])


# --- V4 / L6: retraining a project from several sources or a stored version

def needed_inputs(model: ml.TabularModel) -> dict[str, list[str]]:
    """Source column → the model's features made of it: engineered features lead back through the projector to the time
    column they were taken from, all others are columns themselves."""
    times = [*model.projector.getOrDefault(model.projector.datetimeCols), *model.projector.getOrDefault(model.projector.timeCols)]
    out: dict[str, list[str]] = {}
    for f in model.features:
        source = next((t for t in sorted(times, key=len, reverse=True) if f.startswith(f"{t}__")), f)
        out.setdefault(source, []).append(f)
    return out


def gather_batch(model: ml.TabularModel, target: str, sources: dict[str, DataFrame]) -> DataFrame:
    """One table of several sources: each on its inferred time axis, merged (J5); the merged axis takes the name of the model's
    first time column, so that its projected features find their input again."""
    if len(sources) == 1:
        return tabular.normalize_frame(next(iter(sources.values())))
    from verdin.operators.merge import merge_on_time
    from verdin.plans.timeseries import prepare_for_merge
    frames = [(name, prepare_for_merge(tabular.normalize_frame(df).withColumn("_ord", F.monotonically_increasing_id()), "_ord")) for name, df in sources.items()]
    merged = merge_on_time(frames, "timestamp", target)
    axis = next(iter(model.projector.getOrDefault(model.projector.datetimeCols)), None)
    return merged.withColumnRenamed("timestamp", axis) if axis and axis not in merged.columns else merged


def inspect_batch(reg: Registry, project_id: str, sources: dict[str, DataFrame]) -> dict:
    """V4 against the champion: which inputs each source gives, which features and inputs are missing, which columns are extra, and
    whether the merged rows can be trained on."""
    from verdin.operators.profile import ValidationError, validate_training_frame
    from verdin.operators.retrain import MIN_RETRAIN_ROWS
    top = champion(reg, project_id)
    model, record = tabular.load_model_bundle(reg.spark, top["bundle_path"]), json.loads(top["record"])
    batch = gather_batch(model, top["target"], sources)
    needed = needed_inputs(model)
    missing = [s for s in needed if s not in batch.columns]
    problem = None
    if top["target"] not in batch.columns:
        problem = f"target {top['target']!r} is missing"
    else:
        try:
            validate_training_frame(batch, top["target"], min_rows=MIN_RETRAIN_ROWS)
        except ValidationError as exc:
            problem = str(exc)
    return {"champion": {k: top[k] for k in ("model_id", "dataset_id", "task_type", "target")}, "rows": batch.count(), "problem": problem,
            "provided": {name: [s for s in needed if s in df.columns] for name, df in sources.items()},
            "missing_inputs": missing, "missing_features": [f for s in missing for f in needed[s]],
            "extra_columns": [c for c in batch.columns if c not in needed and c not in (top["target"], record.get("id_col"))],
            "ready": problem is None and not missing}


def retrain_project(reg: Registry, project_id: str, sources: dict[str, DataFrame] | None = None, dataset_id: str | None = None,
                    options=None, model_id: str | None = None, **forest_kw) -> dict:
    """L6 for a project: the batch (several sources, or a stored dataset version) is inspected, a candidate is trained on the champion's
    history and the batch's training rows, stored with its own dataset version and registered; it becomes champion where the
    gain on the reserved rows meets the threshold and the options activate it."""
    from verdin.operators.merge import unify_types
    from verdin.operators.retrain import retrain
    from verdin.options import RetrainingOptions
    o = options if isinstance(options, RetrainingOptions) else RetrainingOptions.from_payload(options)
    if (sources is None) == (dataset_id is None):
        raise ValueError("give either sources or a stored dataset version")
    top = champion(reg, project_id)
    model, record = tabular.load_model_bundle(reg.spark, top["bundle_path"]), json.loads(top["record"])
    sources = sources or {dataset_id: tabular.load_dataset(reg.spark, reg.root, project_id, dataset_id)}
    report = inspect_batch(reg, project_id, sources)
    if not report["ready"]:
        raise ValueError(f"the batch cannot be used: {report['problem'] or 'missing inputs ' + ', '.join(report['missing_inputs'])}")
    target, id_col = top["target"], record["id_col"]
    batch = gather_batch(model, target, sources)
    history = tabular.load_dataset(reg.spark, reg.root, project_id, top["dataset_id"])
    axis = next(iter(model.projector.getOrDefault(model.projector.datetimeCols)), None)
    names = [c for c in history.columns if c != id_col]
    # rows are told apart by their content where a merged batch has no ids
    own_id = id_col if id_col in batch.columns else "__row"
    history, batch = unify_types([history.select(*[F.col(f"`{c}`") for c in names], *([F.col(f"`{id_col}`")] if own_id == id_col else [])),
                                  batch.select(*[F.col(f"`{c}`") for c in names if c in batch.columns], *([F.col(f"`{id_col}`")] if own_id == id_col else []))])
    if own_id != id_col:
        history, batch = (df.withColumn(own_id, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) for df in (history, batch))
    if axis and history.schema[axis].dataType.typeName() == "string":
        from verdin.functions.timefuncs import parse_timestamp
        history, batch = (df.withColumn(axis, parse_timestamp(F.col(f"`{axis}`"))) for df in (history, batch))
    found = retrain(history, batch, model, target, own_id, axis, o, **forest_kw)
    model_id = model_id or _new_id("m")
    stored = store_dataset(reg, found.rows, project_id, target, unit=top["unit"])
    path = bundle_path(reg, project_id, model_id)
    tabular.save_model_bundle(reg.spark, found.candidate, path)
    reg.register_model(project_id, model_id, stored, found.candidate.task_type, top["metric_name"], found.summary["candidate_value"],
                       found.candidate.record() | {"id_col": own_id, "retraining": found.summary}, "candidate", bundle_path=path)
    if found.summary["activated"]:
        reg.activate(project_id, model_id)
    return {"model_id": model_id, "dataset_id": stored, "activated": found.summary["activated"], "summary": found.summary, "inspection": report}
