"""Tabular training and scoring on Spark ML.

Everything is a ``pyspark.ml`` Pipeline so fitting, scoring and persistence are
distributed and the bundle is saved with ``PipelineModel.write()`` (S6).

Differences from a single-machine forest that we accept on purpose: Spark's
``StandardScaler`` divides by the sample std (sklearn: population std — irrelevant
for trees); tree depth is bounded (``max_depth``, default 5 as in Spark ML) because Spark trees
cannot grow unbounded; forests are compared by invariants, never by predictions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.functions.timefuncs import TIME_ONLY_PATTERN, datetime_projection, parse_timestamp, time_to_minutes
from verdin.operators.metrics import classification_metrics, primary_metric_name, regression_metrics
from verdin.operators.profile import ValidationError, task_type_expr, type_family, validate_training_frame

SEED = 42
FOREST_TREES = 300          # fixed value: trees in the tabular forest


def _q(c: str):
    return F.col(f"`{c}`")


TRAINING_PARTITION_BYTES = 2 * 1024 * 1024


def balanced_checkpoint(df: DataFrame, *keys: str) -> DataFrame:
    """Materialize a training table spread by data volume: a hash repartition whose
    partition count AQE derives from a small advisory size (~2 MiB), so a large table
    is fitted by every core while a tiny one stays in one partition (no per-task
    overhead in iterative fits).  Without this, AQE coalesces small shuffles into one
    partition and a forest trains on a single core.  Reliable checkpoint (shared dir)."""
    spark = df.sparkSession
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(TRAINING_PARTITION_BYTES))
    try:
        spread = df.repartition(*[_q(k) for k in keys]) if keys else df.repartition(
            int(spark.conf.get("spark.sql.shuffle.partitions")))
        return spread.checkpoint(eager=True)
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread over the session's parallelism (fixed count; used before row expansion)."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[_q(k) for k in keys]) if keys else df.repartition(n)


# ---------------------------------------------------------------------------
# Temporal projection learned on the training data


class TemporalProjector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Projects datetime columns to ``__ts/__hour/__dayofweek/__month`` and time-of-day
    columns to ``__minutes``; source columns are dropped, absent ones skipped."""

    datetimeCols = Param(Params._dummy(), "datetimeCols", "datetime columns", TypeConverters.toListString)
    timeCols = Param(Params._dummy(), "timeCols", "time-of-day columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, datetimeCols=None, timeCols=None):
        super().__init__()
        self._setDefault(datetimeCols=[], timeCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.getOrDefault(self.datetimeCols):
            if c not in out.columns:
                continue
            dtype = out.schema[c].dataType
            ts = _q(c).cast("timestamp_ntz") if type_family(dtype) == "datetime" else parse_timestamp(_q(c))
            out = out.select("*", *datetime_projection(ts, c)).drop(c)
        for c in self.getOrDefault(self.timeCols):
            if c not in out.columns:
                continue
            out = out.withColumn(f"{c}__minutes", F.coalesce(time_to_minutes(_q(c)), F.lit(0.0))).drop(c)
        return out


def infer_temporal_roles(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """V12/V13 over whole columns in one aggregate: time-of-day first (≥80 % match), then
    datetime (typed, or ≥80 % of non-null text parses)."""
    dt, tm, texts = [], [], []
    for f in features:
        fam = type_family(df.schema[f].dataType)
        if fam == "datetime":
            dt.append(f)
        elif fam == "string":
            texts.append(f)
    if texts:
        aggs = []
        for i, c in enumerate(texts):
            t = F.trim(_q(c).cast("string"))
            aggs += [F.count(_q(c)).alias(f"n{i}"), F.count_if(t.rlike(TIME_ONLY_PATTERN)).alias(f"t{i}"),
                     F.count_if(parse_timestamp(_q(c)).isNotNull()).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(texts):
            n = row[f"n{i}"]
            if n and row[f"t{i}"] / n >= 0.8:
                tm.append(c)
            elif n and row[f"d{i}"] / n >= 0.8:
                dt.append(c)
    return dt, tm


# ---------------------------------------------------------------------------
# M4 / M5 / V5 / V6


def infer_task(df: DataFrame, target: str) -> str:
    numeric = type_family(df.schema[target].dataType) == "numeric"
    row = df.agg(task_type_expr(F.count_distinct(_q(target)), F.count(_q(target)), F.lit(numeric)).alias("t")).first()
    return row["t"]


def check_task(df: DataFrame, target: str, requested: str) -> str:
    """V6: binary needs exactly 2 classes, multiclass ≥3, regression a numeric target."""
    d = df.agg(F.count_distinct(_q(target)).alias("d")).first()["d"]
    if requested == "binary" and d != 2:
        raise ValidationError("binary task needs exactly two target values")
    if requested == "multiclass" and d < 3:
        raise ValidationError("multiclass task needs at least three target values")
    if requested == "regression" and type_family(df.schema[target].dataType) != "numeric":
        raise ValidationError("regression needs a numeric target")
    return requested


def cv_folds(df: DataFrame, target: str, task: str) -> int:
    """M4: regression min(5, n); classification min(5, smallest class); at least 2."""
    if task == "regression":
        n = df.count()
        return max(2, min(5, n))
    smallest = df.groupBy(_q(target)).count().agg(F.min("count").alias("m")).first()["m"]
    return max(2, min(5, smallest))


def seeded_split(df: DataFrame, id_col: str, test_size: float, seed: int = SEED,
                 stratify: str | None = None) -> DataFrame:
    """M5: ``split`` column; per stratum the first ceil(test_size·n) rows by md5(id||seed) are test."""
    from verdin.operators.series import sequenced
    key = F.md5(F.concat(_q(id_col).cast("string"), F.lit(str(seed))))
    keyed = df.withColumn("_k", key).withColumn("_h", F.conv(F.substring("_k", 1, 12), 16, 10).cast("long"))
    keys = [stratify] if stratify else []
    seq = sequenced(keyed, keys, ["_h", "_k"])
    test = F.col("_pos") <= F.ceil(F.col("_n") * F.lit(test_size))
    return seq.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_k", "_h", "_pos", "_n")


# ---------------------------------------------------------------------------
# M1 / M2: feature pipeline and forest


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per categorical column (smallest on ties), one small job per
    column over grouped counts; only the winning values reach the driver."""
    from verdin.operators.explain import column_mode
    out = {}
    for c in cols:
        row = column_mode(df, c).first()
        out[c] = None if row is None or row[0] is None else str(row[0])
    return out


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], modes: dict[str, str]) -> tuple[list, str]:
    """Median impute + standardize numeric; mode impute + one-hot (unknown → all zeros)."""
    stages, parts = [], []
    if numeric:
        imp = [f"{c}__imp" for c in numeric]
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=imp),
                   VectorAssembler(inputCols=imp, outputCol="_num_vec", handleInvalid="keep"),
                   StandardScaler(inputCol="_num_vec", outputCol="_num_scaled", withMean=True, withStd=True)]
        parts.append("_num_scaled")
    if categorical:
        fills = ", ".join(
            f"coalesce(CAST(`{c}` AS STRING), {json.dumps(modes.get(c)) if modes.get(c) is not None else 'NULL'})"
            f" AS `{c}__fill`" for c in categorical)
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
        idx = [f"{c}__idx" for c in categorical]
        ohe = [f"{c}__ohe" for c in categorical]
        stages += [StringIndexer(inputCols=[f"{c}__fill" for c in categorical], outputCols=idx, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep")]
        parts += ohe
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages, "features"


NODE_PASSES = 16            # passes over the rows that :func:`node_memory` spreads a forest's nodes over


def node_memory(num_trees: int, max_depth: int, numeric: int, width: int) -> int:
    """MB of node statistics that one pass of a regression forest gathers: a sixteenth of those of all its nodes (32 bins a numeric feature, 2 a one-hot
    one, three sums a bin), so that a task updates a few MB that its core's cache holds.  A limit on memory alone: the trees are the same."""
    bins = numeric * 32 + max(width - numeric, 0) * 2
    return max(1, min(2048, -(-num_trees * (2 ** max_depth - 1) * bins * 24 // (NODE_PASSES * 2 ** 20))))


def forest(task: str, num_trees: int = FOREST_TREES, seed: int = SEED, max_depth: int = 5, memory_mb: int = 2048):
    """The forest of M1.  Node ids are not cached (Spark's default): that cache holds a number a row and tree and is renewed at each level, and finding a
    row's node from its bins gives the same trees.  ``memory_mb`` leaves the trees of a regression alone; a classifier, whose nodes draw their features in
    the order of the passes, keeps one limit."""
    if task == "regression":
        return RandomForestRegressor(labelCol="label", featuresCol="features", numTrees=num_trees, seed=seed,
                                     maxDepth=max_depth, featureSubsetStrategy="all", maxMemoryInMB=memory_mb)
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees, seed=seed,
                                  maxDepth=max_depth, featureSubsetStrategy="sqrt", maxMemoryInMB=2048)


@dataclass
class TabularModel:
    """The fitted bundle and its training record."""
    pipeline: PipelineModel
    task_type: str
    target: str
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    classes: list[str] | None
    projector: TemporalProjector
    metrics: dict = field(default_factory=dict)
    importances: dict = field(default_factory=dict)
    backend: str = "spark-random-forest"
    warnings: list[str] = field(default_factory=list)
    composition: dict = field(default_factory=dict)     # members of a blend and their weights

    def record(self) -> dict:
        return {"task_type": self.task_type, "target": self.target, "features": self.features,
                "numeric": self.numeric, "categorical": self.categorical, "classes": self.classes,
                "metrics": self.metrics, "importances": self.importances, "backend": self.backend,
                "primary_metric": primary_metric_name(self.task_type), "warnings": self.warnings,
                "composition": self.composition}


def prepare(df: DataFrame, target: str, id_col: str | None) -> tuple[DataFrame, TemporalProjector, list, list, list]:
    feats = [c for c in df.columns if c not in (target, id_col)]
    dt, tm = infer_temporal_roles(df, feats)
    proj = TemporalProjector(datetimeCols=dt, timeCols=tm)
    prepared = proj.transform(df)
    features = [c for c in prepared.columns if c not in (target, id_col)]
    numeric = [c for c in features if type_family(prepared.schema[c].dataType) in ("numeric", "boolean")]
    categorical = [c for c in features if c not in numeric]
    prepared = prepared.select(*[_q(c) if c not in numeric else _q(c).cast("double").alias(c)
                                 for c in prepared.columns])
    return prepared, proj, features, numeric, categorical


def label_column(df: DataFrame, target: str, task: str, classes: list[str] | None) -> DataFrame:
    if task == "regression":
        return df.withColumn("label", _q(target).cast("double"))
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), _q(target).cast("string")) - 1
    return df.withColumn("label", idx.cast("double"))


def class_labels(df: DataFrame, target: str) -> list[str]:
    """A10: distinct labels sorted as text (index = position).  One small distinct job;
    the class list is bounded by the task (classification)."""
    rows = df.select(_q(target).cast("string").alias("c")).filter(F.col("c").isNotNull()).distinct() \
        .orderBy("c").collect()
    return [r["c"] for r in rows]


def fit_tabular(df: DataFrame, target: str, id_col: str, task: str | None = None, test_size: float = 0.2,
                num_trees: int = FOREST_TREES, seed: int = SEED, max_depth: int = 5,
                importance: bool = True) -> tuple[TabularModel, DataFrame]:
    """M2 path: validate (V1), infer task (V5), project time columns (X4), seeded split (M5),
    fit the feature pipeline + forest, score the holdout (M7/M8), metrics (M10/M11) and
    permutation importance (M13).  Returns the model and the holdout table (M9)."""
    validate_training_frame(df.drop(id_col), target)
    task = check_task(df, target, task) if task else infer_task(df, target)
    prepared, proj, features, numeric, categorical = prepare(df, target, id_col)
    classes = class_labels(prepared, target) if task != "regression" else None
    split = seeded_split(prepared, id_col, test_size, seed, stratify=target if task != "regression" else None)
    # iterative fits re-read the split many times: cut lineage once (shared checkpoint dir)
    split = balanced_checkpoint(label_column(split, target, task, classes), id_col)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    modes = column_modes(train, categorical)
    stages, _ = feature_stages(numeric, categorical, modes)
    encoder = Pipeline(stages=stages).fit(train)
    encoded = encoder.transform(train)
    width = encoded.schema["features"].metadata["ml_attr"]["num_attrs"]
    fitted = forest(task, num_trees, seed, max_depth, node_memory(num_trees, max_depth, len(numeric), width)).fit(encoded)
    model = PipelineModel(encoder.stages + [fitted])
    tm = TabularModel(model, task, target, features, numeric, categorical, classes, proj)
    holdout = score(tm, test, keep=[id_col, target])
    tm.metrics = evaluate(holdout, task, len(features) + 1)
    if importance:
        tm.importances = permutation_importance(tm, test, id_col)
    return tm, holdout_table(holdout, tm, id_col)


def score(model: TabularModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M7 + M8: transform → prediction; classification decodes the label (binary: P(class 1)
    ≥ 0.5; multiclass: arg-max) and confidence = max class probability."""
    out = model.pipeline.transform(df)
    if model.task_type == "regression":
        return out.withColumn("prediction_value", F.col("prediction"))
    prob = vector_to_array("probability")
    if model.task_type == "binary":
        idx = (prob[1] >= 0.5).cast("int")
        conf = F.greatest(prob[1], 1 - prob[1])
    else:
        idx = F.array_position(prob, F.array_max(prob)).cast("int") - 1
        conf = F.array_max(prob)
    labels = F.array(*[F.lit(c) for c in model.classes])
    return (out.withColumn("_pidx", idx).withColumn("prediction_value", F.element_at(labels, idx + 1))
            .withColumn("confidence", conf).withColumn("p_positive", prob[1] if model.task_type == "binary" else F.lit(None)))


def evaluate(scored: DataFrame, task: str, k: int) -> dict:
    """M10 (k = features + 1) or M11 on a scored holdout; one aggregate job."""
    if task == "regression":
        row = regression_metrics(scored, "label", "prediction_value", k=k).first().asDict()
        return {m: row[m] for m in ("r", "mse", "rmse", "mae", "r2", "aic", "bic", "aicc") if row[m] is not None}
    s = scored.withColumn("_a", F.col("label").cast("int"))
    row = classification_metrics(s, "_a", "_pidx").first().asDict()
    return {"accuracy": row["accuracy"], "f1_weighted": row["f1_weighted"]}


def holdout_table(scored: DataFrame, model: TabularModel, id_col: str) -> DataFrame:
    """M9: record struct of the inputs, actual, prediction, confidence and error / matched."""
    record = F.struct(*[_q(c) for c in model.features if c in scored.columns])
    base = scored.select(_q(id_col), record.alias("record"), _q(model.target).alias("actual"),
                         F.col("prediction_value").alias("prediction"),
                         (F.col("confidence") if "confidence" in scored.columns else F.lit(None).cast("double"))
                         .alias("confidence"))
    if model.task_type == "regression":
        return base.withColumn("error", F.bround(F.col("prediction") - F.col("actual").cast("double"), 6))
    return base.withColumn("matched", F.col("actual").cast("string") == F.col("prediction"))


# ---------------------------------------------------------------------------
# Permutation importance


def shuffled_copies(rows: DataFrame, features: Sequence[str], id_col: str, seed: int = SEED, bucket_rows: int = 100_000) -> DataFrame:
    """``rows`` once as they are (``_feature`` empty) and once for each feature with its values dealt anew.  Rows are dealt into
    buckets of about ``bucket_rows`` by md5(id || seed); within a bucket the i-th row by id takes the value of the
    i-th row by md5(id || feature || seed), so the permutation depends on the rows alone.  All features share one
    ranking and one join with their donors: both keyed by (bucket, feature)."""
    from pyspark.sql import Window
    ident = _q(id_col).cast("string")
    buckets = max(1, -(-rows.count() // bucket_rows))
    digest = F.conv(F.substring(F.md5(F.concat(ident, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    base = rows.withColumn("_b", F.pmod(digest, F.lit(buckets)))
    base = base.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(_q(id_col))))
    typed = {f: rows.schema[f].dataType for f in features}
    kinds = sorted({t.simpleString() for t in typed.values()})
    # a donor's value lies in the field of its type; the others are null
    values = [F.struct(F.lit(f).alias("_feature"), *[(_q(f) if typed[f].simpleString() == t else F.lit(None).cast(t)).alias(f"_v{k}") for k, t in enumerate(kinds)])
              for f in features]
    donors = base.select("_b", ident.alias("_id"), F.explode(F.array(*values)).alias("_d")).select("_b", "_id", "_d.*")
    order = Window.partitionBy("_b", "_feature").orderBy(F.md5(F.concat("_id", "_feature", F.lit(str(seed)))), "_id")
    donors = donors.withColumn("_i", F.row_number().over(order)).drop("_id")
    named = F.array(F.lit(""), *[F.lit(f) for f in features])
    copies = base.withColumn("_feature", F.explode(named)).join(donors, ["_b", "_feature", "_i"], "left")
    own = {f: f"_v{kinds.index(typed[f].simpleString())}" for f in features}
    return copies.select("_feature", *[F.when(F.col("_feature") == f, F.col(own[f])).otherwise(_q(f)).alias(f) if f in own else _q(f) for f in rows.columns])


def permutation_importance(model: TabularModel, test: DataFrame, id_col: str, seed: int = SEED,
                           bucket_rows: int = 100_000) -> dict[str, float]:
    """Each feature's share of the harm done by permuting it (:func:`shuffled_copies`).  All copies are scored in ONE
    transform.  Without any harm the shares are equal."""
    task = model.task_type
    metric = primary_metric_name(task)
    scored = score(model, shuffled_copies(test, model.features, id_col, seed, bucket_rows))
    if task == "regression":
        m = regression_metrics(scored, "label", "prediction_value", ["_feature"]).select("_feature", F.col(metric).alias("m"))
    else:
        s = scored.withColumn("_a", F.col("label").cast("int"))
        m = classification_metrics(s, "_a", "_pidx", ["_feature"]).select("_feature", F.col(metric).alias("m"))
    rows = {r["_feature"]: r["m"] for r in m.collect()}   # one row per feature, and the baseline under the empty name
    sign = 1.0 if metric == "rmse" else -1.0
    harm = {f: sign * (rows[f] - rows[""]) for f in model.features if f in rows}     # without rows: none
    positive = {f: h for f, h in harm.items() if h > 0}
    if not positive:
        return dict.fromkeys(model.features, 1.0 / max(len(model.features), 1))
    return {f: round(positive.get(f, 0.0) / sum(positive.values()), 6) for f in model.features}


def importance_table(spark, importances: dict[str, float], k: int = 12) -> DataFrame:
    """K6: the ``k`` largest importances (ties by name), a row a feature."""
    from verdin.operators.sampling import top_k
    return top_k(spark.createDataFrame([(f, float(v)) for f, v in importances.items()], "feature string, importance double"), "importance", k, "feature")


# ---------------------------------------------------------------------------
# J8


def compare_with_actual(model: TabularModel, df: DataFrame, id_col: str) -> tuple[DataFrame, dict]:
    """Score rows that carry the actual target in place (row id carried through the
    transform, no join) and evaluate with k = 1."""
    prepared = model.projector.transform(df)
    labelled = label_column(prepared, model.target, model.task_type, model.classes)
    scored = score(model, labelled)
    pairs = scored.select(_q(id_col), _q(model.target).alias("actual"), F.col("prediction_value").alias("prediction"),
                          (F.col("confidence") if "confidence" in scored.columns else F.lit(None).cast("double"))
                          .alias("confidence"))
    return pairs, evaluate(scored, model.task_type, 1)
