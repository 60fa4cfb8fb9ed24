"""Candidate search (M3, M4, M6, V10): out-of-fold predictions, a convex blend, a time budget.

Every candidate is a whole pipeline (imputation, encoding, scaling, estimator) that is fitted again on
the training rows of each fold, so nothing of a held-out row reaches its own prediction.  The
out-of-fold table has one row per training row: its fold, its label and one prediction vector for each
candidate (the value, or the class probabilities).  The candidates' error vectors meet in one grouped
aggregate, their Gram matrix; the convex weights that minimise the blend's squared error follow from that small matrix
exactly, by the best of its faces.  The model that is returned is the blend of the refitted candidates.

A candidate runs under a job tag in a thread of its own.  When its share of the time budget is
over, the jobs of its tag are cancelled until the thread has ended, and the board says so.
"""

from __future__ import annotations

import itertools
import json
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import InheritableThread
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import ml
from verdin.operators.metrics import classification_metrics, lower_is_better, primary_metric_name, regression_metrics
from verdin.operators.profile import validate_training_frame
from verdin.operators.series import sequenced
from verdin.options import TrainingOptions

SEARCH_TREES = 100      # trees of the forest among the candidates
NETWORK_STEPS = 100     # steps of a network's optimiser
NETWORK_BINS = 16       # quantile bins of a numeric target that the network learns to tell apart
MAX_BLEND = 12          # candidates whose faces are enumerated (2**12 small systems)

#: The three boosting codes: the same algorithm over Spark trees, told apart by depth, step and row sampling.
BOOSTING = {
    "lgb": {"maxDepth": 5, "maxIter": 30, "stepSize": 0.15, "subsamplingRate": 0.8},
    "cb": {"maxDepth": 4, "maxIter": 40, "stepSize": 0.1, "subsamplingRate": 1.0},
    "xgb": {"maxDepth": 6, "maxIter": 20, "stepSize": 0.3, "subsamplingRate": 1.0},
}


class OverBudget(Exception):
    """A candidate used up its share of the time."""


def within(spark: SparkSession, seconds: float, tag: str, work: Callable):
    """``work()`` in a thread whose jobs carry ``tag``; after ``seconds`` they are cancelled and OverBudget is raised."""
    sc, box = spark.sparkContext, {}

    def run():
        sc.addJobTag(tag)
        try:
            box["result"] = work()
        except BaseException as exc:  # noqa: BLE001 — handed to the caller
            box["error"] = exc

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(max(seconds, 0.0))
    if thread.is_alive():
        while thread.is_alive():     # work between two jobs may start another one
            sc.cancelJobsWithTag(tag)
            thread.join(0.1)
        if "result" not in box:
            raise OverBudget(f"stopped after {seconds:.0f} s")
    if "error" in box:
        raise box["error"]
    return box["result"]


# --- candidates

def _width(df: DataFrame) -> int:
    row = df.select(F.size(vector_to_array("features")).alias("n")).first()
    return row["n"] if row else 0


def fit_candidate(code: str, task: str, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  n_classes: int, seed: int = ml.SEED) -> PipelineModel:
    """The whole pipeline of one candidate code, for any task: boosting of several classes is one against the rest; the
    network of a numeric target tells its quantile bins apart and reads the value off their probabilities linearly."""
    features = Pipeline(stages=ml.feature_stages(numeric, categorical, ml.column_modes(train, categorical))[0]).fit(train)
    data = features.transform(train)
    common = {"labelCol": "label", "featuresCol": "features"}
    if code in BOOSTING:
        if task == "regression":
            fitted = [GBTRegressor(**common, seed=seed, **BOOSTING[code]).fit(data)]
        else:
            one = GBTClassifier(**common, seed=seed, **BOOSTING[code])
            fitted = [one.fit(data) if task == "binary" else OneVsRest(classifier=one, **common, parallelism=2).fit(data)]
    elif code == "rf":
        fitted = [ml.forest(task, num_trees=SEARCH_TREES, seed=seed).fit(data)]
    elif code == "linear_l2":
        kind = LinearRegression if task == "regression" else LogisticRegression
        fitted = [kind(**common, regParam=0.01, elasticNetParam=0.0).fit(data)]
    elif code == "nn":
        width = _width(data)
        hidden = max(4, min(width, 64))
        if task != "regression":
            fitted = [MultilayerPerceptronClassifier(**common, seed=seed, layers=[width, hidden, n_classes], maxIter=NETWORK_STEPS).fit(data)]
        else:
            cuts = sorted(set(data.approxQuantile("label", [k / NETWORK_BINS for k in range(1, NETWORK_BINS)], 0.001)))
            # bins without rows at the ends would be classes that nothing is in
            low = data.agg(F.min("label")).first()[0]
            cuts = [c for c in cuts if c > low]
            place = F.lit(0.0)
            for c in cuts:
                place = place + (F.col("label") >= c).cast("double")
            binned = data.withColumn("_bin", place)
            network = MultilayerPerceptronClassifier(labelCol="_bin", featuresCol="features", predictionCol="_nn_bin", probabilityCol="_nn_prob",
                                                     rawPredictionCol="_nn_raw", seed=seed, layers=[width, hidden, max(2, len(cuts) + 1)], maxIter=NETWORK_STEPS).fit(binned)
            readout = LinearRegression(labelCol="label", featuresCol="_nn_prob", regParam=1e-6, elasticNetParam=0.0).fit(network.transform(binned))
            fitted = [network, readout]
    else:
        raise ValueError(f"unknown algorithm code {code!r}")
    return PipelineModel([*features.stages, *fitted])


def parts(model: PipelineModel, task: str, n_classes: int) -> Column:
    """The prediction vector in a transformed frame: the value, or a probability for each class."""
    if task == "regression":
        return F.array(F.col("prediction"))
    last = model.stages[-1]
    if isinstance(last, OneVsRestModel):     # margins of the classes, each against the rest
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
        found = F.transform(odds, lambda x: x / total)
    else:
        found = vector_to_array("probability")
    # classes above the highest one met in a fold have no place in the vector
    return F.array(*[F.coalesce(F.get(found, F.lit(k)), F.lit(0.0)) for k in range(n_classes)])


class Blend:
    """A weighted mean of fitted pipelines, with the interface of a pipeline model."""

    def __init__(self, members: dict[str, PipelineModel], weights: dict[str, float], task: str, n_classes: int):
        self.members, self.weights, self.task, self.n_classes = members, weights, task, n_classes

    def _mean(self, df: DataFrame) -> DataFrame:
        own, out, terms = df.columns, df, []
        for i, (code, model) in enumerate(self.members.items()):
            name = f"__member{i}"
            out = model.transform(out).withColumn(name, parts(model, self.task, self.n_classes)).select(*[F.col(f"`{c}`") for c in own], *terms, name)
            terms.append(name)
        width = 1 if self.task == "regression" else self.n_classes
        mean = F.array(*[sum((F.col(t)[k] * float(self.weights[c]) for t, c in zip(terms, self.members, strict=True)), F.lit(0.0)) for k in range(width)])
        return out.withColumn("__mean", mean).drop(*terms)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._mean(df)
        if self.task == "regression":
            return out.withColumn("prediction", F.col("__mean")[0]).drop("__mean")
        best = F.array_position("__mean", F.array_max("__mean")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("__mean")).drop("__mean")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, model in enumerate(self.members.values()):
            model.write().overwrite().save(f"{path}/member-{i}")
        told = {"codes": list(self.members), "weights": self.weights, "task": self.task, "n_classes": self.n_classes}
        spark.createDataFrame([(json.dumps(told),)], "blend string").write.mode("overwrite").json(f"{path}/blend")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Blend:
        told = json.loads(spark.read.json(f"{path}/blend").first()["blend"])
        members = {c: PipelineModel.load(f"{path}/member-{i}") for i, c in enumerate(told["codes"])}
        return cls(members, told["weights"], told["task"], told["n_classes"])


# --- folds, out-of-fold table, weights

def fold_column(rows: DataFrame, id_col: str, folds: int, seed: int = ml.SEED, stratify: str | None = None) -> DataFrame:
    """``fold``: by turns along the order of md5(id||seed), inside each class where ``stratify`` names one."""
    keyed = rows.withColumn("_k", F.md5(F.concat(F.col(f"`{id_col}`").cast("string"), F.lit(f"fold{seed}"))))
    keyed = keyed.withColumn("_h", F.conv(F.substring("_k", 1, 12), 16, 10).cast("long"))
    return sequenced(keyed, [stratify] if stratify else [], ["_h", "_k"]).withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_k", "_h", "_pos", "_n")


def out_of_fold(rows: DataFrame, keep: Sequence[str], models: dict[str, list], predict: dict[str, Callable]) -> DataFrame:
    """``keep`` columns, fold, and for each candidate ``p_<code>``: the prediction vector by the model of the row's own fold.
    ``models[code][f]`` was fitted without fold f; ``predict[code](model, frame)`` adds a column ``p``."""
    out = None
    for f in range(len(next(iter(models.values())))):
        part = rows.where(F.col("fold") == f)
        own, terms = part.columns, []
        for code, fitted in models.items():
            part = predict[code](fitted[f], part).withColumnRenamed("p", f"p_{code}").select(*[F.col(f"`{c}`") for c in own], *terms, f"`p_{code}`")
            terms.append(f"`p_{code}`")
        part = part.select(*[F.col(f"`{c}`") for c in keep], "fold", *terms)
        out = part if out is None else out.unionByName(part)
    return out


def long_form(oof: DataFrame, keep: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """The out-of-fold table keyed by row, fold and candidate."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(f"`p_{c}`").alias("p")) for c in codes]))
    return oof.select(*[F.col(f"`{c}`") for c in keep], "fold", each.alias("_e")).select(*[F.col(f"`{c}`") for c in keep], "fold", "_e.candidate", "_e.p")


def gram(oof: DataFrame, codes: Sequence[str], task: str, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Mean products of the candidates' error vectors, ``g_i_j`` for i <= j, in one aggregate (per ``keys``)."""
    if task == "regression":
        errors = {c: F.array(F.col(f"`p_{c}`")[0] - F.col(label)) for c in codes}
    else:
        errors = {c: F.transform(F.col(f"`p_{c}`"), lambda p, k: p - (k.cast("double") == F.col(label)).cast("double")) for c in codes}
    out = oof.select(*keys, *[e.alias(f"_e{i}") for i, e in enumerate(errors.values())])
    dot = lambda i, j: F.aggregate(F.zip_with(f"_e{i}", f"_e{j}", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = [(i, j) for i in range(len(errors)) for j in range(i, len(errors))]
    return out.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(dot(i, j)).alias(f"g_{i}_{j}") for i, j in pairs])


def gram_matrix(row, n: int) -> np.ndarray:
    return np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])


def convex_weights(matrix: np.ndarray) -> np.ndarray:
    """The weights (none negative, sum one) that minimise w' G w: on each face of the simplex the minimum is one linear
    system; the best of those that lie inside their face is the minimum of all.  Of equal ones the smallest face, first in order."""
    n = len(matrix)
    if n > MAX_BLEND:
        raise ValueError(f"at most {MAX_BLEND} candidates can be blended")
    best, value = None, np.inf
    scale = max(float(np.abs(matrix).max()), 1e-300)
    for size in range(1, n + 1):
        for face in itertools.combinations(range(n), size):
            g = matrix[np.ix_(face, face)] / scale
            system = np.block([[2 * g, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(system, np.append(np.zeros(size), 1.0), rcond=None)[0][:size]
            if w.min() < -1e-12 or abs(w.sum() - 1) > 1e-9:
                continue
            found = float(w @ g @ w)
            if found < value - 1e-12 * max(1.0, abs(value) if np.isfinite(value) else 1.0):
                best, value = np.zeros(n), found
                best[list(face)] = np.clip(w, 0.0, None)
    return best / best.sum()


# --- the search

@dataclass
class SearchResult:
    model: ml.TabularModel
    holdout: DataFrame
    board: DataFrame
    weights: dict[str, float]
    oof: DataFrame
    folds: int


def _prepared(df: DataFrame, target: str, id_col: str, task: str | None, test_size: float, seed: int):
    validate_training_frame(df.drop(id_col), target)
    task = ml.check_task(df, target, task) if task else ml.infer_task(df, target)
    prepared, proj, features, numeric, categorical = ml.prepare(df, target, id_col)
    classes = ml.class_labels(prepared, target) if task != "regression" else None
    split = ml.label_column(ml.seeded_split(prepared, id_col, test_size, seed, stratify=target if task != "regression" else None), target, task, classes)
    if classes:
        split = split.withColumn("label", F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": classes}}))
    return task, ml.balanced_checkpoint(split.where(F.col("label").isNotNull()), id_col), proj, features, numeric, categorical, classes


def _metric(scored: DataFrame, task: str, p: str) -> float:
    """The primary metric of prediction vectors."""
    if task == "regression":
        return regression_metrics(scored.withColumn("_v", F.col(f"`{p}`")[0]), "label", "_v").first()["rmse"]
    found = scored.withColumn("_v", (F.array_position(F.col(f"`{p}`"), F.array_max(F.col(f"`{p}`"))) - 1).cast("int")).withColumn("_a", F.col("label").cast("int"))
    return classification_metrics(found, "_a", "_v").first()["f1_weighted"]


def search(df: DataFrame, target: str, id_col: str, options: TrainingOptions | None = None, seed: int = ml.SEED,
           fit: Callable = fit_candidate, importance: bool = False) -> SearchResult:
    """Fit the candidates of ``options.algos`` inside folds, blend them and score the blend on the holdout.
    Candidates over their share of ``timeout_seconds`` or that fail are on the board with the reason; ValueError if none is
    left.  The preset ``utilized`` fits every code twice, with two seeds.  ``options.cv_folds`` 0: chosen by M4."""
    o = options or TrainingOptions.from_payload()
    spark = df.sparkSession
    began = time.monotonic()
    task, split, proj, features, numeric, categorical, classes = _prepared(df, target, id_col, None if o.task_type == "auto" else o.task_type, o.test_size, seed)
    k = len(classes or [])
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    folds = o.cv_folds or ml.cv_folds(train, target, task)
    train = ml.balanced_checkpoint(fold_column(train, id_col, folds, seed, target if task != "regression" else None), id_col)
    seeds = [seed, seed + 1] if o.preset == "utilized" else [seed]
    names = [(c if s == seed else f"{c}@{s}", c, s) for s in seeds for c in o.algos]
    left_out, fold_models, whole, status, seconds = [], {}, {}, {}, {}
    for at, (name, code, s) in enumerate(names):
        share = (o.timeout_seconds - (time.monotonic() - began)) / (len(names) - at)

        def work(code=code, s=s):
            inner = [fit(code, task, train.where(F.col("fold") != f), numeric, categorical, k, s) for f in range(folds)]
            return inner, fit(code, task, train, numeric, categorical, k, s)

        start = time.monotonic()
        try:
            fold_models[name], whole[name] = within(spark, share, f"verdin-search-{id(df)}-{at}-{threading.get_ident()}", work)
            status[name] = "fitted"
        except OverBudget as exc:
            status[name] = str(exc)
        except Exception as exc:  # noqa: BLE001 — the board names the reason
            status[name] = f"failed: {type(exc).__name__}: {str(exc).splitlines()[0][:200] if str(exc) else ''}"
        seconds[name] = time.monotonic() - start
        if status[name] != "fitted":
            left_out.append(name)
    codes = list(fold_models)
    if not codes:
        raise ValueError("no candidate could be fitted: " + "; ".join(f"{n} {status[n]}" for n in left_out))

    def predict(model, frame):
        return model.transform(frame).withColumn("p", parts(model, task, k))

    oof = out_of_fold(train, [id_col, "label"], fold_models, dict.fromkeys(codes, predict)).checkpoint(eager=True)
    weights = dict(zip(codes, convex_weights(gram_matrix(gram(oof, codes, task).first(), len(codes))).tolist(), strict=True))
    chosen = {c: whole[c] for c in codes if weights[c] > 0}
    blend = Blend(chosen, {c: weights[c] for c in chosen}, task, k)
    model = ml.TabularModel(blend, task, target, features, numeric, categorical, classes, proj, backend="search")
    model.composition = {c: round(weights[c], 6) for c in chosen}
    holdout = ml.score(model, test, keep=[id_col, target])
    model.metrics = ml.evaluate(holdout, task, len(features) + 1)
    if importance:
        model.importances = ml.permutation_importance(model, test, id_col)
    metric = primary_metric_name(task)
    rows = []
    for name, code, _ in names:
        if name in whole:
            cv = _metric(oof, task, f"p_{name}")
            own = _metric(whole[name].transform(test).withColumn("p", parts(whole[name], task, k)), task, "p")
            rows.append((name, code, cv, own, round(weights[name], 6), status[name], round(seconds[name], 3)))
        else:
            rows.append((name, code, None, None, 0.0, status[name], round(seconds[name], 3)))
    rows.append(("blend", None, _metric(_blended(oof, weights, task, k), task, "p"), model.metrics[metric], 1.0, "blended", round(time.monotonic() - began, 3)))
    board = spark.createDataFrame(rows, "candidate string, algo string, cv_metric double, holdout_metric double, blend_weight double, status string, seconds double")
    order = F.col("cv_metric").asc_nulls_last() if lower_is_better(metric) else F.col("cv_metric").desc_nulls_last()
    from pyspark.sql import Window
    board = board.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col("candidate")))) \
        .withColumn("metric", F.lit(metric)).withColumn("folds", F.lit(folds))     # one row per candidate
    return SearchResult(model, ml.holdout_table(holdout, model, id_col), board, weights, oof, folds)


def _blended(oof: DataFrame, weights: dict[str, float], task: str, n_classes: int) -> DataFrame:
    width = 1 if task == "regression" else n_classes
    return oof.withColumn("p", F.array(*[sum((F.col(f"`p_{c}`")[i] * float(w) for c, w in weights.items()), F.lit(0.0)) for i in range(width)]))


def train(df: DataFrame, target: str, id_col: str, options: TrainingOptions | dict | None = None, importance: bool = True,
          fit: Callable = fit_candidate, **forest_kw) -> tuple[ml.TabularModel, DataFrame, dict]:
    """M6: the backend that the options ask for.  ``forest``: the forest alone; ``search``: the blend, ValueError if it fails;
    ``auto``: the blend, else the forest with the reason among the warnings.  Returns the model, its holdout table and what
    was requested, what took effect and the board (None for the forest)."""
    o = options if isinstance(options, TrainingOptions) else TrainingOptions.from_payload(options)
    warnings, found = [], None
    if o.backend != "forest":
        try:
            found = search(df, target, id_col, o, fit=fit, importance=importance)
        except Exception as exc:
            if o.backend == "search":
                raise ValueError(f"the candidate search failed: {exc}") from exc
            warnings.append(f"the candidate search failed and the forest was used: {exc}")
    if found is not None:
        model, holdout = found.model, found.holdout
        effective = {"backend": "search", "preset": o.preset, "algos": [c for c, w in found.weights.items() if w > 0], "weights": model.composition,
                     "cv_folds": found.folds, "timeout_seconds": o.timeout_seconds}
    else:
        ignored = [n for n in ("preset", "algos", "timeout_seconds", "cv_folds") if getattr(o, n) != getattr(TrainingOptions.from_payload(), n)]
        warnings += [f"{n} has no effect on the forest" for n in ignored]
        model, holdout = ml.fit_tabular(df, target, id_col, None if o.task_type == "auto" else o.task_type, o.test_size, importance=importance, **forest_kw)
        effective = {"backend": "forest", "preset": None, "algos": ["rf"], "cv_folds": None, "trees": forest_kw.get("num_trees", ml.FOREST_TREES),
                     "max_depth": forest_kw.get("max_depth", 5)}
    model.warnings = warnings
    effective |= {"task_type": model.task_type, "test_size": o.test_size}
    return model, holdout, {"requested": o.to_dict(), "effective": effective, "board": found.board if found is not None else None}
