"""Model queries: tabular training and scoring, importance, candidate search,
recursive forecasting, forecast-driven decisions and Kernel SHAP (M1–M17, E1, D11).

These fit Spark ML forests, so they are checked by row counts and invariants
(tests/), not by a SQL oracle.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import decide, forecast, merge, ml, shap
from verdin.operators.sampling import downsample_points, head_sample
from verdin.plans.inputs import hourly_events
from verdin.plans.quality import CANDIDATE_RATE, CURRENT_RATE, priced_lines
from verdin.plans.registry import register
from verdin.sources.tables import table


def order_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with customer attributes; target o_totalprice, id o_orderkey."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "c_acctbal", "c_mktsegment", "c_nationkey",
        "o_totalprice")


def document_features(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with numeric features computed over the whole text."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    feats = d.select(
        "doc_id", "lang", "source",
        (F.col("n_chars") / 1000.0).alias("kchars"),
        (F.size(F.split(F.trim(text), r"\s+")) / 100.0).alias("hwords"),
        ((F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))) / n).alias("digit_share"),
        F.size(F.split(text, "\n")).cast("double").alias("lines"))
    return feats.join(lab, "doc_id")


@register("tabular_regression")
def tabular_regression(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + M2 + M5 + M7 + M9 + M10: forest on orders ⋈ customer, holdout table."""
    model, holdout = ml.fit_tabular(order_frame(spark, sf), "o_totalprice", "o_orderkey", importance=False)
    return holdout.select("o_orderkey", "actual", F.bround("prediction", 6).alias("prediction"), "error")


@register("tabular_classification")
def tabular_classification(spark: SparkSession, sf: str) -> DataFrame:
    """M2 classification on text-derived features: decoded labels (M8) and confidence."""
    df = document_features(spark, sf).drop("lang", "source")
    model, holdout = ml.fit_tabular(df, "quality", "doc_id", importance=False)
    return holdout.select("doc_id", "actual", "prediction", F.bround("confidence", 6).alias("confidence"), "matched")


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized permutation importance of the orders forest (one scoring job)."""
    model, _ = ml.fit_tabular(order_frame(spark, sf), "o_totalprice", "o_orderkey", importance=True)
    rows = sorted(model.importances.items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


_IMPORTANCE_FEATURES = ["price", "balance", "status"]


@register("linear_importance", """
WITH r AS (SELECT o_orderkey AS id, o_totalprice / 10000 AS price, c_acctbal / 500 AS balance FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, CAST('0x' || substr(md5(id::VARCHAR || '42'), 1, 8) AS BIGINT) % CAST(ceil(count(*) OVER () / 100000.0) AS BIGINT) AS b FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) AS i, row_number() OVER (PARTITION BY b ORDER BY md5(id::VARCHAR || 'price42')) AS ip,
             row_number() OVER (PARTITION BY b ORDER BY md5(id::VARCHAR || 'balance42')) AS ib FROM k),
h AS (SELECT sqrt(avg((d.price - p.price) ** 2)) AS price, (SELECT sqrt(avg(4 * (d.balance - p.balance) ** 2)) FROM p JOIN p d ON p.b = d.b AND p.i = d.ib) AS balance
      FROM p JOIN p d ON p.b = d.b AND p.i = d.ip)
SELECT f.feature AS feature, round(f.share, 4) AS importance
FROM (SELECT unnest([{'feature': 'price', 'share': price / (price + balance)}, {'feature': 'balance', 'share': balance / (price + balance)},
                     {'feature': 'status', 'share': 0.0}]) AS f FROM h)
""")
def linear_importance(spark: SparkSession, sf: str) -> DataFrame:
    """M13 + K6: importances of a model known to be price + 2 balance, which does not read the status: the harm of the stated permutation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", (F.col("o_totalprice") / 10000).alias("price"), (F.col("c_acctbal") / 500).alias("balance"),
                                                        F.col("o_orderstatus").alias("status"))
    rows = ml.balanced_checkpoint(rows.withColumn("label", F.col("price") + 2 * F.col("balance")), "o_orderkey")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["price", "balance"], outputCol="features"),
                            LinearRegression(labelCol="label", featuresCol="features", solver="normal", regParam=0.0)]).fit(rows)
    model = ml.TabularModel(pipe, "regression", "label", _IMPORTANCE_FEATURES, ["price", "balance"], ["status"], None, ml.TemporalProjector())
    found = ml.importance_table(spark, ml.permutation_importance(model, rows, "o_orderkey"))
    return found.select("feature", F.round("importance", 4).alias("importance"))


@register("automl_leaderboard")
def automl_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """M3 + M4: whole pipelines inside folds (forest, L2 logistic, boosted trees, network) on
    labelled documents: out-of-fold and holdout metric, rank and the weight of each in the blend."""
    from verdin.operators import search
    from verdin.options import TrainingOptions
    opts = TrainingOptions.from_payload({"algos": ["rf", "linear_l2", "xgb", "nn"], "timeout_seconds": 1800, "cv_folds": 2})
    return search.search(document_features(spark, sf), "quality", "doc_id", opts).board.drop("seconds")


@register("training_record")
def training_record(spark: SparkSession, sf: str) -> DataFrame:
    """M6 + M16 (L5 shape): the options' backend and candidates, the blend's training record as JSON."""
    from verdin.operators import search
    model, _, opts = search.train(document_features(spark, sf).drop("lang", "source"), "quality", "doc_id",
                                  {"algos": "linear_l2,lgb", "timeout_seconds": 1800, "cv_folds": 2}, importance=False)
    rec = model.record()
    rec["options"] = {"requested": opts["requested"], "effective": opts["effective"]}
    return spark.createDataFrame([(rec["task_type"], rec["primary_metric"], json.dumps(rec, default=str))],
                                 "task_type string, primary_metric string, record string")


def _one_feature(train: DataFrame, feature: str):
    """The least-squares line of ``label`` on one column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    return Pipeline(stages=[VectorAssembler(inputCols=[feature], outputCol="features"),
                            LinearRegression(labelCol="label", featuresCol="features", solver="normal", regParam=0.0)]).fit(train)


_BLEND_FOLDS = 3


@register("blend_weights", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice / 10000 AS a, c_acctbal / 500 AS b,
                  row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || 'fold42')) % {_BLEND_FOLDS} AS fold
           FROM orders JOIN customer ON o_custkey = c_custkey),
y AS (SELECT *, a + b AS label FROM r),
m AS (SELECT f.fold, regr_slope(label, a) AS sa, regr_intercept(label, a) AS ia, regr_slope(label, b) AS sb, regr_intercept(label, b) AS ib
      FROM (SELECT DISTINCT fold FROM y) f JOIN y ON y.fold <> f.fold GROUP BY f.fold),
e AS (SELECT o_orderstatus, ia + sa * a - label AS ea, ib + sb * b - label AS eb FROM y JOIN m USING (fold)),
g AS (SELECT o_orderstatus, count(*) AS n, avg(ea * ea) AS aa, avg(ea * eb) AS ab, avg(eb * eb) AS bb FROM e GROUP BY o_orderstatus)
SELECT o_orderstatus, n, round(sqrt(aa), 4) AS rmse_price, round(sqrt(bb), 4) AS rmse_balance,
       round(greatest(0, least(1, (bb - ab) / (aa - 2 * ab + bb))), 4) AS weight_price,
       round(1 - greatest(0, least(1, (bb - ab) / (aa - 2 * ab + bb))), 4) AS weight_balance
FROM g""")
def blend_weights(spark: SparkSession, sf: str) -> DataFrame:
    """M3: out-of-fold predictions of two candidates, their error Gram matrix per order status, convex weights."""
    from verdin.operators import search
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 10000).alias("price"),
                                                        (F.col("c_acctbal") / 500).alias("balance"))
    rows = ml.balanced_checkpoint(search.fold_column(rows.withColumn("label", F.col("price") + F.col("balance")), "o_orderkey", _BLEND_FOLDS), "o_orderkey")
    models = {f: [_one_feature(rows.where(F.col("fold") != k), f) for k in range(_BLEND_FOLDS)] for f in ("price", "balance")}
    predict = dict.fromkeys(models, lambda model, frame: model.transform(frame).withColumn("p", F.array("prediction")))
    oof = search.out_of_fold(rows, ["o_orderkey", "o_orderstatus", "label"], models, predict)
    found = search.gram(oof, list(models), "regression", ["o_orderstatus"]).collect()      # a row per status
    out = []
    for r in found:
        w = search.convex_weights(search.gram_matrix(r, 2))
        out.append((r["o_orderstatus"], r["n"], r["g_0_0"] ** 0.5, r["g_1_1"] ** 0.5, float(w[0]), float(w[1])))
    df = spark.createDataFrame(out, "o_orderstatus string, n long, rmse_price double, rmse_balance double, weight_price double, weight_balance double")
    return df.select("o_orderstatus", "n", *[F.round(x, 4).alias(x) for x in df.columns[2:]])


def _bundle(spark: SparkSession, sf: str) -> forecast.ForecastBundle:
    return forecast.train_forecaster(hourly_events(spark, sf), ["series_id"], "ts", "y")


@register("recursive_forecast")
def recursive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """M14 + M15 + M17: 400-tree global forest over all hourly series, 12 recursive steps
    at a 30-minute horizon (cadence 60 → warning)."""
    b = _bundle(spark, sf)
    return forecast.recursive_forecast(b, steps=12, horizon_minutes=30)


@register("forecast_decisions_model")
def forecast_decisions_model(spark: SparkSession, sf: str) -> DataFrame:
    """D11 end to end: recursive forecast (cadence horizon) → K3 sampling → A13 baseline on
    the recent history → D10 factors → D9 risk → D3 forecast_default rules."""
    b = _bundle(spark, sf)
    pts = forecast.recursive_forecast(b, steps=24)
    pts = downsample_points(pts.select("series_id", "step", "ts", "prediction"), ["series_id"], "step", 12)
    hist = forecast.recent_history(hourly_events(spark, sf), ["series_id"])
    base = decide.forecast_baseline(hist, ["series_id"], "ts", "y")
    d = decide.forecast_decisions(pts, base, ["series_id"], "forecast_default")
    return d.select("series_id", "step", "ts", "prediction", "risk_level", "rule_id", "scenario_id",
                    "strong_positive_count", "negative_count")


@register("kernel_shap")
def kernel_shap(spark: SparkSession, sf: str) -> DataFrame:
    """Exact Kernel SHAP (all 14 coalitions of 4 features, 20 background rows) of
    P(quality = 1) from a forest, for every labelled document."""
    feats = ["kchars", "hwords", "digit_share", "lines"]
    df = document_features(spark, sf).select("doc_id", *feats, "quality")
    model, _ = ml.fit_tabular(df, "quality", "doc_id", importance=False, num_trees=100)
    background = head_sample(df, ["doc_id"], shap.MAX_BACKGROUND)

    def score(frame: DataFrame) -> DataFrame:
        s = ml.score(model, frame)
        return s.withColumn("score", F.col("p_positive"))

    return shap.kernel_shap(df, background, feats, "doc_id", score)


@register("compare_actual")
def compare_actual(spark: SparkSession, sf: str) -> DataFrame:
    """A model trained on orders before 2000 scores the later orders in place
    (actual vs predicted per order) with k = 1 metrics attached."""
    df = order_frame(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    model, _ = ml.fit_tabular(df.filter(F.col("o_orderdate") < cut), "o_totalprice", "o_orderkey", importance=False)
    pairs, metrics = ml.compare_with_actual(model, df.filter(F.col("o_orderdate") >= cut), "o_orderkey")
    return pairs.select("*", *[F.lit(v).alias(k) for k, v in metrics.items()])


@register("retrain_decision")
def retrain_decision(spark: SparkSession, sf: str) -> DataFrame:
    """V4 + L6: champion trained on orders before 2000; the orders from 2000 on arrive as
    a new batch; candidate = last 90 days of history + new training rows; both are
    scored on the newest 20 % of the batch; gain vs a 3 % threshold decides activation."""
    from verdin.operators import retrain
    from verdin.options import RetrainingOptions
    df = order_frame(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    hist, batch = df.filter(F.col("o_orderdate") < cut), df.filter(F.col("o_orderdate") >= cut)
    current, _ = ml.fit_tabular(hist, "o_totalprice", "o_orderkey", importance=False)
    report = retrain.inspect_retraining(batch, current, "o_totalprice")
    opts = RetrainingOptions.from_payload({"history_scope": "last_90_days"})
    res = retrain.retrain(hist, batch, current, "o_totalprice", "o_orderkey", "o_orderdate", opts)
    return res.frame.withColumn("batch_ready", F.lit(bool(report["ready"])))


def _registry(spark: SparkSession):
    import uuid

    from verdin.operators import lifecycle
    from verdin.session import scratch_table_path
    return lifecycle.Registry(spark, scratch_table_path(spark, f"registry-{uuid.uuid4().hex[:12]}"))


_REGISTERED = f"""
WITH b AS (SELECT l_linestatus, l_returnflag, l_extendedprice / 1000.0 AS y, l_quantity * {CURRENT_RATE} AS p, l_quantity * {CANDIDATE_RATE} AS q FROM lineitem),
r AS (SELECT 'lines-' || l_linestatus || l_returnflag AS project_id, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS a, sqrt(avg((y - q) * (y - q))) AS c FROM b GROUP BY 1),
v AS (SELECT project_id, n, unnest([{{'v': 'm1', 'x': round(a, 6)}}, {{'v': 'm2', 'x': round(c, 6)}}, {{'v': 'm3', 'x': 0.0}}]) AS m, round(c, 6) < round(a, 6) AS better FROM r)
"""


def _line_record(new: DataFrame) -> F.Column:
    """A training record as JSON: target, features, metrics; all but candidates can forecast."""
    history = F.array(*[F.struct(F.lit(i).alias("step")) for i in range(3)])
    forecasting = F.when(F.col("mode") == "auto", F.struct(F.lit(True).alias("enabled"), F.lit(60).alias("base_frequency_minutes"), history.alias("recent_history")))
    return F.to_json(F.struct(F.lit("y").alias("target"), F.array(F.lit("l_quantity"), F.lit("l_discount")).alias("features"),
                              F.struct(F.col("metric_value").alias("rmse")).alias("metrics"), forecasting.alias("forecasting")))


def _register_lines(spark: SparkSession, sf: str, record=lambda new: F.lit("{}")):
    """A project per line status and return flag, its dataset and three versions scored by fixed rules, all registered in set-based steps."""
    from verdin.operators.metrics import regression_metrics
    reg = _registry(spark)
    lines = priced_lines(spark, sf).withColumn("project_id", F.concat(F.lit("lines-"), "l_linestatus", "l_returnflag"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    reg.register_datasets(lines.groupBy("project_id").agg(F.count("*").alias("rows")).select(
        "project_id", F.lit("v1").alias("version_id"), F.lit(None).cast("string").alias("name"), F.lit("y").alias("target"), "rows",
        F.lit(len(lines.columns)).alias("columns"), F.lit(lines.schema.json()).alias("schema_json"), F.lit("USD").alias("unit"), now.alias("created_at")))
    scored = [regression_metrics(lines, "y", p, ["project_id"]).select("project_id", F.lit(v).alias("version_id"), F.col("rmse").alias("metric_value"), F.lit("auto").alias("mode"))
              for v, p in (("m1", "p"), ("m2", "p_candidate"))]
    scored.append(scored[0].select("project_id", F.lit("m3").alias("version_id"), F.lit(0.0).alias("metric_value"), F.lit("candidate").alias("mode")))
    new = scored[0].unionByName(scored[1]).unionByName(scored[2])
    reg.register_models(new.select("project_id", "version_id", F.lit("v1").alias("dataset_version_id"), F.lit("regression").alias("task_type"), F.lit("rmse").alias("metric_name"),
                                   "metric_value", F.timestamp_add("MINUTE", F.substring("version_id", 2, 1).cast("int"), now).alias("created_at"), record(new).alias("record"),
                                   F.concat(F.lit(f"{reg.root}/bundles/project_id="), "project_id").alias("bundle_path"), "mode"))
    return reg


@register("model_registry", _REGISTERED + """
SELECT project_id, m.v AS version_id, CASE WHEN project_id = 'lines-FA' THEN CASE WHEN m.v = 'm3' THEN 'champion' WHEN m.v = 'm1' OR better THEN 'archived' ELSE 'candidate' END
         WHEN m.v = 'm3' THEN 'candidate' WHEN m.v = 'm1' THEN CASE WHEN better THEN 'archived' ELSE 'champion' END
         WHEN better THEN 'champion' ELSE 'candidate' END AS status, m.x AS metric_value, n AS dataset_rows FROM v""")
def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + L1 + L2 + L5: datasets and versions of all projects registered at once, one version activated, models joined to their datasets."""
    reg = _register_lines(spark, sf)
    reg.activate("lines-FA", "m3")
    return reg.models().join(reg.datasets().select("project_id", F.col("version_id").alias("dataset_version_id"), F.col("rows").alias("dataset_rows")),
                             ["project_id", "dataset_version_id"]).select("project_id", "version_id", "status", "metric_value", "dataset_rows")


@register("champion_datasets", _REGISTERED + """
SELECT project_id, m.v AS model_id, 'v1' AS dataset_id, 'regression' AS task_type, m.x AS metric_value, 'y' AS target, 'USD' AS unit, n AS dataset_rows
FROM v WHERE m.v = CASE WHEN better THEN 'm2' ELSE 'm1' END AND project_id <> 'lines-OR'""")
def champion_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """M17 + U3: each project's champion joined to its dataset, after one project was deleted from every table."""
    from verdin.operators import flows
    reg = _register_lines(spark, sf)
    flows.delete_project(reg, "lines-OR")
    return flows.champions(reg).select("project_id", "model_id", "dataset_id", "task_type", "metric_value", "target", "unit", "dataset_rows")


@register("registry_views", _REGISTERED + """
SELECT project_id, m.v AS version_id, CASE WHEN m.v = 'm2' THEN 'Second of ' || project_id END AS name, 'regression' AS task_type, 'y' AS target, 'rmse' AS primary_metric,
       m.v = 'm3' AS is_latest, m.x AS metric_value, 2 AS n_features, 'l_quantity|l_discount' AS features, m.v <> 'm3' AS can_forecast, CASE WHEN m.v <> 'm3' THEN 60 ELSE 0 END AS cadence,
       CASE WHEN m.v <> 'm3' THEN 3 ELSE 0 END AS history_rows, round(m.x, 6) AS rmse, 'v1' AS dataset_id, CASE WHEN project_id LIKE '%R' THEN NULL ELSE 'EUR' END AS unit, n AS dataset_rows FROM v""")
def registry_views(spark: SparkSession, sf: str) -> DataFrame:
    """L3 + L10 + L11 + L12: versions of all projects renamed and datasets given units in set-based steps (a blank unit clears it); the views of
    every version, whether it is its project's latest, and its project's latest dataset."""
    from verdin.operators import lifecycle
    reg = _register_lines(spark, sf, _line_record)
    second = reg.models().where("version_id = 'm2'").select("project_id", "version_id", F.concat(F.lit("  Second   of "), "project_id", F.lit(" ")).alias("value"))
    reg.rename_models(second)
    reg.set_units(reg.datasets().select("project_id", "version_id", F.when(F.col("project_id").endswith("R"), F.lit("  ")).otherwise(F.lit(" EUR")).alias("value")))
    models = reg.models()
    newest = lifecycle.latest(models).select("project_id", F.col("version_id").alias("newest"))
    data = lifecycle.latest(reg.datasets()).select("project_id", F.col("version_id").alias("dataset_id"), "unit", F.col("rows").alias("dataset_rows"))
    v = lifecycle.model_summary(models).join(newest, "project_id").join(data, "project_id")
    return v.select("project_id", "version_id", "name", "task_type", "target", "primary_metric", (F.col("version_id") == F.col("newest")).alias("is_latest"), "metric_value",
                    F.size("feature_names").alias("n_features"), F.array_join("feature_names", "|").alias("features"), F.col("forecasting.available").alias("can_forecast"),
                    F.coalesce("forecasting.base_frequency_minutes", F.lit(0)).alias("cadence"), F.col("forecasting.recent_history_rows").alias("history_rows"),
                    F.round(F.col("metrics")["rmse"], 6).alias("rmse"), "dataset_id", "unit", "dataset_rows")


@register("forecast_runs", """
WITH s AS (SELECT event_type AS project_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS y FROM events GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY project_id) AS n, lag(y, 24) OVER w AS prediction FROM s WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
p AS (SELECT *, CAST(pos - (n - 24) AS INTEGER) AS step FROM q WHERE pos > n - 24),
c AS (SELECT project_id, count(*) AS points, round(avg(abs(y - prediction)), 6) AS mae FROM p GROUP BY 1)
SELECT project_id, 'day-' || project_id AS run_id, step, ts, round(prediction, 6) AS prediction, CASE project_id WHEN 'purchase' THEN 'pieces' ELSE 'units' END AS unit, points, mae FROM p JOIN c USING (project_id)
""")
def forecast_runs(spark: SparkSession, sf: str) -> DataFrame:
    """L7 + L8: the last day of every hourly series forecast by the day before, appended as one run a project with the unit of the project's
    latest dataset; the comparison with what came is saved twice, and the later one counts."""
    reg = _registry(spark)
    points, _ = seasonal_backtest_points(spark, sf)
    points = points.withColumnRenamed("series_id", "project_id").checkpoint(eager=True)
    made = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    projects = points.select("project_id").distinct()
    for i, unit in enumerate((F.lit("old"), F.when(F.col("project_id") == "purchase", F.lit("pieces")).otherwise(F.lit("units")))):
        reg.register_datasets(projects.select("project_id", F.lit(f"v{i}").alias("version_id"), F.lit(None).cast("string").alias("name"), F.lit("y").alias("target"), F.lit(24).cast("long").alias("rows"),
                                              F.lit(2).alias("columns"), F.lit("{}").alias("schema_json"), unit.alias("unit"), F.timestamp_add("HOUR", F.lit(i), made).alias("created_at")))
    reg.append_forecast_runs(points.withColumn("run_id", F.concat(F.lit("day-"), "project_id")))
    actual = hourly_events(spark, sf).withColumnRenamed("series_id", "project_id")
    both = reg.forecast_runs().join(actual, ["project_id", "ts"])
    reg.save_comparisons(projects.select("project_id", F.lit(0).cast("long").alias("points"), F.lit(0.0).alias("mae")))
    reg.save_comparisons(both.groupBy("project_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 6).alias("mae")))
    return reg.forecast_runs().join(reg.comparisons(), "project_id").select(
        "project_id", "run_id", "step", "ts", F.round("prediction", 6).alias("prediction"), "unit", "points", "mae")


def seasonal_backtest_points(spark: SparkSession, sf: str):
    from verdin.plans.decisions import seasonal_backtest
    points, history = seasonal_backtest(spark, sf)
    return points.select("series_id", "step", "ts", "prediction"), history


@register("shap_factors")
def shap_factors(spark: SparkSession, sf: str) -> DataFrame:
    """E1 (with E2 fallback) + K1: top-5 SHAP factors per labelled document."""
    from verdin.operators import explain
    feats = ["kchars", "hwords", "digit_share", "lines"]
    df = document_features(spark, sf).select("doc_id", *feats, "quality")
    model, _ = ml.fit_tabular(df, "quality", "doc_id", importance=False, num_trees=100)   # its bags follow the order of these rows
    df = df.checkpoint(eager=True)   # background, scores and factors each go over these few numbers a row, not over the texts
    background = head_sample(df, ["doc_id"], shap.MAX_BACKGROUND)

    def score(frame: DataFrame) -> DataFrame:
        return ml.score(model, frame).withColumn("score", F.col("p_positive"))

    def proxy() -> DataFrame:
        prof = explain.baseline_profile(df, feats, [])
        imp = {f: 1.0 / len(feats) for f in feats}
        return explain.proxy_impact(df, prof, imp, feats, []).select(F.col("doc_id").alias("row_id"), "top_factors")

    method, factors, reason = shap.explain_rows(model, df, background, feats, "doc_id", score, proxy)
    return factors.select("row_id", F.lit(method).alias("method"), F.lit(reason).cast("string").alias("reason"), F.size("top_factors").alias("n_factors"),
                          F.col("top_factors")[0]["feature"].alias("top_feature"))


_ORDER_SCORE = """o_totalprice / 100003 + CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'O' THEN -1.0 ELSE 0.5 END + 0.7 * {month}"""

_SHAP_SQL = """
WITH g AS (SELECT o_orderkey, o_totalprice / 100003 AS price, CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'O' THEN -1.0 ELSE 0.5 END AS status,
                  0.7 * month(o_orderdate) AS date_part FROM orders),
b AS (SELECT avg(price) AS price, avg(status) AS status, avg(date_part) AS date_part FROM (SELECT * FROM g ORDER BY o_orderkey LIMIT 20)),
phi AS (SELECT g.o_orderkey, g.price + g.status + g.date_part AS prediction, b.price + b.status + b.date_part AS base_value,
               unnest([{'feature': 'o_totalprice', 'phi': g.price - b.price}, {'feature': 'o_orderstatus', 'phi': g.status - b.status},
                       {'feature': 'o_orderdate', 'phi': g.date_part - b.date_part}]) AS f FROM g, b)
"""


def _order_shap(spark: SparkSession, sf: str):
    """Kernel SHAP of a fixed additive score over a number, a category and a raw timestamp of every order."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    feats = ["o_totalprice", "o_orderstatus", "o_orderdate"]

    def score(frame: DataFrame) -> DataFrame:
        return frame.withColumn("score", F.expr(_ORDER_SCORE.format(month="month(o_orderdate)")))

    background = head_sample(rows, ["o_orderkey"], shap.MAX_BACKGROUND)
    return rows, background, shap.kernel_shap(rows, background, feats, "o_orderkey", score)


@register("shap_additive", _SHAP_SQL + """
SELECT o_orderkey, f.feature AS feature, round(f.phi, 6) + 0 AS shap_value, round(base_value, 6) AS base_value, round(prediction, 6) AS prediction FROM phi""")
def shap_additive(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on typed columns, where the exact values are known: the terms of an additive score less their background means."""
    _, _, values = _order_shap(spark, sf)
    return values.select(F.col("row_id").alias("o_orderkey"), "feature", (F.round("shap_value", 6) + F.lit(0.0)).alias("shap_value"),
                         F.round("base_value", 6).alias("base_value"), F.round("prediction", 6).alias("prediction"))


@register("shap_top_factor", _SHAP_SQL + """
SELECT o_orderkey, arg_max(f.feature, abs(f.phi)) AS feature, round(max(abs(f.phi)), 6) AS impact,
       arg_max(f.phi >= 0, abs(f.phi)) AS positive, count(*) FILTER (abs(f.phi) >= 1e-6) AS n_factors FROM phi GROUP BY o_orderkey""")
def shap_top_factor(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the largest factor of every order and how many factors it has."""
    rows, _, values = _order_shap(spark, sf)
    top = shap.shap_top_factors(values, rows, "o_orderkey")
    first = F.col("top_factors")[0]
    return top.select(F.col("row_id").alias("o_orderkey"), first["feature"].alias("feature"), first["impact_score"].alias("impact"),
                      (first["direction"] == "positive").alias("positive"), F.size("top_factors").cast("long").alias("n_factors"))


@register("explained_predictions", _SHAP_SQL + """
, t AS (SELECT o_orderkey, arg_max(f.feature, abs(f.phi)) AS feature, count(*) FILTER (abs(f.phi) >= 1e-6) AS n FROM phi GROUP BY o_orderkey)
SELECT o_orderkey, round(g.price + g.status + g.date_part, 6) AS prediction, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE n END AS n_factors,
       CASE WHEN o_orderstatus <> 'P' THEN feature END AS top_feature
FROM g JOIN orders USING (o_orderkey) JOIN t USING (o_orderkey)""")
def explained_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every prediction with its explanation items; orders under way have none, and an empty list."""
    rows, _, values = _order_shap(spark, sf)
    explained = rows.where("o_orderstatus <> 'P'")
    items = shap.shap_top_factors(values.join(explained.select(F.col("o_orderkey").alias("row_id")), "row_id", "left_semi"), explained, "o_orderkey")
    predictions = rows.select(F.col("o_orderkey").alias("row_id"), F.expr(_ORDER_SCORE.format(month="month(o_orderdate)")).alias("prediction"))
    out = merge.attach_by_row(predictions, items.select("row_id", "top_factors"), empty=["top_factors"])
    return out.select(F.col("row_id").alias("o_orderkey"), F.round("prediction", 6).alias("prediction"), F.size("top_factors").cast("long").alias("n_factors"),
                      F.get("top_factors", F.lit(0))["feature"].alias("top_feature"))


_LINEAR_SQL = """
WITH r AS (SELECT o_orderkey, o_orderdate, o_totalprice / 10000 AS price, o_totalprice / 10000 + c_acctbal / 500 AS target
           FROM orders JOIN customer ON o_custkey = c_custkey),
"""


def _linear_rows(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    price = F.col("o_totalprice") / 10000
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", price.alias("price"), (price + F.col("c_acctbal") / 500).alias("target"))


def _linear_model(train: DataFrame) -> ml.TabularModel:
    """The bundle of a least-squares line of the target on the price: a model whose predictions are known."""
    pipeline = _one_feature(ml.label_column(train, "target", "regression", None), "price")
    return ml.TabularModel(pipeline, "regression", "target", ["price"], ["price"], [], None, ml.TemporalProjector())


@register("linear_holdout", _LINEAR_SQL + """
s AS (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '42')) <= ceil(count(*) OVER () * 0.2) AS test FROM r),
m AS (SELECT regr_slope(target, price) AS a, regr_intercept(target, price) AS b FROM s WHERE NOT test)
SELECT o_orderkey, round(price, 6) AS price, round(target, 6) AS actual, round(a * price + b, 6) AS prediction, round_even(a * price + b - target, 6) AS error FROM s, m WHERE test""")
def linear_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """M5 + M7 + M9: the holdout table of a linear model: inputs, actual, prediction and error of each held-out order."""
    split = ml.seeded_split(_linear_rows(spark, sf).drop("o_orderdate"), "o_orderkey", 0.2)
    model = _linear_model(split.where("split = 'train'"))
    table_ = ml.holdout_table(ml.score(model, split.where("split = 'test'")), model, "o_orderkey")
    return table_.select("o_orderkey", F.round("record.price", 6).alias("price"), F.round("actual", 6).alias("actual"), F.round("prediction", 6).alias("prediction"), "error")


@register("linear_compare", _LINEAR_SQL + """
m AS (SELECT regr_slope(target, price) AS a, regr_intercept(target, price) AS b FROM r WHERE o_orderdate < TIMESTAMP '2000-01-01'),
p AS (SELECT o_orderkey, target, a * price + b AS prediction FROM r, m WHERE o_orderdate >= TIMESTAMP '2000-01-01'),
g AS (SELECT count(*) AS n, avg((prediction - target) ** 2) AS mse, avg(abs(prediction - target)) AS mae, var_pop(target) AS v FROM p)
SELECT o_orderkey, round(target, 6) AS actual, round(prediction, 6) AS prediction, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(1 - mse / v, 6) AS r2,
       round(n * ln(mse) + 2, 4) AS aic FROM p, g""")
def linear_compare(spark: SparkSession, sf: str) -> DataFrame:
    """J8 + M10: a linear model of the orders before 2000 scores the later ones in place, with k = 1 metrics."""
    rows, cut = _linear_rows(spark, sf), F.lit("2000-01-01").cast("timestamp_ntz")
    model = _linear_model(rows.where(F.col("o_orderdate") < cut))
    pairs, metrics = ml.compare_with_actual(model, rows.where(F.col("o_orderdate") >= cut), "o_orderkey")
    return pairs.select("o_orderkey", F.round("actual", 6).alias("actual"), F.round("prediction", 6).alias("prediction"),
                        *[F.lit(metrics[k]).alias(k) for k in ("rmse", "mae", "r2")], F.round(F.lit(metrics["aic"]), 4).alias("aic"))
