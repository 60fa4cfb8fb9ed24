import uuid


from verdin.operators import ml
from verdin.session import scratch_table_path
from verdin.sources import tabular


def _sensor(spark, n=48):
    rows = []
    for i in range(n):
        t, v, p = 55 + i % 10, 0.2 + (i % 6) * 0.12, 80 + (i % 8) * 4
        rows.append((i, t, v, p, int(0.8 * t + 60 * v + 0.25 * p > 86), "08:30" if i % 2 else "17:45"))
    return spark.createDataFrame(rows, "id long, temperature long, vibration double, pressure long, target long, shift string")


def test_classification_bundle_roundtrip(spark):
    df = _sensor(spark)
    model, holdout = ml.fit_tabular(df, "target", "id", num_trees=20)
    assert model.task_type == "binary" and model.classes == ["0", "1"]
    assert "shift__minutes" in model.features
    h = holdout.collect()
    assert len(h) == sum(1 for _ in h) and all(0.5 <= r["confidence"] <= 1.0 for r in h)
    assert set(model.metrics) == {"accuracy", "f1_weighted"}
    assert abs(sum(model.importances.values()) - 1.0) < 1e-5
    path = scratch_table_path(spark, f"bundle-{uuid.uuid4().hex[:8]}")
    tabular.save_model_bundle(spark, model, path)
    again = tabular.load_model_bundle(spark, path)
    a = ml.score(model, model.projector.transform(df)).select("id", "prediction_value").orderBy("id").collect()
    b = ml.score(again, again.projector.transform(df)).select("id", "prediction_value").orderBy("id").collect()
    assert a == b


def test_regression_holdout_and_unknown_categories(spark):
    rows = [(i, float(i), "x" if i % 3 else "y", 3.0 * i + (1 if i % 3 else 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, f double, cat string, y double")
    model, holdout = ml.fit_tabular(df, "y", "id", num_trees=20, importance=False)
    assert model.task_type == "regression" and holdout.count() == 12
    assert {"rmse", "r2", "aic"} <= set(model.metrics)
    new = spark.createDataFrame([(100, 5.0, "never-seen", 0.0)], "id long, f double, cat string, y double")
    assert ml.score(model, model.projector.transform(new)).count() == 1


def test_shuffled_copies_are_permutations_within_buckets(spark):
    df = spark.createDataFrame([(i, float(i), f"t{i % 7}", None if i % 5 == 0 else i) for i in range(300)], "id long, a double, b string, c long")
    copies = ml.shuffled_copies(df, ["a", "b", "c"], "id", bucket_rows=100).collect()
    parts = {}
    for r in copies:
        parts.setdefault(r._feature, {})[r.id] = r
    assert {f: len(rows) for f, rows in parts.items()} == {"": 300, "a": 300, "b": 300, "c": 300}
    base = parts[""]
    assert all((r.a, r.b, r.c) == (float(i), f"t{i % 7}", None if i % 5 == 0 else i) for i, r in base.items())
    for f in ("a", "b", "c"):
        rows = parts[f]
        assert sorted(str(r[f]) for r in rows.values()) == sorted(str(r[f]) for r in base.values())
        assert sum(rows[i][f] != base[i][f] for i in rows) > 150
        assert all(rows[i][o] == base[i][o] for i in rows for o in ("a", "b", "c") if o != f)
    again = {(r._feature, r.id): r for r in ml.shuffled_copies(df.repartition(7), ["c", "a", "b"], "id", bucket_rows=100).collect()}
    assert all(again[r._feature, r.id].asDict() == r.asDict() for r in copies)


def test_importance_of_no_rows_and_of_no_harm_is_even(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 9)) for i in range(40)], "id long, a double, y double")
    model, _ = ml.fit_tabular(df, "y", "id", task="regression", num_trees=2, importance=False)
    rows = ml.label_column(df, "y", "regression", None)
    assert ml.permutation_importance(model, rows, "id") == {"a": 1.0}
    assert ml.permutation_importance(model, rows.limit(0), "id") == {"a": 1.0}
    assert [r.feature for r in ml.importance_table(spark, {"x": 0.1, "b": 0.45, "a": 0.45}, 2).collect()] == ["a", "b"]


def test_importance_predicts_each_copy_once(spark):
    from verdin.operators.metrics import regression_metrics
    df = spark.createDataFrame([(i, float(i % 7), 2.0 * (i % 7)) for i in range(40)], "id long, a double, y double")
    model, _ = ml.fit_tabular(df, "y", "id", task="regression", num_trees=2, importance=False)
    rows = ml.label_column(df, "y", "regression", None)
    for frame, keys in ((ml.shuffled_copies(rows, ["a"], "id"), ["_feature"]), (rows, [])):
        found = regression_metrics(ml.score(model, frame), "label", "prediction_value", keys)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("UDF(features#") == 1, plan


def test_forest_keeps_no_node_ids_and_its_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(float(i % 11), float(i % 5), float(i % 2)) for i in range(200)], "a double, b double, label double")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).coalesce(1)
    for task in ("regression", "binary"):
        plain, cached = ml.forest(task, num_trees=5), ml.forest(task, num_trees=5).setCacheNodeIds(True)
        assert not plain.getCacheNodeIds()
        trees = [[t.toDebugString.split("\n")[1:] for t in f.fit(data).trees] for f in (plain, cached)]
        assert trees[0] == trees[1]


def test_node_memory_bounds_the_passes_and_leaves_the_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    assert ml.node_memory(300, 5, 6, 22) == 3 and ml.node_memory(1, 1, 1, 1) == 1
    assert ml.node_memory(300, 5, 0, 10_000) * ml.NODE_PASSES * 2 ** 20 >= 300 * 31 * 20_000 * 24
    assert ml.node_memory(300, 30, 50, 50) == 2048
    rows = [tuple(float(i * k % 37) for k in range(1, 41)) + (float(i % 13 + i % 5),) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"f{k} double" for k in range(1, 41)) + ", label double").coalesce(1)
    data = VectorAssembler(inputCols=df.columns[:-1], outputCol="features").transform(df)
    trees = [[t.toDebugString.split("\n")[1:] for t in ml.forest("regression", num_trees=12, memory_mb=mb).fit(data).trees] for mb in (1, 2048)]
    assert trees[0] == trees[1]


def test_training_fits_a_regression_in_bounded_passes(spark, monkeypatch):
    asked = []
    plain = ml.forest
    monkeypatch.setattr(ml, "forest", lambda *a, **k: asked.append(plain(*a, **k)) or asked[-1])
    df = spark.createDataFrame([(i, float(i % 7), f"c{i % 4}", 2.0 * (i % 7)) for i in range(60)], "id long, a double, b string, y double")
    ml.fit_tabular(df, "y", "id", task="regression", num_trees=3, importance=False)
    assert [(f.getMaxMemoryInMB(), f.getCacheNodeIds()) for f in asked] == [(1, False)]


def test_comparison_predicts_each_row_once(spark, monkeypatch):
    plans = []
    plain = ml.regression_metrics

    def seen(*args, **named):
        plans.append(plain(*args, **named))
        return plans[-1]

    monkeypatch.setattr(ml, "regression_metrics", seen)
    df = spark.createDataFrame([(i, float(i % 7), 2.0 * (i % 7)) for i in range(40)], "id long, a double, y double")
    model, _ = ml.fit_tabular(df, "y", "id", task="regression", num_trees=2, importance=False)
    pairs, found = ml.compare_with_actual(model, df, "id")
    assert pairs.count() == 40 and "rmse" in found
    assert [p._jdf.queryExecution().optimizedPlan().toString().count("UDF(features#") for p in plans] == [1, 1]
