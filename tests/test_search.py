import itertools
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdin.operators import ml, search
from verdin.options import TrainingOptions
from verdin.session import scratch_table_path
from verdin.sources import tabular


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    monkeypatch.setattr(search, "NETWORK_STEPS", 15)
    monkeypatch.setattr(search, "BOOSTING", {c: {**p, "maxIter": 3, "maxDepth": 3} for c, p in search.BOOSTING.items()})


def _rows(spark, n=120):
    rows = [(i, float(i % 17), float(i * 7 % 5), "uvw"[i % 3], 3.0 * (i % 17) + (i * 7 % 5) ** 2 + 2 * (i % 3), "abc"[(i * 7 % 5 + i % 3) % 3], int(i % 17 > 8)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, f double, g double, c string, y double, k string, b long")


def test_convex_weights_against_a_fine_grid():
    rng = np.random.default_rng(0)
    steps = 40
    grid = [np.array([*w, steps - sum(w)]) / steps for w in itertools.product(range(steps + 1), repeat=2) if sum(w) <= steps]
    for trial in range(40):
        e = rng.normal(size=(3, 30)) * rng.uniform(0.2, 3, (3, 1)) + rng.normal(size=30) * (trial % 3)
        g = e @ e.T / 30
        w = search.convex_weights(g)
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-12
        assert w @ g @ w <= min(v @ g @ v for v in grid) + 1e-12
    assert search.convex_weights(np.array([[1.0, 1.0], [1.0, 1.0]])).tolist() == [1.0, 0.0]      # equal candidates: the first
    assert search.convex_weights(np.zeros((2, 2))).tolist() == [1.0, 0.0]


def test_out_of_fold_rows_are_never_in_their_own_fit(spark):
    """A memorising candidate: its prediction of a row is the mean label of the rows it was fitted on with the same f."""
    rows = search.fold_column(_rows(spark).withColumn("label", F.col("y")), "id", 4).checkpoint()
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) - min(sizes.values()) <= 1
    local = [(r.id, r.fold, r.f, r.label) for r in rows.collect()]
    models = {"mean": [sum(x[3] for x in local if x[1] != f) / sum(x[1] != f for x in local) for f in range(4)],
              "zero": [0.0] * 4}
    oof = search.out_of_fold(rows, ["id", "label"], models, dict.fromkeys(models, lambda m, df: df.withColumn("p", F.array(F.lit(m)))))
    got = {r.id: (r.fold, r.p_mean[0], r.p_zero[0]) for r in oof.collect()}
    assert got == {i: (f, models["mean"][f], 0.0) for i, f, _, _ in local}
    m = search.gram_matrix(search.gram(oof, ["mean", "zero"], "regression").first(), 2)
    e = np.array([[got[i][1] - y for i, _, _, y in local], [-y for *_, y in local]])
    assert np.allclose(m, e @ e.T / len(local))
    long = search.long_form(oof, ["id"], ["mean", "zero"]).collect()
    assert len(long) == 2 * len(local) and len({(r.id, r.fold, r.candidate) for r in long}) == len(long)


@pytest.mark.parametrize(("target", "task"), [("y", "regression"), ("k", "multiclass"), ("b", "binary")])
def test_every_code_fits_every_task_and_the_model_is_the_blend(spark, target, task):
    df = _rows(spark).select("id", "f", "g", "c", target)
    opts = TrainingOptions.from_payload({"algos": ["xgb", "linear_l2", "nn"] if task != "regression" else ["lgb", "linear_l2", "nn"],
                                         "timeout_seconds": 600, "cv_folds": 2, "task_type": task})
    found = search.search(df, target, "id", opts)
    board = {r["candidate"]: r for r in found.board.collect()}
    assert sorted(board) == sorted([*opts.algos, "blend"])
    assert all(board[c]["status"] == "fitted" and board[c]["cv_metric"] is not None and board[c]["holdout_metric"] is not None for c in opts.algos)
    # the weights minimise the blend's out-of-fold error
    k = len(found.model.classes or [])
    label = {r.id: r.label for r in found.oof.collect()}
    vectors = {c: {r.id: np.array(r[f"p_{c}"]) for r in found.oof.collect()} for c in opts.algos}
    truth = {i: np.array([y]) if task == "regression" else np.eye(k)[int(y)] for i, y in label.items()}
    e = np.array([np.concatenate([vectors[c][i] - truth[i] for i in sorted(label)]) for c in opts.algos])
    w = np.array([found.weights[c] for c in opts.algos])
    best = search.convex_weights(e @ e.T / len(label))
    assert np.allclose(w, best, atol=1e-6)
    # the returned model is the weighted mean of its members
    probe = found.model.projector.transform(df)
    scored = {r.id: r for r in found.model.pipeline.transform(probe).collect()}
    members = {c: {r.id: np.array(r.p) for r in m.transform(probe).withColumn("p", search.parts(m, task, k)).collect()} for c, m in found.model.pipeline.members.items()}
    for i, r in scored.items():
        mean = sum(found.weights[c] * members[c][i] for c in members)
        assert np.allclose(mean, r.prediction if task == "regression" else r.probability.toArray(), atol=1e-9)
    if task != "regression":
        assert all(abs(sum(r.probability) - 1) < 1e-9 for r in scored.values())
    # and survives its bundle
    path = scratch_table_path(spark, f"bundle-{uuid.uuid4().hex[:8]}")
    tabular.save_model_bundle(spark, found.model, path)
    again = tabular.load_model_bundle(spark, path)
    assert again.composition == found.model.composition
    ours, theirs = (sorted((r.id, round(r.prediction, 9)) for r in m.pipeline.transform(probe).collect()) for m in (found.model, again))
    assert ours == theirs


def test_a_slow_candidate_is_cut_and_the_board_says_so(spark):
    def slow(code, *args):
        if code == "nn":
            args[1].sparkSession.sparkContext.parallelize(range(40), 8).foreach(lambda _: time.sleep(60))
        return search.fit_candidate(code, *args)

    opts = TrainingOptions.from_payload({"algos": ["nn", "linear_l2"], "timeout_seconds": 100, "cv_folds": 2})
    began = time.time()
    found = search.search(_rows(spark).select("id", "f", "g", "y"), "y", "id", opts, fit=slow)
    board = {r["candidate"]: r for r in found.board.collect()}
    assert board["nn"]["status"].startswith("stopped after") and board["nn"]["blend_weight"] == 0 and board["nn"]["cv_metric"] is None
    assert board["linear_l2"]["status"] == "fitted" and list(found.weights) == ["linear_l2"] and time.time() - began < 300
    assert found.model.composition == {"linear_l2": 1.0}


def test_backends_and_fallback(spark):
    df = _rows(spark, 60).select("id", "f", "g", "y")

    def broken(code, *args):
        raise RuntimeError("no such library")

    model, holdout, told = search.train(df, "y", "id", {"backend": "sklearn", "algos": "nn", "test_size": 0.5}, importance=False, num_trees=5)
    assert told["effective"]["backend"] == "forest" and told["board"] is None and any("algos" in w for w in model.warnings) and holdout.count() == 30
    model, _, told = search.train(df, "y", "id", {"algos": "linear_l2", "timeout_seconds": 200}, fit=broken, importance=False, num_trees=5)
    assert told["effective"]["backend"] == "forest" and any("no such library" in w for w in model.warnings)
    with pytest.raises(ValueError, match="no such library"):
        search.train(df, "y", "id", {"backend": "search", "timeout_seconds": 200}, fit=broken)
    model, holdout, told = search.train(df, "y", "id", {"algos": "linear_l2", "timeout_seconds": 300, "test_size": 0.25, "cv_folds": 3, "preset": "utilized"})
    assert told["effective"]["cv_folds"] == 3 and holdout.count() == 15 and {r["candidate"] for r in told["board"].collect()} == {"linear_l2", "linear_l2@43", "blend"}
    assert model.backend == "search" and abs(sum(model.importances.values()) - 1) < 1e-4 and model.record()["composition"] == told["effective"]["weights"]
    assert isinstance(ml.score(model, model.projector.transform(df)).first()["prediction_value"], float)
