import numpy as np

from verdin.operators import metrics


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(10, 3, 200)
    p = y + rng.normal(0, 1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p", k=3).first()
    mse = np.mean((y - p) ** 2)
    assert abs(m["mse"] - round(mse, 6)) < 1e-6
    assert abs(m["r2"] - round(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), 6)) < 1e-6
    assert abs(m["r"] - round(np.corrcoef(y, p)[0, 1], 6)) < 1e-6
    aic = 200 * np.log(mse) + 6
    assert abs(m["aic"] - round(aic, 6)) < 1e-5
    assert abs(m["aicc"] - round(aic + 2 * 3 * 4 / (200 - 3 - 1), 6)) < 1e-5


def test_weighted_f1(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 2)]
    df = spark.createDataFrame(pairs, "a int, p int")
    m = metrics.classification_metrics(df, "a", "p").first()
    # per class: 0 → P 1, R .5, F1 .667; 1 → P .5, R 1, F1 .667; 2 → P 1, R .5, F1 .667
    assert m["accuracy"] == round(4 / 6, 6)
    assert abs(m["f1_weighted"] - round(2 / 3, 6)) < 1e-6


def test_improvement_gate():
    from pyspark.sql import functions as F  # noqa: F401
    assert metrics.primary_metric_name("regression") == "rmse"
    assert metrics.primary_metric_name("binary") == "f1_weighted"


def test_flat_predictions_have_no_correlation(spark):
    from verdin.operators.metrics import regression_metrics
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "y double, p double")
    m = regression_metrics(df, "y", "p").first()
    assert m["r"] is None and m["mae"] == round(4 / 3, 6)


def test_pairs_that_are_no_numbers_are_no_observation(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", None, 2.0), ("a", 5.0, float("nan")), ("a", float("inf"), 2.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, y double, p double")
    found = metrics.regression_metrics(df, "y", "p", ["k"]).collect()
    assert [(r["k"], r["n"], r["rmse"], r["mae"]) for r in found] == [("a", 2, 1.0, 1.0)]
    assert metrics.regression_metrics(df.where("k = 'b'"), "y", "p").first()["n"] == 0
