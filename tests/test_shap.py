import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from verdin.operators import shap


def _exact_shapley(f, x, background):
    m = len(x)
    phi = np.zeros(m)
    def v(S):
        return np.mean([f([x[j] if j in S else b[j] for j in range(m)]) for b in background])
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for r in range(m):
            for S in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                phi[i] += w * (v(set(S) | {i}) - v(set(S)))
    return phi


def test_kernel_shap_equals_exact_shapley_for_nonlinear_model(spark):
    feats = ["a", "b", "c"]
    rows = [(i, float(i % 5), float((i * 7) % 3), float(i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    bg = df.orderBy("id").limit(4)

    def score(frame):
        return frame.withColumn("score", F.col("a") * F.col("b") + 2 * F.col("c") + F.col("a") ** 2 / 10)

    out = shap.kernel_shap(df, bg, feats, "id", score).toPandas()
    f = lambda z: z[0] * z[1] + 2 * z[2] + z[0] ** 2 / 10
    background = [list(r)[1:] for r in rows[:4]]
    for rid, g in out.groupby("row_id"):
        x = list(rows[rid])[1:]
        exp = _exact_shapley(f, x, background)
        got = g.set_index("feature").loc[feats, "shap_value"].to_numpy()
        assert np.allclose(got, exp, atol=1e-9)
        assert abs(g["base_value"].iloc[0] + got.sum() - g["prediction"].iloc[0]) < 1e-9


def test_sampled_values_are_near_the_exact_ones_with_eight_features(spark):
    """2^8 − 2 coalitions, 36 of them evaluated.  Pairs of a coalition and its complement make terms of
    two features exact on average; the bound is on the mean error relative to the values' spread."""
    feats = [f"f{j}" for j in range(8)]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 8)).round(3)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{f} double" for f in feats))

    def score(frame):
        return frame.withColumn("score", F.col("f0") * F.col("f1") + 2 * F.col("f2") - F.col("f3") * F.col("f4") * F.col("f5") + F.col("f6") ** 2)

    f = lambda z: z[0] * z[1] + 2 * z[2] - z[3] * z[4] * z[5] + z[6] ** 2
    out = shap.kernel_shap(df, df.orderBy("id").limit(3), feats, "id", score).toPandas()
    errors, exact = [], []
    for rid, g in out.groupby("row_id"):
        exp = _exact_shapley(f, list(x[rid]), [list(r) for r in x[:3]])
        got = g.set_index("feature").loc[feats, "shap_value"].to_numpy()
        assert abs(g["base_value"].iloc[0] + got.sum() - g["prediction"].iloc[0]) < 1e-9
        assert abs(g["prediction"].iloc[0] - f(x[rid])) < 1e-9
        errors += list(np.abs(got - exp))
        exact += list(np.abs(exp))
    assert np.mean(errors) < 0.15 * np.mean(exact) and max(errors) < 0.5 * max(exact)


def test_one_feature_takes_the_whole_difference(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 5.0)], "id long, a double")
    out = shap.kernel_shap(df, df.orderBy("id").limit(1), ["a"], "id", lambda g: g.withColumn("score", F.col("a") * 3))
    assert [(r["row_id"], r["shap_value"]) for r in out.orderBy("row_id").collect()] == [(1, 0.0), (2, 9.0)]


def test_coalitions_within_the_budget_carry_the_kernel_mass():
    a = shap.coalitions(12, 40, seed=1)
    assert a == shap.coalitions(12, 40, seed=1) and 38 <= len(a) <= 40
    assert len({tuple(m) for m, _ in a}) == len(a)
    total = sum(11 / (s * (12 - s)) for s in range(1, 12))
    assert abs(sum(w for _, w in a) - total) < 1e-9
    assert len(shap.coalitions(5, 30)) == 30


def test_values_of_text_and_time_columns_are_exact(spark):
    """A score over a number, a category and a raw timestamp; brute force over the typed values."""
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    rows = [(i, float(i % 5), "xyz"[i % 3] if i != 4 else None, day + dt.timedelta(hours=7 * i), i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, kind string, at timestamp_ntz, flag boolean")
    bg = df.orderBy("id").limit(3)

    def score(frame):
        assert dict(frame.dtypes)["kind"] == "string" and dict(frame.dtypes)["at"] == "timestamp_ntz"
        return frame.withColumn("score", F.col("a") * F.when(F.col("kind") == "x", 3.0).when(F.col("kind").isNull(), -1.0).otherwise(1.0)
                                + F.hour("at") * F.col("a") / 5 + F.col("flag"))

    f = lambda z: z[0] * {"x": 3.0, None: -1.0}.get(z[1], 1.0) + z[2].hour * z[0] / 5 + float(z[3])
    feats = ["a", "kind", "at", "flag"]
    out = shap.kernel_shap(df, bg, feats, "id", score).toPandas()
    for rid, g in out.groupby("row_id"):
        exp = _exact_shapley(f, list(rows[rid])[1:], [list(r)[1:] for r in rows[:3]])
        assert np.allclose(g.set_index("feature").loc[feats, "shap_value"].to_numpy(), exp, atol=1e-9)
    top = {r["row_id"]: {x["feature"]: x for x in r["top_factors"]} for r in shap.shap_top_factors(
        spark.createDataFrame(out), df, "id", dict(zip(feats, rows[0][1:], strict=True))).collect()}
    assert top[1]["kind"]["value"] is None and top[1]["kind"]["value_text"] == "y" and top[1]["kind"]["baseline_text"] == "x"
    assert top[1]["a"]["value"] == 1.0 and top[1]["a"]["baseline"] == 0.0


def test_fallback_tells_its_reason(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 5.0)], "id long, a double")

    def broken(frame):
        raise ValueError("no such model")

    method, factors, reason = shap.explain_rows(None, df, df, ["a"], "id", broken, lambda: df)
    assert method == "proxy-feature-impact" and "no such model" in reason and factors.count() == 2
    method, _, reason = shap.explain_rows(None, df, df, ["a"], "id", lambda g: g.withColumn("score", F.col("a")), lambda: df)
    assert method == "shap-kernel" and reason is None


def test_shap_factors_explains_from_features_kept_once(spark, monkeypatch, tmp_path):
    from verdin.plans import modeling
    docs = [(i, "w" * (i % 7) + " 1\n" * (i % 3), "en", "s", 9) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    frames = []

    def explain_rows(model, rows, background, *rest):
        frames.extend([rows, background])
        return "none", rows.selectExpr("doc_id AS row_id", "array(named_struct('feature', 'lines')) AS top_factors"), None

    monkeypatch.setattr(modeling.ml, "fit_tabular", lambda *a, **k: (None, None))
    monkeypatch.setattr(modeling.shap, "explain_rows", explain_rows)
    assert modeling.shap_factors(spark, str(tmp_path)).count() == 50
    assert len(frames) == 2 and not [f for f in frames if "FileScan" in f._jdf.queryExecution().executedPlan().toString()]
    plain = modeling.document_features(spark, str(tmp_path)).drop("lang", "source")
    assert sorted(map(tuple, frames[0].collect())) == sorted(map(tuple, plain.select(frames[0].columns).collect()))
