import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdin.operators.profile import exact_quantiles
from verdin.operators.series import autoregressive_features, prefix_sums, sequenced, with_chunks


def _random_series(seed):
    rng = random.Random(seed)
    rows = []
    for s in range(rng.randint(1, 4)):
        n = rng.randint(1, 120)
        ts = sorted(rng.sample(range(10_000), n))
        rows += [(f"s{s}", t, round(rng.uniform(-50, 50), 2)) for t in ts]
    return rows


def test_sequenced_matches_pandas_for_any_chunking(spark):
    for seed in range(4):
        rows = _random_series(seed)
        df = spark.createDataFrame(rows, "k string, t long, y double")
        pdf = pd.DataFrame(rows, columns=["k", "t", "y"]).sort_values(["k", "t"])
        pdf["pos"] = pdf.groupby("k").cumcount() + 1
        pdf["lag5"] = pdf.groupby("k")["y"].shift(5)
        pdf["m3"] = pdf.groupby("k")["y"].transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
        for chunk_rows in (1, 7, 1000):
            out = sequenced(df, ["k"], ["t"], halo=5, chunk_rows=chunk_rows,
                            compute=lambda f, w: f.withColumn("lag5", F.lag("y", 5).over(w))
                            .withColumn("m3", F.avg("y").over(w.rowsBetween(-3, -1)))).toPandas()
            got = out.sort_values(["k", "t"]).reset_index(drop=True)
            exp = pdf.reset_index(drop=True)
            assert list(got["_pos"]) == list(exp["pos"])
            assert np.allclose(got["lag5"].astype(float), exp["lag5"].astype(float), equal_nan=True)
            assert np.allclose(got["m3"].astype(float), exp["m3"].astype(float), equal_nan=True)
            assert (got.groupby("k")["_n"].first() == exp.groupby("k").size()).all()


def test_prefix_sums_and_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=500)
    df = spark.createDataFrame([(int(i % 3), float(v), 1) for i, v in enumerate(vals)], "g int, v double, c int")
    got = prefix_sums(df, ["g"], ["v"], ["c"], chunk_rows=13).toPandas().sort_values(["g", "v"])
    exp = got.groupby("g")["c"].cumsum()
    assert (got["cum_c"].values == exp.values).all()
    q = {r["g"]: r["quantile"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    for g in range(3):
        assert abs(q[g] - np.quantile(vals[np.arange(500) % 3 == g], 0.5)) < 1e-12


def test_feature_rows_start_after_required_history(spark, hourly_consumption):
    from verdin.functions.timefuncs import parse_timestamp
    s = hourly_consumption.select(F.lit("a").alias("k"), parse_timestamp("Дата").alias("ts"),
                                  F.col("Электропотребление").alias("y"))
    feats = autoregressive_features(s, ["k"], "ts", "y").toPandas()
    assert len(feats) == 120 - 48
    first = feats.sort_values("ts").iloc[0]
    ys = s.orderBy("ts").toPandas()["y"].to_numpy()
    assert abs(first["target_lag_48"] - ys[0]) < 1e-12
    assert abs(first["target_roll_std_3"] - np.std(ys[45:48])) < 1e-9
    assert abs(first["target_diff_1"] - (ys[47] - ys[46])) < 1e-12


def _check_chunks(df, keys, order, chunk_rows, most):
    """Chunks follow the order, and none is larger than ``most``; ordinals equal those of one window."""
    got = with_chunks(df, keys, order, chunk_rows)
    assert max(r["count"] for r in got.groupBy(*keys, "_chunk").count().collect()) <= most
    whole = Window.partitionBy(*keys).orderBy(*order)
    back = got.withColumn("p", F.lag("_chunk").over(whole)).where("p > _chunk")
    assert back.count() == 0
    pos = sequenced(df, keys, order, chunk_rows=chunk_rows).withColumn("rn", F.row_number().over(whole))
    assert pos.where("_pos <> rn").count() == 0


def test_no_chunk_is_large_with_outliers_ties_nulls_and_text(spark):
    rng = random.Random(5)
    base = spark.range(10_000).withColumn("k", F.lit("a"))
    outlier = base.union(spark.createDataFrame([(10 ** 15, "a")], "id long, k string"))
    _check_chunks(outlier, ["k"], ["id"], 100, 300)
    _check_chunks(base.withColumn("v", F.exp(F.col("id") / 50.0)), ["k"], ["v"], 100, 300)
    ties = base.withColumn("v", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("int"))
    _check_chunks(ties, ["k"], ["v", "id"], 100, 400)
    nulls = base.withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    _check_chunks(nulls, ["k"], ["v", "id"], 100, 400)
    texts = ["".join(rng.choice("abcdeйж") for _ in range(rng.randint(0, 9))) + f"-{i}" for i in range(3000)]
    _check_chunks(spark.createDataFrame([("a", t) for t in texts], "k string, t string"), ["k"], ["t"], 100, 600)


def test_chunks_follow_the_order_of_extreme_numbers(spark):
    values = [float("-inf"), -1e308, -1.5, -0.0, 0.5, 1e300, 1e308, float("inf"), float("nan")]
    rows = [("a", v, i) for v in values for i in range(30)] + [("a", None, i) for i in range(30)] + [("a", 2.0, None)]
    _check_chunks(spark.createDataFrame(rows, "k string, v double, i int"), ["k"], ["v", "i"], 7, 90)
    big = [("a", 2 ** 53 + j, j) for j in range(200)]
    _check_chunks(spark.createDataFrame(big, "k string, v long, i int"), ["k"], ["v", "i"], 7, 60)


def test_cells_of_a_hot_series_are_found_by_compiled_steps(spark):
    """A join on the chunk adds a test for nulls; on a column that may be null it would run the whole bisection again."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 11 == 0 else t0 + dt.timedelta(hours=i % 7 if i % 3 else i * i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    chunked = with_chunks(df, [], ["at", "id"], 100)
    assert not chunked.schema["_chunk"].nullable
    seq = sequenced(df, [], ["at", "id"], chunk_rows=100)
    plan = seq._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "Filter isnotnull(c" not in plan and "isnotnull(coalesce" not in plan
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or t0, r[0]))
    assert [(r["id"], r["_pos"]) for r in seq.orderBy("_pos").collect()] == [(r[0], i + 1) for i, r in enumerate(want)]
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 300
