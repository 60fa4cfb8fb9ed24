from pyspark.sql import functions as F

from verdin.functions.timefuncs import parse_timestamp
from verdin.operators import merge, series


def _split(daily_regime):
    df = daily_regime.withColumn("ts", parse_timestamp("timestamp"))
    return df.filter(F.col("period_index") < 150), df.filter(F.col("period_index") >= 150)


def test_all_history_counts(spark, daily_regime):
    hist, new = _split(daily_regime)
    tail = series.eval_tail(new, [], ["ts", "period_index"], 0.2)
    assert tail.filter("role = 'evaluation'").count() == 6
    assert hist.count() == 150


def test_last_30_days_counts(spark, daily_regime):
    hist, new = _split(daily_regime)
    window = series.history_window(hist, [], "ts", 30)
    assert window.count() == 31
    tail = series.eval_tail(new, [], ["ts", "period_index"], 0.2)
    train_new = tail.filter("role = 'train'").drop("role", "_pos", "_n")
    assert train_new.count() == 24
    cand = merge.append_dedupe(window.withColumn("_ord", F.lit(0)), train_new.withColumn("_ord", F.lit(1)))
    assert cand.count() == 55


def test_champion_and_candidate_keep_no_node_ids(spark, monkeypatch):
    from verdin.operators import ml, retrain
    asked = []
    plain = ml.forest
    monkeypatch.setattr(ml, "forest", lambda *a, **k: asked.append(plain(*a, **k)) or asked[-1])
    df = spark.createDataFrame([(i, float(i % 9), 3.5 * i + i % 9) for i in range(60)], "id long, a double, y double")
    current, _ = ml.fit_tabular(df.where("id < 40"), "y", "id", num_trees=2, importance=False)
    found = retrain.retrain(df.where("id < 40"), df.where("id >= 40"), current, "y", "id", None, num_trees=2)
    assert found.summary["candidate_training_rows"] == 56 and found.summary["new_rows_reserved_for_evaluation"] == 4
    assert [f.getCacheNodeIds() for f in asked] == [False, False]
