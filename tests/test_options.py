import pytest
from pyspark.sql import functions as F

from verdin.operators import profile
from verdin.options import RetrainingOptions, TrainingOptions


def test_training_option_bounds():
    o = TrainingOptions.from_payload({"algos": "lgb, rf, lgb", "backend": "sklearn"})
    assert o.algos == ["lgb", "rf"] and o.backend == "forest"
    for bad in ({"timeout_seconds": 4}, {"cpu_limit": 0}, {"test_size": 1.0}, {"cv_folds": 1},
                {"task_type": "ranking"}, {"algos": ["boost"]}, {"preset": "x"}):
        with pytest.raises(ValueError):
            TrainingOptions.from_payload(bad)


def test_retraining_option_bounds():
    o = RetrainingOptions.from_payload({"history_scope": "LAST_30_DAYS"})
    assert o.window_days == 30 and o.auto_activate
    for bad in ({"history_scope": "last_7_days"}, {"minimum_relative_improvement": -0.1},
                {"evaluation_fraction": 0.5}, {"evaluation_fraction": 0.0}):
        with pytest.raises(ValueError):
            RetrainingOptions.from_payload(bad)


def test_inspection_summary_and_histogram(spark, timestamped_energy):
    out = profile.inspection_summary(spark, timestamped_energy)
    assert out["ranking"].filter("recommended").first()["column_name"] == "Потребление"
    assert out["temporal"].first()["frequency_minutes"] == 240.0
    h = profile.target_distribution(timestamped_energy, "Потребление", "regression", bins=5).collect()
    assert sum(r["count"] for r in h) == 10 and max(r["bin"] for r in h) == 4
    c = profile.target_distribution(timestamped_energy.withColumn("k", F.lit("a")), "k", "binary").first()
    assert c["label"] == "a" and c["count"] == 10
