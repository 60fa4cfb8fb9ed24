from verdin.operators import profile


def test_hour_only_energy_recommended_target(spark, hour_only_energy):
    prof = profile.column_profile(spark, hour_only_energy)
    rows = {r["column_name"]: r for r in prof.collect()}
    assert rows["Потребление"]["kind"] == "numeric"
    top = profile.target_ranking(prof).filter("recommended").first()
    assert top["column_name"] == "Потребление" and top["suggested_task_type"] == "regression"


def test_identifier_and_text_kinds(spark):
    rows = [(i, f"user-{i}", "red" if i % 2 else "blue", f"{i % 24}:15") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, handle string, colour string, slot string")
    p = {r["column_name"]: r for r in profile.column_profile(spark, df).collect()}
    assert p["id"]["looks_like_identifier"]
    assert p["handle"]["kind"] == "text" and p["handle"]["looks_like_identifier"]
    assert p["colour"]["kind"] == "categorical" and p["colour"]["suggested_task_type"] == "binary"
    assert p["slot"]["kind"] == "time" and not p["slot"]["target_eligible"]


def test_dataset_summary_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "x int, t string")
    s = profile.dataset_summary(df, "x").first()
    assert s["n_rows"] == 5 and s["duplicate_rows"] == 2 and s["missing_values"] == 2
    assert s["task_type"] == "multiclass" or s["task_type"] == "regression"


def test_unit_suggestion(spark, hour_only_energy):
    from pyspark.sql import functions as F
    df = hour_only_energy.withColumn("Единица измерения", F.lit(" кВт·ч "))
    r = profile.unit_suggestion(df).first()
    assert r["unit_column"] == "Единица измерения" and r["suggested_unit"] == "кВт·ч" and r["count"] == 10


def test_validation_errors(spark):
    import pytest
    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "a int, y double")
    with pytest.raises(profile.ValidationError):
        profile.validate_training_frame(df, "y")
    with pytest.raises(profile.ValidationError):
        profile.align_features(df, ["a", "missing"])
    rep = profile.resolve_missing_inputs(["Час", "x"], ["Дата__ts", "Дата__hour", "Час"])
    assert rep["missing_inputs"] == ["Дата"] and not rep["ready"]


def test_examples_sample_and_reasons(spark):
    from verdin.operators import profile
    df = spark.createDataFrame([(i, None if i < 3 else i * 0.5, None, "same") for i in range(50)], "id long, target double, void string, one string").repartition(7)
    got = {r.column_name: r.example_values for r in profile.example_values(df, ["id"]).collect()}
    assert got == {"id": ["0", "1", "2", "3"], "target": ["1.5", "2.0", "2.5", "3.0"], "void": [], "one": ["same"] * 4}
    assert [r.id for r in profile.sample_rows(df, ["id"]).collect()] == list(range(12))
    why = {r.column_name: r.target_reason for r in profile.target_reason(profile.column_profile(spark, df)).collect()}
    assert "named like a target" in why["target"] and "one value only" in why["one"] and "identifier" in why["id"]
    assert profile.example_values(df.limit(0), ["id"]).count() == 4
