import uuid

import pytest
from pyspark.sql import functions as F

from verdin.operators import decide
from verdin.session import scratch_table_path

#: Facts (risk level, strong positive, medium positive and negative factors) and the rule that they select.
EXPECTED = {
    "inline_default": [
        ("high", 0, 0, 0, "inline_high_manual_review"), ("high", 2, 1, 3, "inline_high_manual_review"),
        ("medium", 1, 0, 0, "inline_medium_escalated_manual_review"), ("medium", 1, 0, 3, "inline_medium_escalated_manual_review"),
        ("medium", 0, 0, 2, "inline_medium_preventive_maintenance"), ("medium", 0, 1, 1, "inline_medium_targeted_diagnostics"),
        ("medium", None, None, None, "inline_medium_targeted_diagnostics"), ("low", 0, 0, 2, "inline_low_stabilization_review"),
        ("low", 2, 0, 1, "inline_low_observe"), ("other", 2, 0, 3, "inline_fallback_observe"), (None, 0, 0, 0, "inline_fallback_observe")],
    "forecast_default": [
        ("high", 0, 0, 0, "forecast_high_load_shedding"), ("medium", 1, 0, 2, "forecast_medium_capacity_reallocation"),
        ("medium", 0, 0, 2, "forecast_medium_preventive_maintenance"), ("medium", 0, 2, 1, "forecast_medium_watch_peak_window"),
        ("low", 1, 0, 0, "forecast_low_watch_peak_window"), ("low", 0, 2, 3, "forecast_low_observe"), (None, 1, 1, 1, "forecast_fallback_observe")],
    "forecast_conservative": [
        ("high", 0, 0, 0, "forecast_conservative_high_manual_review"), ("medium", 2, 0, 0, "forecast_conservative_medium_manual_review"),
        ("medium", 0, 0, 3, "forecast_conservative_medium_capacity_reallocation"), ("low", 1, 0, 0, "forecast_conservative_low_watch_peak_window"),
        ("low", 0, 0, 0, "forecast_conservative_observe"), ("other", 1, 0, 0, "forecast_conservative_observe")],
}


@pytest.mark.parametrize("rule_set", list(EXPECTED))
def test_facts_select_the_expected_rule(spark, rule_set):
    df = spark.createDataFrame(EXPECTED[rule_set], "risk_level string, strong_positive_count int, medium_positive_count int, negative_count int, want string")
    assert [(r["rule_id"], r["rule_set"]) for r in decide.match_rule(df, rule_set).collect()] == [(x[-1], rule_set) for x in EXPECTED[rule_set]]


def test_order_of_rules_and_every_kind_of_condition(spark):
    def chosen(rules, row, schema):
        cfg = {"default_rule_set": "x", "rule_sets": {"x": {"scenarios": {"s": ["a"]}, "rules": [
            {"rule_id": i, "priority": p, "scenario": "s", "summary": i, "conditions": c} for i, p, c in rules]}}}
        return decide.match_rule(spark.createDataFrame([row], schema), None, decide.validate_rule_config(cfg)).first()["rule_id"]

    always = [("b", 1, {}), ("c", 1, {}), ("a", 1, {}), ("z", 0, {})]
    assert chosen(always, (1,), "n int") == "c" and chosen(always[:1], (1,), "n int") == "b"
    rules = [("min", 9, {"n_min": 3}), ("max", 8, {"n_max": 0}), ("many", 7, {"k_in": ["u", None]}), ("one", 6, {"k_equals": "v"}), ("plain", 5, {"k": "w"}),
             ("absent", 4, {"nowhere": None, "k_in": "q"}), ("never", 3, {"nowhere_min": 0}), ("rest", 0, None)]
    for row, want in (((3, "v"), "min"), ((0, "v"), "max"), ((1, "u"), "many"), ((1, None), "many"), ((None, "v"), "one"), ((1, "w"), "plain"), ((1, "q"), "absent"), ((1, "x"), "rest")):
        assert chosen(rules, row, "n int, k string") == want


def test_rule_sets_are_saved_and_read_back(spark):
    cfg = decide.default_config()
    cfg["rule_sets"]["own"] = {"scenarios": {"s": ["Проверить"]}, "rules": [{"rule_id": "r", "scenario": "s", "summary": "сводка"}]}
    path = decide.save_rule_config(spark, cfg, scratch_table_path(spark, f"rules-{uuid.uuid4().hex[:8]}"))
    assert decide.load_rule_config(path, spark) == cfg


@pytest.mark.parametrize(("change", "said"), [
    (lambda c: c["rule_sets"]["x"]["scenarios"].update(s=[]), "scenarios.s"), (lambda c: c["rule_sets"]["x"]["scenarios"].update(s=["a", " "]), "scenarios.s.1"),
    (lambda c: c["rule_sets"]["x"].update(rules=[]), "rules"), (lambda c: c.update(default_rule_set="y"), "'y'"), (lambda c: c.update(rule_sets=[]), "rule_sets"),
    (lambda c: c["rule_sets"]["x"]["rules"].append(dict(c["rule_sets"]["x"]["rules"][0])), "2 times"), (lambda c: c["rule_sets"]["x"]["rules"][0].update(conditions=[1]), "conditions"),
    (lambda c: c["rule_sets"]["x"]["rules"][0].update(summary=None), "summary"), (lambda c: c["rule_sets"]["x"]["rules"][0].update(scenario="t"), "'t'")])
def test_faults_of_a_configuration_are_told(change, said):
    cfg = {"default_rule_set": "x", "rule_sets": {"x": {"scenarios": {"s": ["a"]}, "rules": [{"rule_id": "r", "scenario": "s", "summary": "one"}]}}}
    decide.validate_rule_config(cfg)
    change(cfg)
    with pytest.raises(decide.RuleSetError, match=said):
        decide.validate_rule_config(cfg)


def test_custom_conditions_and_no_match(spark):
    cfg = {"default_rule_set": "x", "rule_sets": {"x": {"scenarios": {"s": ["a"]}, "rules": [
        {"rule_id": "r1", "priority": 5, "scenario": "s", "summary": "one", "conditions": {"score_max": 0.5, "kind_equals": "q"}},
        {"rule_id": "r2", "priority": 5, "scenario": "s", "summary": "two", "conditions": {"missing_min": 1}},
    ]}}}
    decide.validate_rule_config(cfg)
    df = spark.createDataFrame([(0.4, "q"), (0.6, "q")], "score double, kind string")
    out = decide.match_rule(df.limit(1), "x", cfg).first()
    assert out["rule_id"] == "r1"
    with pytest.raises(Exception):
        decide.match_rule(df, "x", cfg).collect()


def test_rule_config_validation():
    bad = {"default_rule_set": "x", "rule_sets": {"x": {"scenarios": {"s": []}, "rules": [
        {"rule_id": "r", "priority": 1, "scenario": "nope", "summary": "s", "conditions": {}}]}}}
    with pytest.raises(decide.RuleSetError):
        decide.validate_rule_config(bad)


def test_facts_positive_label_normalization(spark):
    df = spark.createDataFrame([("1.0", 0.8), ("0", 0.8), ("Failure", 0.5), ("no", None)], "prediction string, confidence double")
    df = df.withColumn("top_factors", F.array().cast("array<struct<feature:string,direction:string,strength:string>>"))
    risks = [r["risk_level"] for r in decide.build_facts(df, "binary").collect()]
    assert risks == ["high", "low", "medium", "medium"]
