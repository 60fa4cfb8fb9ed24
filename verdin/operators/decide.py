"""Facts, rule matching and recommendations.

Each rule is compiled once into a struct that is null unless the rule applies; matching is the
greatest of these structs, a projection evaluated inside whole-stage codegen: no per-row Python,
no cross join with a rule table.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdin.functions.numeric import strength
from verdin.operators.rulesets import DEFAULT_RULE_SET, RULE_SETS

# Prediction labels read as the "positive"/risky class.
POSITIVE_LABELS = ("1", "true", "yes", "high", "risk", "failure", "positive", "anomaly")
# Peak hours for forecast points.
PEAK_HOURS = (7, 8, 9, 10, 17, 18, 19, 20, 21)
IMPACT_CAP = 9.999999
TOP_FACTORS = 5

FACTOR_TYPE = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("strength", T.StringType()),
    T.StructField("impact_score", T.DoubleType()),
])

# ---------------------------------------------------------------------------
# Rule-set configuration


class RuleSetError(ValueError):
    pass


class Leaf:
    """A value that has to satisfy ``holds``."""

    def __init__(self, wanted: str, holds):
        self.wanted, self.holds = wanted, holds

    def faults(self, value, where: str):
        if not self.holds(value):
            yield f"{where}: expected {self.wanted}"


class Many:
    """A list, or an object of any keys, with at least one entry; all entries have one shape."""

    def __init__(self, kind: type, entry):
        self.kind, self.entry = kind, entry

    def faults(self, value, where: str):
        if not isinstance(value, self.kind) or not value:
            yield f"{where}: expected a {'list' if self.kind is list else 'set of named entries'} that is not empty"
            return
        for name, entry in value.items() if self.kind is dict else enumerate(value):
            yield from self.entry.faults(entry, f"{where}.{name}")


class Record:
    """An object with these fields."""

    def __init__(self, **fields):
        self.fields = fields

    def faults(self, value, where: str):
        if not isinstance(value, dict):
            yield f"{where}: expected an object"
            return
        for name, shape in self.fields.items():
            yield from shape.faults(value.get(name), f"{where}.{name}")


TEXT = Leaf("a text that is not blank", lambda v: isinstance(v, str) and v.strip() != "")
CONFIG_SHAPE = Record(
    default_rule_set=TEXT,
    rule_sets=Many(dict, Record(
        scenarios=Many(dict, Many(list, TEXT)),
        rules=Many(list, Record(rule_id=TEXT, scenario=TEXT, summary=TEXT, priority=Leaf("a whole number or nothing", lambda v: v is None or isinstance(v, int)),
                                conditions=Leaf("an object or nothing", lambda v: v is None or isinstance(v, dict)))))))


def _loose_ends(config: dict):
    """Names that a well-shaped configuration mentions but does not define, and ids defined twice."""
    sets = config["rule_sets"]
    if config["default_rule_set"] not in sets:
        yield f"default_rule_set: no rule set {config['default_rule_set']!r}"
    for name, one in sets.items():
        ids = [r["rule_id"] for r in one["rules"]]
        yield from (f"rule_sets.{name}: rule id {i!r} is there {ids.count(i)} times" for i in dict.fromkeys(ids) if ids.count(i) > 1)
        yield from (f"rule_sets.{name}: rule {r['rule_id']!r} names no scenario: {r['scenario']!r}" for r in one["rules"] if r["scenario"] not in one["scenarios"])


def validate_rule_config(config: dict) -> dict:
    """The configuration, or a RuleSetError that lists all its faults."""
    faults = list(CONFIG_SHAPE.faults(config, "config")) or list(_loose_ends(config))
    if faults:
        raise RuleSetError("; ".join(faults))
    return config


def save_rule_config(spark: SparkSession, config: dict, path: str) -> str:
    """Store a valid configuration as text that Spark writes, so that any shared store holds it."""
    text = json.dumps(validate_rule_config(config), ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)
    return path


def default_config() -> dict:
    return {"default_rule_set": DEFAULT_RULE_SET, "rule_sets": copy.deepcopy(RULE_SETS)}


def load_rule_config(path: str | None = None, spark: SparkSession | None = None) -> dict:
    """The shipped rule sets, or a stored configuration (with ``spark``: read by Spark), validated alike."""
    if path is None:
        return validate_rule_config(default_config())
    if spark is not None:
        return validate_rule_config(json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))
    with open(path, encoding="utf-8") as fh:
        return validate_rule_config(json.load(fh))


def rule_set(name: str | None = None, config: dict | None = None) -> tuple[str, dict]:
    cfg = config or default_config()
    resolved = name or cfg["default_rule_set"]
    if resolved not in cfg["rule_sets"]:
        raise RuleSetError(f"unknown rule set {resolved!r}")
    return resolved, cfg["rule_sets"][resolved]


# ---------------------------------------------------------------------------
# Conditions as a table of tests


def _member(fact: Column, values) -> Column:
    values = values if isinstance(values, list) else [values]
    return reduce(Column.__or__, [_same(fact, v) for v in values], F.lit(False))


def _same(fact: Column, value) -> Column:
    return fact.isNull() if value is None else fact == F.lit(value)


#: What a condition's last word asks of its fact; a condition without such a word asks for equality.
TESTS = {
    "min": lambda fact, bound: fact.cast("double") >= float(bound),
    "max": lambda fact, bound: fact.cast("double") <= float(bound),
    "in": _member,
    "equals": _same,
}
_CONDITION = re.compile(f"(.+)_({'|'.join(TESTS)})")


def condition(facts: DataFrame, key: str, value) -> Column:
    """One condition as a truth value, never null; a fact that is not there is null."""
    named = _CONDITION.fullmatch(key)
    fact, test = named.groups() if named else (key, "equals")
    column = F.col(fact) if fact in facts.columns else F.lit(None)
    return F.coalesce(TESTS[test](column, value), F.lit(False))


def applies(facts: DataFrame, rule: dict) -> Column:
    """All conditions of the rule hold; a rule without conditions always applies."""
    return reduce(Column.__and__, [condition(facts, k, v) for k, v in (rule.get("conditions") or {}).items()], F.lit(True))


def match_rule(facts: DataFrame, rule_set_name: str | None = None, config: dict | None = None) -> DataFrame:
    """D3: of the rules that apply to a row, the one of highest priority, of equal ones the last id in text
    order: the greatest of their (priority, id) structs.  A row without any raises at run time."""
    resolved, rs = rule_set(rule_set_name, config)
    rules = rs["rules"]
    offers = [F.when(applies(facts, r), F.struct(F.lit(int(r.get("priority") or 0)).alias("priority"), F.lit(r["rule_id"]).alias("rule_id"), F.lit(i).alias("place")))
              for i, r in enumerate(rules)]
    best = F.greatest(*offers, offers[0])       # nulls do not count; one rule alone is offered twice
    idx = F.coalesce(best["place"], F.raise_error(F.lit("no rule applies to the facts")).cast("int")) + 1
    ids = F.array(*[F.lit(r["rule_id"]) for r in rules])
    scen = F.array(*[F.lit(r["scenario"]) for r in rules])
    summ = F.array(*[F.lit(r["summary"]) for r in rules])
    actions = F.create_map(*[x for name, acts in rs["scenarios"].items()
                             for x in (F.lit(name), F.array(*[F.lit(a) for a in acts]))])
    return (facts.withColumn("_rule_idx", idx)
            .withColumn("rule_id", F.element_at(ids, F.col("_rule_idx")))
            .withColumn("scenario_id", F.element_at(scen, F.col("_rule_idx")))
            .withColumn("summary", F.element_at(summ, F.col("_rule_idx")))
            .withColumn("actions", F.element_at(actions, F.col("scenario_id")))
            .withColumn("rule_set", F.lit(resolved))
            .drop("_rule_idx"))


# ---------------------------------------------------------------------------
# facts


def add_factor_lists(df: DataFrame, factors: str = "top_factors") -> DataFrame:
    """D1 lists and D2 counters from a factor array (a null array counts as empty).

    One ``aggregate`` pass fills all three lists (instead of a filter/transform pair
    per list)."""
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("sp"), empty.alias("mp"), empty.alias("ng"))

    def step(acc, f):
        pos = f["direction"] == "positive"
        one = F.array(f["feature"])
        return F.struct(
            F.when(pos & (f["strength"] == "strong"), F.concat(acc["sp"], one)).otherwise(acc["sp"]).alias("sp"),
            F.when(pos & (f["strength"] == "medium"), F.concat(acc["mp"], one)).otherwise(acc["mp"]).alias("mp"),
            F.when(f["direction"] == "negative", F.concat(acc["ng"], one)).otherwise(acc["ng"]).alias("ng"))

    lists = F.aggregate(F.coalesce(F.col(factors), F.array().cast(df.schema[factors].dataType)), init, step)
    out = df.withColumn("_lists", lists)
    out = (out.withColumn("strong_positive_factors", F.col("_lists.sp"))
              .withColumn("medium_positive_factors", F.col("_lists.mp"))
              .withColumn("negative_factors", F.col("_lists.ng")).drop("_lists"))
    return (out.withColumn("strong_positive_count", F.size("strong_positive_factors"))
               .withColumn("medium_positive_count", F.size("medium_positive_factors"))
               .withColumn("negative_count", F.size("negative_factors")))


def label_token(prediction: Column) -> Column:
    """Lower-cased trimmed text of a label; integral doubles print without '.0' (Q7 fix)."""
    text = F.lower(F.trim(prediction.cast("string")))
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def build_facts(df: DataFrame, task_type: str, prediction: str = "prediction",
                confidence: str | None = "confidence", factors: str = "top_factors") -> DataFrame:
    """score = confidence (0.5 if absent); for classification a non-positive label
    flips it to 1 − score; ≥0.75 high, ≥0.45 medium, else low."""
    conf = F.col(confidence) if confidence and confidence in df.columns else F.lit(None).cast("double")
    score = F.coalesce(conf, F.lit(0.5))
    if task_type != "regression":
        score = F.when(label_token(F.col(prediction)).isin(*POSITIVE_LABELS), score).otherwise(1 - score)
    risk = F.when(score >= 0.75, F.lit("high")).when(score >= 0.45, F.lit("medium")).otherwise(F.lit("low"))
    out = df.withColumn("risk_score", score).withColumn("risk_level", risk)
    if "negative_factors" in df.columns:      # lists already derived with the factors
        return out
    return add_factor_lists(out, factors)


# Rationale texts (our wording).
RATIONALE_STRONG = "Strong positive factors: "
RATIONALE_NEGATIVE = "Restraining factors: "
RATIONALE_NONE = "No dominant factors identified."


def recommendations(facts: DataFrame, rule_set_name: str | None = None, config: dict | None = None) -> DataFrame:
    """Rule match plus rationale lines."""
    matched = match_rule(facts, rule_set_name, config)
    strong = F.when(F.size("strong_positive_factors") > 0,
                    F.concat(F.lit(RATIONALE_STRONG), F.concat_ws(", ", "strong_positive_factors")))
    neg = F.when(F.size("negative_factors") > 0,
                 F.concat(F.lit(RATIONALE_NEGATIVE), F.concat_ws(", ", "negative_factors")))
    has_s, has_n = F.size("strong_positive_factors") > 0, F.size("negative_factors") > 0
    lines = (F.when(has_s & has_n, F.array(strong, neg)).when(has_s, F.array(strong)).when(has_n, F.array(neg))
             .otherwise(F.array(F.lit(RATIONALE_NONE))))
    return matched.withColumn("rationale", lines)


# ---------------------------------------------------------------------------
# Recent-history baseline


def forecast_baseline(history: DataFrame, keys: Sequence[str], ts: str, y: str) -> DataFrame:
    """Mean, population std (near-zero std → max(5 % of |mean|, 1)), linear p75/p90 and
    the last actual, per series.  ``history`` is already a bounded tail (W8), so the
    exact percentile holds at most that many values per group."""
    agg = history.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.avg(y).alias("recent_mean"),
        F.stddev_pop(y).alias("_std"),
        F.percentile(y, F.array(F.lit(0.75), F.lit(0.9))).alias("_pct"),
        F.max_by(y, ts).alias("last_actual"),
        F.count(F.lit(1)).alias("history_rows"),
    )
    std = F.when(F.col("_std") < 1e-9, F.greatest(F.abs("recent_mean") * 0.05, F.lit(1.0))).otherwise(F.col("_std"))
    return (agg.withColumn("recent_std", std)
            .withColumn("recent_p75", F.col("_pct")[0])
            .withColumn("recent_p90", F.col("_pct")[1])
            .drop("_std", "_pct"))


# ---------------------------------------------------------------------------
# Forecast factors and risk

# Fixed values (our wording): forecast factor names.
F_MEAN = "deviation_from_recent_mean"
F_PREV = "deviation_from_previous_point"
F_P90 = "above_recent_p90"
F_PEAK = "peak_hour"


def _factor(idx: int, name: str, value: Column, baseline: Column, delta: Column,
            pos: Column, neg: Column, scale: float | None = None) -> Column:
    """One D10 factor; (-impact, index) lead the struct so natural order ranks it."""
    denom = F.lit(abs(scale)) if scale is not None else F.greatest(F.abs(pos), F.abs(neg), F.lit(1.0))
    raw = F.abs(delta) / denom
    direction = F.when(delta >= pos, F.lit("positive")).when(delta <= neg, F.lit("negative")).otherwise(F.lit("neutral"))
    impact = F.when(direction == "neutral", F.lit(0.0)).otherwise(raw)
    score = F.bround(F.least(impact, F.lit(IMPACT_CAP)), 6)
    return F.struct(
        (-score).alias("_k"), F.lit(idx).alias("_i"),
        F.lit(name).alias("feature"), value.cast("double").alias("value"), baseline.cast("double").alias("baseline"),
        direction.alias("direction"), strength(impact).alias("strength"), score.alias("impact_score"))


def rank_factors(factors: Column, k: int = TOP_FACTORS) -> Column:
    """K2: keep impact > 0, order by impact descending (stable on ties), take k.
    (-impact, index) lead each struct, so ``sort_array``'s natural order is the ranking."""
    kept = F.filter(factors, lambda f: f["impact_score"] > 0)
    return F.transform(F.slice(F.sort_array(kept), 1, k),
                       lambda f: F.struct(*[f[n].alias(n) for n in FACTOR_TYPE.fieldNames()]))


def forecast_decisions(points: DataFrame, baseline: DataFrame, keys: Sequence[str],
                       rule_set_name: str = "forecast_default", config: dict | None = None) -> DataFrame:
    """D11 core: points (keys, step, ts, prediction) ⋈ baseline → W14 previous value →
    D10 factors → D9 risk → D1/D2 lists → D3 rule.

    The previous-point window is partitioned by series and spans only forecast
    steps (bounded by the requested step count)."""
    w = Window.partitionBy(*keys).orderBy("step")
    df = points.join(baseline, list(keys), "inner")
    p = F.col("prediction")
    std = F.col("recent_std")
    prev = F.coalesce(F.lag("prediction", 1).over(w), F.col("last_actual"))
    df = df.withColumn("_prev", prev)
    hour = F.hour("ts")
    peak = F.when(hour.isin(*PEAK_HOURS), F.lit(1.0)).otherwise(F.lit(-1.0))
    factors = F.array(
        _factor(0, F_MEAN, p, F.col("recent_mean"), p - F.col("recent_mean"), 0.35 * std, -0.35 * std),
        _factor(1, F_PREV, p, F.col("_prev"), p - F.col("_prev"), 0.25 * std, -0.25 * std),
        _factor(2, F_P90, p, F.col("recent_p90"), p - F.col("recent_p90"), F.lit(0.0), -0.75 * std),
        _factor(3, F_PEAK, hour, F.lit(None), peak, F.lit(1.0), F.lit(-1.0), scale=1.0),
    )
    # rows without a timestamp get no peak factor
    factors = F.when(F.col("ts").isNull(), F.slice(factors, 1, 3)).otherwise(factors)
    df = df.withColumn("top_factors", rank_factors(factors))
    risk = (F.when((p >= F.col("recent_p90")) | (p >= F.col("recent_mean") + std), F.lit("high"))
            .when((p >= F.col("recent_p75")) | (p >= F.col("recent_mean") + std * 0.35), F.lit("medium"))
            .otherwise(F.lit("low")))
    df = add_factor_lists(df.withColumn("risk_level", risk), "top_factors")
    return recommendations(df.drop("_prev"), rule_set_name, config)
