"""Inline decision queries: proxy explanations, facts, rule matching, recommendations
(E2, A9, K1/K2, D1–D8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import decide, explain
from verdin.operators.rulesets import RULE_SETS
from verdin.plans.registry import register
from verdin.plans.sqlgen import rule_case_sql
from verdin.sources.tables import table

# Stand-in stored model metadata: feature importances (as a trained bundle would carry).
LINE_IMPORTANCES = {"l_quantity": 0.45, "l_discount": 0.25, "l_tax": 0.1, "l_returnflag": 0.15, "l_linestatus": 0.05}
LINE_NUMERIC = ("l_quantity", "l_discount", "l_tax")
LINE_CATEGORICAL = ("l_returnflag", "l_linestatus")
DOC_IMPORTANCES = {"kchars": 0.6, "lang": 0.25, "source": 0.15}


def _names(col: str, pred) -> F.Column:
    return F.concat_ws(",", F.transform(F.filter(col, pred), lambda f: f["feature"]))


def _factor_summary(df: DataFrame) -> list:
    # struct-field extraction from an array (no lambdas): stays inside whole-stage codegen
    return [F.concat_ws("|", F.col("top_factors.feature")).alias("factor_order"),
            F.coalesce(F.array_max(F.col("top_factors.impact_score")), F.lit(0.0)).alias("top_impact")]


@register("proxy_impact", """
WITH m AS (SELECT round_even(avg(l_quantity), 6) AS mq, round_even(avg(l_discount), 6) AS md,
                  round_even(avg(l_tax), 6) AS mt FROM lineitem),
mr AS (SELECT l_returnflag AS v FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ml AS (SELECT l_linestatus AS v FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
r AS (
  SELECT l.l_orderkey, l.l_linenumber,
    abs(l_quantity - mq) * 0.45 AS r0, CASE WHEN l_quantity - mq >= 0 THEN 'positive' ELSE 'negative' END AS d0,
    abs(l_discount - md) * 0.25 AS r1, CASE WHEN l_discount - md >= 0 THEN 'positive' ELSE 'negative' END AS d1,
    abs(l_tax - mt) * 0.1 AS r2, CASE WHEN l_tax - mt >= 0 THEN 'positive' ELSE 'negative' END AS d2,
    CASE WHEN l_returnflag IS DISTINCT FROM mr.v THEN 0.15 ELSE 0.15 * 0.2 END AS r3,
    CASE WHEN l_returnflag IS DISTINCT FROM mr.v THEN 'positive' ELSE 'neutral' END AS d3,
    CASE WHEN l_linestatus IS DISTINCT FROM ml.v THEN 0.05 ELSE 0.05 * 0.2 END AS r4,
    CASE WHEN l_linestatus IS DISTINCT FROM ml.v THEN 'positive' ELSE 'neutral' END AS d4
  FROM lineitem l, m, mr, ml),
f AS (SELECT l_orderkey, l_linenumber, list_sort(list_filter([
    {'k': -round_even(r0, 6), 'i': 0, 'f': 'l_quantity', 'd': d0, 's': CASE WHEN r0 >= 0.66 THEN 'strong' WHEN r0 >= 0.33 THEN 'medium' ELSE 'weak' END},
    {'k': -round_even(r1, 6), 'i': 1, 'f': 'l_discount', 'd': d1, 's': CASE WHEN r1 >= 0.66 THEN 'strong' WHEN r1 >= 0.33 THEN 'medium' ELSE 'weak' END},
    {'k': -round_even(r2, 6), 'i': 2, 'f': 'l_tax', 'd': d2, 's': CASE WHEN r2 >= 0.66 THEN 'strong' WHEN r2 >= 0.33 THEN 'medium' ELSE 'weak' END},
    {'k': -round_even(r3, 6), 'i': 3, 'f': 'l_returnflag', 'd': d3, 's': CASE WHEN r3 >= 0.66 THEN 'strong' WHEN r3 >= 0.33 THEN 'medium' ELSE 'weak' END},
    {'k': -round_even(r4, 6), 'i': 4, 'f': 'l_linestatus', 'd': d4, 's': CASE WHEN r4 >= 0.66 THEN 'strong' WHEN r4 >= 0.33 THEN 'medium' ELSE 'weak' END}
  ], lambda x: x.k < 0)) AS fs FROM r)
SELECT l_orderkey, l_linenumber,
  array_to_string(list_transform(fs[1:5], lambda x: x.f), '|') AS factor_order,
  coalesce(-list_min(list_transform(fs[1:5], lambda x: x.k)), 0.0) AS top_impact,
  len(list_filter(fs[1:5], lambda x: x.d = 'positive' AND x.s = 'strong')) AS strong_positive_count,
  len(list_filter(fs[1:5], lambda x: x.d = 'positive' AND x.s = 'medium')) AS medium_positive_count,
  len(list_filter(fs[1:5], lambda x: x.d = 'negative')) AS negative_count
FROM f
""")
def proxy_impact(spark: SparkSession, sf: str) -> DataFrame:
    """E2 + A9 + K2 over every line item: impact of each feature against the training
    means/modes, weighted by stored importances; top 5 with counts."""
    li = table(spark, sf, "lineitem")
    profile = explain.baseline_profile(li, LINE_NUMERIC, LINE_CATEGORICAL, digits=6)
    x = explain.proxy_impact(li.select("l_orderkey", "l_linenumber", *LINE_NUMERIC, *LINE_CATEGORICAL), profile,
                             LINE_IMPORTANCES, LINE_NUMERIC, LINE_CATEGORICAL)
    return x.select("l_orderkey", "l_linenumber", *_factor_summary(x),
                    F.col("strong_positive_count").cast("long").alias("strong_positive_count"),
                    F.col("medium_positive_count").cast("long").alias("medium_positive_count"),
                    F.col("negative_count").cast("long").alias("negative_count"))


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored by a stand-in binary model (long documents → class 1) with a
    distance-based confidence, explained by proxy impact (E2)."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("kchars"), "lang", "source")
    d = (d.withColumn("prediction", (F.col("kchars") >= 2.0).cast("int"))
         .withColumn("confidence", F.bround(F.least(F.lit(0.99), 0.5 + F.abs(F.col("kchars") - 2.0) / 20.0), 6)))
    profile = explain.baseline_profile(d, ["kchars"], ["lang", "source"], digits=6)
    return explain.proxy_impact(d, profile, DOC_IMPORTANCES, ["kchars"], ["lang", "source"])


def inline_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Score → explain → facts → rule (inline_default), one projection chain."""
    facts = decide.build_facts(scored_documents(spark, sf), "binary")
    return decide.recommendations(facts, "inline_default")


_DOC_SQL = """
WITH d AS (SELECT doc_id, n_chars / 1000.0 AS kchars, lang, source FROM documents),
p AS (SELECT round_even(avg(kchars), 6) AS mk FROM d),
pl AS (SELECT lang AS v FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ps AS (SELECT source AS v FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s AS (
  SELECT doc_id, CAST(kchars >= 2.0 AS INTEGER) AS prediction,
    round_even(least(0.99, 0.5 + abs(kchars - 2.0) / 20.0), 6) AS confidence,
    abs(kchars - mk) * 0.6 AS r0, CASE WHEN kchars - mk >= 0 THEN 'positive' ELSE 'negative' END AS d0,
    CASE WHEN lang IS DISTINCT FROM pl.v THEN 0.25 ELSE 0.25 * 0.2 END AS r1,
    CASE WHEN lang IS DISTINCT FROM pl.v THEN 'positive' ELSE 'neutral' END AS d1,
    CASE WHEN source IS DISTINCT FROM ps.v THEN 0.15 ELSE 0.15 * 0.2 END AS r2,
    CASE WHEN source IS DISTINCT FROM ps.v THEN 'positive' ELSE 'neutral' END AS d2
  FROM d, p, pl, ps),
f AS (SELECT doc_id, prediction, confidence, list_sort(list_filter([
    {'k': -round_even(r0, 6), 'i': 0, 'f': 'kchars', 'd': d0, 's': CASE WHEN r0 >= 0.66 THEN 'strong' WHEN r0 >= 0.33 THEN 'medium' ELSE 'weak' END},
    {'k': -round_even(r1, 6), 'i': 1, 'f': 'lang', 'd': d1, 's': CASE WHEN r1 >= 0.66 THEN 'strong' WHEN r1 >= 0.33 THEN 'medium' ELSE 'weak' END},
    {'k': -round_even(r2, 6), 'i': 2, 'f': 'source', 'd': d2, 's': CASE WHEN r2 >= 0.66 THEN 'strong' WHEN r2 >= 0.33 THEN 'medium' ELSE 'weak' END}
  ], lambda x: x.k < 0)) AS fs FROM s),
g AS (SELECT doc_id, prediction, confidence, fs,
    CASE WHEN CAST(prediction AS VARCHAR) IN ('1', 'true', 'yes', 'high', 'risk', 'failure', 'positive', 'anomaly')
         THEN confidence ELSE 1 - confidence END AS score,
    list_transform(list_filter(fs, lambda x: x.d = 'positive' AND x.s = 'strong'), lambda x: x.f) AS sp,
    list_transform(list_filter(fs, lambda x: x.d = 'positive' AND x.s = 'medium'), lambda x: x.f) AS mp,
    list_transform(list_filter(fs, lambda x: x.d = 'negative'), lambda x: x.f) AS ng
  FROM f),
h AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS risk_level,
    len(sp) AS strong_positive_count, len(mp) AS medium_positive_count, len(ng) AS negative_count FROM g)"""

_FIELDS = {"risk_level", "strong_positive_count", "medium_positive_count", "negative_count", "prediction",
           "confidence"}


@register("facts", _DOC_SQL + """
SELECT doc_id, prediction, confidence, risk_level, strong_positive_count, medium_positive_count, negative_count,
  array_to_string(sp, ',') AS strong_positive_factors, array_to_string(ng, ',') AS negative_factors FROM h
""")
def facts(spark: SparkSession, sf: str) -> DataFrame:
    """D1 + D2 on scored, explained documents."""
    f = decide.build_facts(scored_documents(spark, sf), "binary")
    return f.select("doc_id", "prediction", "confidence", "risk_level",
                    F.col("strong_positive_count").cast("long").alias("strong_positive_count"),
                    F.col("medium_positive_count").cast("long").alias("medium_positive_count"),
                    F.col("negative_count").cast("long").alias("negative_count"),
                    F.concat_ws(",", "strong_positive_factors").alias("strong_positive_factors"),
                    F.concat_ws(",", "negative_factors").alias("negative_factors"))


@register("rule_match_inline", _DOC_SQL + f"""
SELECT doc_id, risk_level, {rule_case_sql("inline_default", "rule_id", _FIELDS)} AS rule_id,
  {rule_case_sql("inline_default", "scenario", _FIELDS)} AS scenario_id FROM h
""")
def rule_match_inline(spark: SparkSession, sf: str) -> DataFrame:
    """D3 + D4: first matching inline_default rule per document."""
    return inline_decisions(spark, sf).select("doc_id", "risk_level", "rule_id", "scenario_id")


_ACTIONS = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in RULE_SETS["inline_default"]["scenarios"].items())


@register("recommendations", _DOC_SQL + f"""
, k AS (SELECT *, {rule_case_sql("inline_default", "rule_id", _FIELDS)} AS rule_id,
  {rule_case_sql("inline_default", "scenario", _FIELDS)} AS scenario_id,
  {rule_case_sql("inline_default", "summary", _FIELDS)} AS summary FROM h)
SELECT doc_id, risk_level, rule_id, 'inline_default' AS rule_set, scenario_id, summary,
  CAST(CASE scenario_id {_ACTIONS} END AS INTEGER) AS n_actions,
  CASE WHEN len(sp) = 0 AND len(ng) = 0 THEN '{decide.RATIONALE_NONE}'
       ELSE concat_ws(' | ', CASE WHEN len(sp) > 0 THEN '{decide.RATIONALE_STRONG}' || array_to_string(sp, ', ') END,
                             CASE WHEN len(ng) > 0 THEN '{decide.RATIONALE_NEGATIVE}' || array_to_string(ng, ', ') END)
  END AS rationale
FROM k
""")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """D7 + D8: full recommendation rows for every document."""
    r = inline_decisions(spark, sf)
    return r.select("doc_id", "risk_level", "rule_id", "rule_set", "scenario_id", "summary",
                    F.size("actions").alias("n_actions"), F.concat_ws(" | ", "rationale").alias("rationale"))
