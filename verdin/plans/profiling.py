"""Profiling queries: summary, column profile, target ranking, kinds, target summaries, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import profile as P
from verdin.plans.registry import register
from verdin.plans.sqlgen import column_profile_sql, dataset_summary_sql
from verdin.sources.tables import table


@register("dataset_summary", dataset_summary_sql("orders", "o_orderpriority", False))
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + V1 + V5 on orders with target o_orderpriority."""
    return P.dataset_summary(table(spark, sf, "orders"), "o_orderpriority")


@register("dataset_summary_documents", dataset_summary_sql("documents", "lang", False))
def dataset_summary_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on whole documents (long texts, exact and near copies) with target lang."""
    return P.dataset_summary(table(spark, sf, "documents"), "lang")


@register("column_profile", column_profile_sql("customer"))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A2 + V5 + V7 + V8 + A3 score on customer."""
    return P.column_profile(spark, table(spark, sf, "customer"))


@register("column_profile_orders", column_profile_sql("orders"))
def column_profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A2 on orders (typed datetime column, low-cardinality strings)."""
    return P.column_profile(spark, table(spark, sf, "orders"))


@register("target_ranking", f"""
WITH p AS ({column_profile_sql("customer")})
SELECT column_name, target_score, target_eligible, kind, suggested_task_type,
  row_number() OVER (ORDER BY target_score DESC, lower(column_name) ASC) AS rank,
  row_number() OVER (ORDER BY target_score DESC, lower(column_name) ASC) = 1 AS recommended
FROM p
""")
def target_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A3: rank customer columns as target candidates."""
    return P.target_ranking(P.column_profile(spark, table(spark, sf, "customer")))


_KIND_VALUES = ", ".join(f"('{k}', {i}, '{P.KIND_LABELS[k]}')" for i, k in enumerate(P.KIND_ORDER))


@register("kind_summary", f"""
WITH p AS ({column_profile_sql("part")}),
o(kind, kind_order, label) AS (VALUES {_KIND_VALUES})
SELECT o.kind, CAST(o.kind_order AS INTEGER) AS kind_order, o.label, count(*) AS count
FROM p JOIN o ON p.kind = o.kind GROUP BY o.kind, o.kind_order, o.label
""")
def kind_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A5: kind histogram of part's columns in fixed order."""
    return P.kind_summary(spark, P.column_profile(spark, table(spark, sf, "part")))


@register("target_summary_class", """
WITH c AS (SELECT CAST(o_orderpriority AS VARCHAR) AS label, count(*) AS count FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS total FROM orders WHERE o_orderpriority IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, label ASC) AS rank FROM c)
SELECT 'o_orderpriority' AS target, rank, label, count, round_even(count / total, 4) AS share,
  (SELECT count(*) FROM c) AS class_count, round_even((SELECT max(count) FROM c) / total, 4) AS majority_share
FROM r, t WHERE rank <= 3
""")
def target_summary_class(spark: SparkSession, sf: str) -> DataFrame:
    """A4 classification summary of o_orderpriority."""
    return P.target_summary_class(table(spark, sf, "orders"), "o_orderpriority")


@register("target_summary_numeric", """
SELECT 'o_totalprice' AS target, count(o_totalprice) AS non_null_values,
  round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max,
  round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median
FROM orders
""")
def target_summary_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """A4 regression summary of o_totalprice with an exact distributed median."""
    return P.target_summary_numeric(table(spark, sf, "orders"), "o_totalprice")


@register("unit_suggestion", """
SELECT 'unit' AS unit_column, trim(event_type) AS suggested_unit, count(*) AS count
FROM events WHERE event_type IS NOT NULL AND trim(event_type) <> ''
GROUP BY 2 ORDER BY count DESC, suggested_unit ASC LIMIT 1
""")
def unit_suggestion(spark: SparkSession, sf: str) -> DataFrame:
    """V9 on events with event_type presented as the unit column."""
    ev = table(spark, sf, "events").select("event_id", "ts", "value", F.col("event_type").alias("unit"))
    return P.unit_suggestion(ev)


@register("target_histogram", """
WITH v AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 30)), 29) ELSE 0 END AS INTEGER) AS bin,
             lo, hi FROM v, r)
SELECT bin, round_even(lo + (hi - lo) / 30 * bin, 6) AS lower, round_even(lo + (hi - lo) / 30 * (bin + 1), 6) AS upper,
  count(*) AS count FROM b GROUP BY bin, lo, hi
""")
def target_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A11 (regression): 30 equal-width bins of o_totalprice."""
    return P.target_distribution(table(spark, sf, "orders"), "o_totalprice", "regression")


@register("target_classes", """
SELECT CAST(o_orderpriority AS VARCHAR) AS label, count(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def target_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A11 (classification): class counts of o_orderpriority."""
    return P.target_distribution(table(spark, sf, "orders"), "o_orderpriority", "multiclass")


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "blank")


@register("column_examples", "WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 3 THEN 'seven' END AS blank FROM orders), u AS ("
          + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column_name, o_orderkey, CAST({c} AS VARCHAR) AS value FROM o WHERE {c} IS NOT NULL"
                               for i, c in enumerate(_ORDER_COLUMNS) if c != "o_totalprice")
          + """), r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY o_orderkey) AS k FROM u)
SELECT position, column_name, string_agg(value, '|' ORDER BY k) AS example_values FROM r WHERE k <= 4 GROUP BY position, column_name""")
def column_examples(spark: SparkSession, sf: str) -> DataFrame:
    """A2: the first four values of each column of orders along its key (the price is left to the tests: engines print doubles differently)."""
    o = table(spark, sf, "orders").withColumn("blank", F.when(F.col("o_orderkey") % 7 == 3, "seven"))
    return P.example_values(o, ["o_orderkey"]).where("column_name <> 'o_totalprice'").select("position", "column_name", F.array_join("example_values", "|").alias("example_values"))


@register("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 12")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A1: the first twelve orders along their key."""
    return P.sample_rows(table(spark, sf, "orders"), ["o_orderkey"])
