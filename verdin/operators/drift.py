"""Drift between a reference and a current dataset (L9), as Spark jobs.

Numeric columns: two-sample Kolmogorov–Smirnov statistic from exact cumulative
distributions.  Both samples are unioned, reduced to one row per distinct value
with a count per side (map-side combine), and the running counts come from the
chunked prefix sum in :mod:`verdin.operators.series`, so no task ever holds a
whole column.  Categorical columns: Jensen–Shannon divergence (base 2) of the
category shares, from one grouped count.

The test choice is ours and documented: KS at α = 0.05 (critical value
1.358·sqrt((n+m)/(n·m))) and JS divergence > 0.1 flag drift.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.operators.series import prefix_sums

KS_C_ALPHA = 1.358
JS_THRESHOLD = 0.1


def _q(c: str):
    return F.col(f"`{c}`")


def ks_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: sizes, KS statistic D, critical value and drift flag."""
    parts = []
    for side, df in (("ref", reference), ("cur", current)):
        parts.append(df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), _q(c).cast("double").alias("v")) for c in columns])).alias("p"))
            .select("p.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
            .withColumn("is_ref", F.lit(side == "ref")))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    counts = u.groupBy("column_name", "v").agg(
        F.count_if(F.col("is_ref")).alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur"))
    cum = prefix_sums(counts, ["column_name"], ["v"], ["c_ref", "c_cur"])
    totals = counts.groupBy("column_name").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    j = cum.join(totals, "column_name")
    # a side without values: nothing to test, statistic and threshold are null and nothing drifted
    gap = F.abs(F.try_divide("cum_c_ref", "n_ref") - F.try_divide("cum_c_cur", "n_cur"))
    d = j.groupBy("column_name", "n_ref", "n_cur").agg(F.max(gap).alias("statistic"))
    crit = F.lit(KS_C_ALPHA) * F.sqrt(F.try_divide(F.col("n_ref") + F.col("n_cur"), F.col("n_ref").cast("double") * F.col("n_cur")))
    return d.select("column_name", "n_ref", "n_cur", F.bround("statistic", 6).alias("statistic"),
                    F.bround(crit, 6).alias("threshold"), F.coalesce(F.col("statistic") > crit, F.lit(False)).alias("drifted"))


def js_divergence(reference: DataFrame, current: DataFrame, columns: Sequence[str], sizes: bool = False) -> DataFrame:
    """Per categorical column: Jensen–Shannon divergence (log base 2) of category shares."""
    parts = []
    for side, df in (("ref", reference), ("cur", current)):
        parts.append(df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("v")) for c in columns])).alias("p"))
            .select("p.*").filter(F.col("v").isNotNull()).withColumn("is_ref", F.lit(side == "ref")))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    counts = u.groupBy("column_name", "v").agg(
        F.count_if(F.col("is_ref")).alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur"))
    # one row per column; no window, so that a column of many categories is summed by many tasks
    totals = counts.groupBy("column_name").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    s = counts.join(F.broadcast(totals), "column_name").withColumn("p", F.try_divide("c_ref", "n_ref")).withColumn("q", F.try_divide("c_cur", "n_cur")) \
        .withColumn("m", (F.col("p") + F.col("q")) / 2)

    def kl(a, m):
        return F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / F.col(m))).otherwise(F.lit(0.0))

    # a side without values has no shares: the divergence is null
    g = s.groupBy("column_name").agg(F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), (0.5 * F.sum(kl("p", "m")) + 0.5 * F.sum(kl("q", "m"))).alias("js"),
                                     F.count(F.lit(1)).alias("categories"))
    js = F.when((F.col("n_ref") > 0) & (F.col("n_cur") > 0), F.col("js"))
    return g.select("column_name", "categories", F.bround(js, 6).alias("js_divergence"),
                    F.coalesce(js > JS_THRESHOLD, F.lit(False)).alias("drifted"), *(["n_ref", "n_cur"] if sizes else []))


def drift_columns(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """L9 + J11 per column: a row for each common column (of ``columns`` where given), tested by its type: numbers by
    KS; text, truth values, dates and times by the divergence of their shares.  Sources of different types are unified
    first.  A column without values on a side is listed as not testable, with the reason."""
    from verdin.operators.merge import unify_types
    from verdin.operators.profile import type_family
    common = [c for c in reference.columns if c in set(current.columns) and (columns is None or c in columns)]
    spark, schema = reference.sparkSession, "column_name string, place int, test string"
    if not common:
        return spark.createDataFrame([], "column_name string, test string, n_ref long, n_cur long, statistic double, drifted boolean, testable boolean, reason string")
    ref, cur = unify_types([reference.select(*[_q(c) for c in common]), current.select(*[_q(c) for c in common])])
    num = [c for c in common if type_family(ref.schema[c].dataType) == "numeric"]
    cat = [c for c in common if c not in num]
    pieces = []
    if num:
        pieces.append(ks_statistics(ref, cur, num).select("column_name", "n_ref", "n_cur", "statistic", "drifted"))
    if cat:
        pieces.append(js_divergence(ref, cur, cat, sizes=True).select("column_name", "n_ref", "n_cur", F.col("js_divergence").alias("statistic"), "drifted"))
    listed = spark.createDataFrame([(c, i, "ks" if c in num else "jensen_shannon") for i, c in enumerate(common)], schema)
    out = listed.join(reduce(DataFrame.unionByName, pieces), "column_name", "left").na.fill(0, ["n_ref", "n_cur"])
    why = F.when((F.col("n_ref") == 0) & (F.col("n_cur") == 0), F.lit("no values on either side")).when(F.col("n_ref") == 0, F.lit("no values in the reference")) \
        .when(F.col("n_cur") == 0, F.lit("no values in the current data"))
    return out.orderBy("place").select("column_name", "test", "n_ref", "n_cur", "statistic", F.coalesce("drifted", F.lit(False)).alias("drifted"),
                                       why.isNull().alias("testable"), why.alias("reason"))


def drift_report(reference: DataFrame, current: DataFrame, numeric: Sequence[str],
                 categorical: Sequence[str]) -> DataFrame:
    """L9 + J11: tests on the common columns; drifted count and share of those that can be tested (null share without any)."""
    tests = drift_columns(reference, current, [*numeric, *categorical]).where("testable")
    return tests.agg(F.count(F.lit(1)).alias("columns_tested"),
                     F.count_if(F.col("drifted")).alias("drifted_columns"),
                     F.bround(F.try_divide(F.count_if(F.col("drifted")), F.count(F.lit(1))), 6).alias("drift_share"))
