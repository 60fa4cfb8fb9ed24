"""Validation, schema/kind inference and dataset profiling.

All per-column statistics come from one long-format pass: every row is unpivoted
into ``(column, value)`` pairs and grouped by ``(column, value)`` with map-side
combine, so a value that fills a third of a column collapses before the shuffle.
Kind, task, identifier and target-score logic then run on the small per-column
table (one row per column) as Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdin.functions.timefuncs import TIME_ONLY_PATTERN, parse_timestamp

# Name hints for targets, identifiers and measurement units.
TARGET_NAME_HINTS = ("target", "label", "class", "y", "result", "outcome", "response",
                     "таргет", "цель", "целе", "класс", "метка")
IDENTIFIER_NAME_HINTS = ("id", "uuid", "guid", "код", "номер", "no")
UNIT_NAME_HINTS = ("unit", "единиц", "измерен")
# Column kinds in display order with their labels.
KIND_ORDER = ("numeric", "categorical", "datetime", "time", "boolean", "text", "empty")
KIND_LABELS = {"numeric": "Числовые", "categorical": "Категориальные", "datetime": "Дата и время",
               "time": "Время", "boolean": "Логические", "text": "Текстовые", "empty": "Пустые"}

NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def type_family(dtype: T.DataType) -> str:
    name = dtype.typeName()
    if name == "boolean":
        return "boolean"
    if name in NUMERIC_TYPES:
        return "numeric"
    if name in ("timestamp", "timestamp_ntz", "date"):
        return "datetime"
    return "string"


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Driver-side schema metadata as a tiny table: (column_name, position, dtype, family)."""
    rows = [(f.name, i, f.dataType.simpleString(), type_family(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, position int, dtype string, family string")


def value_counts_long(df: DataFrame) -> DataFrame:
    """(column_name, value, cnt): one row per distinct value per column (null kept as a value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("value"))
                                for c in df.columns])).alias("p")
    from verdin.session import spread_if_narrow
    long = spread_if_narrow(df).select(pairs).select("p.column_name", "p.value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def column_stats(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Per column: missing, non-null, distinct (raw and trimmed), time and datetime hit counts."""
    vc = value_counts_long(df)
    nn = F.col("value").isNotNull()
    trimmed = F.trim(F.col("value"))
    stats = vc.groupBy("column_name").agg(
        F.sum(F.when(~nn, F.col("cnt")).otherwise(0)).alias("missing_values"),
        F.sum(F.when(nn, F.col("cnt")).otherwise(0)).alias("non_null_values"),
        F.count(F.when(nn, F.lit(1))).alias("distinct_values"),
        F.count_distinct(F.when(nn, trimmed)).alias("distinct_trimmed"),
        F.sum(F.when(nn & trimmed.rlike(TIME_ONLY_PATTERN), F.col("cnt")).otherwise(0)).alias("time_hits"),
        F.sum(F.when(nn & parse_timestamp(F.col("value")).isNotNull(), F.col("cnt")).otherwise(0)).alias("datetime_hits"),
    )
    meta = schema_table(spark, df)
    return meta.join(stats, "column_name", "left").na.fill(0, ["missing_values", "non_null_values", "distinct_values",
                                                               "distinct_trimmed", "time_hits", "datetime_hits"])


def kind_expr() -> Column:
    """V7 on the stats table; time-of-day is tested before datetime (Q2 fix)."""
    nn = F.col("non_null_values")
    fam = F.col("family")
    return (F.when(nn == 0, F.lit("empty"))
            .when(fam == "boolean", F.lit("boolean"))
            .when(fam == "numeric", F.lit("numeric"))
            .when(fam == "datetime", F.lit("datetime"))
            .when(F.col("time_hits") / nn >= 0.8, F.lit("time"))
            .when(F.col("datetime_hits") / nn >= 0.8, F.lit("datetime"))
            .when(F.col("distinct_trimmed") <= F.greatest(F.lit(20), F.floor(nn * 0.2)), F.lit("categorical"))
            .otherwise(F.lit("text")))


def task_type_expr(distinct: Column, non_null: Column, numeric: Column) -> Column:
    """V5: numeric → 2 distinct binary; ≤10 distinct and ratio < 0.2 multiclass; else regression.
    Non-numeric → 2 distinct binary, else multiclass."""
    ratio = distinct / F.greatest(non_null, F.lit(1))
    return (F.when(numeric & (distinct == 2), F.lit("binary"))
            .when(numeric & (distinct <= 10) & (ratio < 0.2), F.lit("multiclass"))
            .when(numeric, F.lit("regression"))
            .when(distinct == 2, F.lit("binary"))
            .otherwise(F.lit("multiclass")))


def _name_is_identifier(name: Column) -> Column:
    n = F.lower(name)
    cond = F.lit(False)
    for h in IDENTIFIER_NAME_HINTS:
        cond = cond | (n == h) | n.endswith(f"_{h}") | n.startswith(f"{h}_")
    return cond


def _name_has_target_hint(name: Column) -> Column:
    n = F.lower(name)
    cond = F.lit(False)
    for h in TARGET_NAME_HINTS:  # substring test, as documented (Q1)
        cond = cond | n.contains(h)
    return cond


def column_profile(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A2 + V5 + V7 + V8 + A3: one row per column with kind, task, identifier flag and target score."""
    s = column_stats(spark, df)
    total = len(df.columns)
    nn, dv = F.col("non_null_values"), F.col("distinct_values")
    ratio = dv / F.greatest(nn, F.lit(1))
    s = s.withColumn("kind", kind_expr()).withColumn("distinct_ratio", F.bround(ratio, 6))
    s = s.withColumn("suggested_task_type", F.when((nn > 0) & (dv >= 2),
                                                    task_type_expr(dv, nn, F.col("family") == "numeric")))
    ident = (_name_is_identifier(F.col("column_name")) | (F.col("kind") == "datetime")
             | ((ratio >= 0.98) & F.col("kind").isin("text", "categorical")))
    s = s.withColumn("looks_like_identifier", ident)
    task = F.col("suggested_task_type")
    score = (F.when(_name_has_target_hint(F.col("column_name")), 70).otherwise(0)
             + F.when(F.col("position") == total - 1, 18).otherwise(0)
             + F.when(task == "regression", 18).when(task.isin("binary", "multiclass"), 16).otherwise(0)
             + F.when(F.col("kind").isin("numeric", "boolean", "categorical"), 10).otherwise(0)
             + F.when(F.col("missing_values") == 0, 6).otherwise(0)
             - F.when(dv < 2, 100).otherwise(0)
             - F.when(F.col("looks_like_identifier"), 50).otherwise(0)
             - F.when(F.col("kind").isin("datetime", "time"), 35).otherwise(0)
             - F.when((ratio > 0.98) & (F.col("kind") == "text"), 20).otherwise(0))
    s = s.withColumn("target_score", score.cast("int"))
    s = s.withColumn("target_eligible", (dv >= 2) & ~F.col("looks_like_identifier")
                     & ~F.col("kind").isin("datetime", "time"))
    return s.drop("family", "distinct_trimmed", "time_hits", "datetime_hits")


def target_ranking(profile: DataFrame) -> DataFrame:
    """A3 ranking: score descending, then lower-cased name.  The profile has one row per
    column, so this window is bounded by the column count."""
    w = Window.orderBy(F.col("target_score").desc(), F.lower("column_name").asc())
    return (profile.select("column_name", "target_score", "target_eligible", "kind", "suggested_task_type")
            .withColumn("rank", F.row_number().over(w))
            .withColumn("recommended", F.col("rank") == 1))


def kind_summary(spark: SparkSession, profile: DataFrame) -> DataFrame:
    """A5: kinds in fixed display order with labels, zero counts omitted."""
    order = spark.createDataFrame([(k, i, KIND_LABELS[k]) for i, k in enumerate(KIND_ORDER)],
                                  "kind string, kind_order int, label string")
    counts = profile.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
    return order.join(counts, "kind", "inner").select("kind", "kind_order", "label", "count")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (NULLs compare equal, as in pandas ``duplicated``)."""
    return df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c")) \
        .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows"))


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two single-row aggregates (both sides are one row by construction)."""
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


def dataset_summary(df: DataFrame, target: str) -> DataFrame:
    """A1 + V1 + V5: rows, columns, missing cells, duplicate rows and target checks in one row."""
    cols = df.columns
    t = _q(target)
    missing = sum((F.count(F.lit(1)) - F.count(_q(c)) for c in cols), F.lit(0))
    numeric = type_family(df.schema[target].dataType) == "numeric"
    main = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_values"),
                  F.count_if(t.isNull()).alias("target_nulls"),
                  F.count_distinct(t).alias("target_distinct"), F.count(t).alias("_tnn"))
    main = main.withColumn("task_type", task_type_expr(F.col("target_distinct"), F.col("_tnn"), F.lit(numeric)))
    out = one_row_join(main, duplicate_rows(df))
    valid = ((F.col("n_rows") > 0) & F.lit(len(cols) >= 2) & F.lit(len(set(cols)) == len(cols))
             & (F.col("target_nulls") == 0) & (F.col("target_distinct") >= 2))
    return out.select(F.lit(target).alias("target"), "n_rows", F.lit(len(cols)).alias("n_columns"),
                      "missing_values", "duplicate_rows", "target_nulls", "target_distinct", "task_type",
                      valid.alias("valid"))


class ValidationError(ValueError):
    pass


def validate_training_frame(df: DataFrame, target: str, min_rows: int = 1) -> None:
    """V1: ordered checks; raises on the first failure.  One aggregate job."""
    cols = df.columns
    if target not in cols:
        raise ValidationError(f"target column {target!r} is missing")
    if len(cols) < 2:
        raise ValidationError("need at least one feature column besides the target")
    if len(set(cols)) != len(cols):
        raise ValidationError("duplicate column names")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(_q(target).isNull()).alias("nulls"),
                 F.count_distinct(_q(target)).alias("d")).first()
    if row["n"] < max(1, min_rows):
        raise ValidationError(f"need at least {max(1, min_rows)} rows")
    if row["nulls"] > 0:
        raise ValidationError("target has missing values")
    if row["d"] < 2:
        raise ValidationError("target needs at least two distinct values")


def align_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """V2: missing features → error; extra columns dropped; columns put in model order."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValidationError(f"missing feature columns: {missing}")
    return df.select(*[_q(f) for f in features])


def resolve_missing_inputs(columns: Sequence[str], required_features: Sequence[str]) -> dict:
    """V3: engineered feature names (``x__hour``) map back to their source column ``x``."""
    present = set(columns)
    missing_features = [f for f in required_features if f not in present]
    sources = []
    for f in missing_features:
        src = f.split("__", 1)[0] if "__" in f else f
        if src not in present and src not in sources:
            sources.append(src)
    extras = [c for c in columns if c not in set(required_features) and c not in
              {f.split("__", 1)[0] for f in required_features}]
    return {"missing_inputs": sources, "missing_features": missing_features, "extra_columns": extras,
            "ready": not sources}


def unit_suggestion(df: DataFrame) -> DataFrame:
    """V9: most frequent non-blank value of the first unit-like column (ties: smallest text)."""
    cands = [c for c in df.columns if any(h in c.lower() for h in UNIT_NAME_HINTS)]
    if not cands:
        return df.sparkSession.createDataFrame([], "unit_column string, suggested_unit string, count long")
    c = cands[0]
    v = F.trim(_q(c).cast("string"))
    counts = (df.select(v.alias("u")).filter(F.col("u").isNotNull() & (F.col("u") != ""))
              .groupBy("u").agg(F.count(F.lit(1)).alias("count")))
    return (counts.orderBy(F.col("count").desc(), F.col("u").asc()).limit(1)
            .select(F.lit(c).alias("unit_column"), F.col("u").alias("suggested_unit"), "count"))


def target_summary_class(df: DataFrame, target: str, top: int = 3) -> DataFrame:
    """A4 (classification): top classes by count (ties by label), share of non-null rows (4 dp)."""
    lab = _q(target).cast("string")
    base = df.filter(_q(target).isNotNull())
    counts = base.groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    totals = base.agg(F.count(F.lit(1)).alias("_total"))
    w = Window.orderBy(F.col("count").desc(), F.col("label").asc())
    # the class table has one row per class; the ranking window over it is bounded by class count
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    out = one_row_join(ranked, totals).withColumn("share", F.bround(F.col("count") / F.col("_total"), 4))
    classes = counts.agg(F.count(F.lit(1)).alias("class_count"), F.max("count").alias("_max"))
    out = one_row_join(out, classes).withColumn("majority_share", F.bround(F.col("_max") / F.col("_total"), 4))
    return out.select(F.lit(target).alias("target"), "rank", "label", "count", "share", "class_count", "majority_share")


def finite(x):
    """The number, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles without buffering a group in one task:
    values are ordered with the chunked series primitive, the two neighbouring
    ordinals of each quantile are kept and interpolated."""
    from verdin.operators.series import sequenced
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    seq = sequenced(clean, list(keys), ["_v"])
    wanted = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    h = F.col("q.p") * (F.col("_n") - 1) + 1
    picked = (seq.select(*keys, "_v", "_pos", "_n", F.explode(wanted).alias("q"))
              .filter((F.col("_pos") == F.floor(h)) | (F.col("_pos") == F.ceil(h))))
    g = picked.groupBy(*keys, F.col("q.qi").alias("qi"), F.col("q.p").alias("p")).agg(
        F.min_by("_v", "_pos").alias("lo"), F.max_by("_v", "_pos").alias("hi"), F.max("_n").alias("_n"))
    hh = F.col("p") * (F.col("_n") - 1) + 1
    return g.withColumn("quantile", F.col("lo") + (hh - F.floor(hh)) * (F.col("hi") - F.col("lo"))) \
        .select(*keys, "qi", "p", "quantile")


def target_summary_numeric(df: DataFrame, target: str) -> DataFrame:
    """A4 (regression): min / max / mean / exact median (6 dp); NaN and infinity count as missing."""
    x = finite(_q(target).try_cast("double"))
    basic = df.select(x.alias("_x")).agg(F.min("_x").alias("min"), F.max("_x").alias("max"),
                                         F.avg("_x").alias("mean"), F.count("_x").alias("non_null_values"))
    med = exact_quantiles(df.select(x.alias("_x")), "_x", [0.5]).select(F.col("quantile").alias("median"))
    out = one_row_join(basic, med)
    return out.select(F.lit(target).alias("target"), "non_null_values",
                      *[F.bround(c, 6).alias(c) for c in ("min", "max", "mean", "median")])


HISTOGRAM_BINS = 30


def target_distribution(df: DataFrame, target: str, task: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Regression → ``bins`` equal-width bins between min and max (max falls in the
    last bin); classification → class counts sorted by count (ties by label).  One
    min/max aggregate (a single row, broadcast) and one grouped count."""
    if task != "regression":
        return (df.filter(_q(target).isNotNull()).groupBy(_q(target).cast("string").alias("label"))
                .agg(F.count(F.lit(1)).alias("count")))
    x = finite(_q(target).try_cast("double"))
    vals = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    rng = vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    j = one_row_join(vals, rng)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    g = j.groupBy(b.cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select("bin", F.bround(F.col("_lo") + w * F.col("bin"), 6).alias("lower"),
                    F.bround(F.col("_lo") + w * (F.col("bin") + 1), 6).alias("upper"), "count")


def example_values(df: DataFrame, order: Sequence[str], k: int = 4) -> DataFrame:
    """A2: of each column the first ``k`` non-null values along ``order`` as text (a row a column, empty for a column of
    nulls).  The rank limit is applied by each task before the shuffle, so a task sends ``k`` values a column."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), _q(c).cast("string").alias("value")) for i, c in enumerate(df.columns)]
    long = df.select(*[_q(c).alias(f"_o{i}") for i, c in enumerate(order)], F.explode(F.array(*cells)).alias("_c")).select("_c.*", *[f"_o{i}" for i in range(len(order))])
    w = Window.partitionBy("position", "column_name").orderBy(*[f"_o{i}" for i in range(len(order))], "value")
    first = long.where(F.col("value").isNotNull()).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    found = first.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda x: x["value"]).alias("example_values"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, column_name string")
    return names.join(found, "column_name", "left").select("position", "column_name", F.coalesce("example_values", F.array().cast("array<string>")).alias("example_values"))


def sample_rows(df: DataFrame, order: Sequence[str], k: int = 12) -> DataFrame:
    """A1: the first ``k`` rows along ``order`` (a top-k, never a sort of the table)."""
    return df.orderBy(*[_q(c) for c in order]).limit(k)


def target_reason(profile: DataFrame) -> DataFrame:
    """A2: the parts of each column's target score in words (``column_name``, ``target_reason``)."""
    task, ratio = F.col("suggested_task_type"), F.col("distinct_ratio")
    why = [F.when(_name_has_target_hint(F.col("column_name")), "named like a target"), F.when(task.isNotNull(), F.concat(F.lit("fits "), task)),
           F.when(F.col("missing_values") == 0, "no missing values"), F.when(F.col("distinct_values") < 2, "one value only"),
           F.when(F.col("looks_like_identifier"), "looks like an identifier"), F.when(F.col("kind").isin("datetime", "time"), "a time column"),
           F.when((ratio > 0.98) & (F.col("kind") == "text"), "nearly all texts differ")]
    return profile.select("column_name", F.concat_ws("; ", *why).alias("target_reason"))


def inspection_summary(spark: SparkSession, df: DataFrame, target: str | None = None,
                       project: DataFrame | None = None) -> dict[str, DataFrame]:
    """A7 (+ A8 when a project summary row is given): the whole upload profile as lazy
    DataFrames — summary, column profile, target ranking, kinds, target summary,
    temporal context of the first datetime column, unit suggestion."""
    from verdin.operators.temporal import temporal_context
    prof = column_profile(spark, df)
    ranking = target_ranking(prof)
    out = {"profile": prof, "ranking": ranking, "kinds": kind_summary(spark, prof), "unit": unit_suggestion(df)}
    chosen = target or ranking.filter("recommended").select("column_name").first()["column_name"]
    out["summary"] = dataset_summary(df, chosen)
    out["reasons"], out["examples"], out["sample"] = target_reason(prof), example_values(df, df.columns[:1]), sample_rows(df, df.columns[:1])
    task = prof.filter(F.col("column_name") == chosen).select("suggested_task_type").first()[0]
    out["target_summary"] = (target_summary_numeric(df, chosen) if task == "regression"
                             else target_summary_class(df, chosen))
    dt_cols = [r["column_name"] for r in prof.filter("kind = 'datetime'").orderBy("position").select("column_name").collect()]
    if dt_cols:
        out["temporal"] = temporal_context(spark, df, dt_cols[0])
    if project is not None:
        out["project"] = project
    return out
