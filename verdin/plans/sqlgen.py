"""Small helpers that write the DuckDB oracle SQL for table-generic operators."""

from __future__ import annotations

# Column layout of the driver tables used by generic oracles: (name, spark dtype, family).
TABLE_COLUMNS = {
    "customer": [("c_custkey", "bigint", "numeric"), ("c_name", "string", "string"),
                 ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"),
                 ("c_mktsegment", "string", "string")],
    "orders": [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
               ("o_orderstatus", "string", "string"), ("o_totalprice", "double", "numeric"),
               ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "string")],
    "part": [("p_partkey", "bigint", "numeric"), ("p_name", "string", "string"), ("p_brand", "string", "string"),
             ("p_type", "string", "string"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")],
    "documents": [("doc_id", "bigint", "numeric"), ("text", "string", "string"), ("lang", "string", "string"),
                  ("source", "string", "string"), ("n_chars", "bigint", "numeric")],
}

TIME_RE = r"^\d{1,2}:\d{2}(:\d{2})?$"
TARGET_HINTS = ("target", "label", "class", "y", "result", "outcome", "response",
                "таргет", "цель", "целе", "класс", "метка")
ID_HINTS = ("id", "uuid", "guid", "код", "номер", "no")


def _ts_parse(expr: str) -> str:
    fmts = ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S",
            "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y",
            "%Y/%m/%d %H:%M:%S", "%Y/%m/%d"]
    lst = ", ".join(f"'{f}'" for f in fmts)
    return f"try_strptime(regexp_replace(trim({expr}), 'Z$', ''), [{lst}])"


def column_stats_sql(table: str) -> str:
    parts = []
    for i, (c, dtype, fam) in enumerate(TABLE_COLUMNS[table]):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS column_name, {i} AS position, '{dtype}' AS dtype, '{fam}' AS family,
  count(*) - count({c}) AS missing_values, count({c}) AS non_null_values,
  count(DISTINCT {c}) AS distinct_values, count(DISTINCT trim({v})) AS distinct_trimmed,
  count(*) FILTER (WHERE regexp_full_match(trim({v}), '{TIME_RE}')) AS time_hits,
  count(*) FILTER (WHERE NOT regexp_full_match(trim({v}), '{TIME_RE}') AND {_ts_parse(v)} IS NOT NULL) AS datetime_hits
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


def column_profile_sql(table: str) -> str:
    total = len(TABLE_COLUMNS[table])
    target_hint = " OR ".join(f"contains(lower(column_name), '{h}')" for h in TARGET_HINTS)
    id_hint = " OR ".join(f"(lower(column_name) = '{h}' OR ends_with(lower(column_name), '_{h}') "
                          f"OR starts_with(lower(column_name), '{h}_'))" for h in ID_HINTS)
    return f"""
WITH s AS ({column_stats_sql(table)}),
k AS (
  SELECT *,
    CASE WHEN non_null_values = 0 THEN 'empty'
         WHEN family = 'boolean' THEN 'boolean'
         WHEN family = 'numeric' THEN 'numeric'
         WHEN family = 'datetime' THEN 'datetime'
         WHEN time_hits / non_null_values >= 0.8 THEN 'time'
         WHEN datetime_hits / non_null_values >= 0.8 THEN 'datetime'
         WHEN distinct_trimmed <= greatest(20, floor(non_null_values * 0.2)) THEN 'categorical'
         ELSE 'text' END AS kind,
    distinct_values / greatest(non_null_values, 1) AS ratio
  FROM s
), t AS (
  SELECT *,
    CASE WHEN non_null_values > 0 AND distinct_values >= 2 THEN
      CASE WHEN family = 'numeric' AND distinct_values = 2 THEN 'binary'
           WHEN family = 'numeric' AND distinct_values <= 10 AND ratio < 0.2 THEN 'multiclass'
           WHEN family = 'numeric' THEN 'regression'
           WHEN distinct_values = 2 THEN 'binary'
           ELSE 'multiclass' END END AS suggested_task_type,
    (({id_hint}) OR kind = 'datetime' OR (ratio >= 0.98 AND kind IN ('text', 'categorical'))) AS looks_like_identifier
  FROM k
)
SELECT column_name, CAST(position AS INTEGER) AS position, dtype, kind, missing_values, non_null_values,
  distinct_values, round_even(ratio, 6) AS distinct_ratio, suggested_task_type, looks_like_identifier,
  CAST((CASE WHEN {target_hint} THEN 70 ELSE 0 END)
   + (CASE WHEN position = {total - 1} THEN 18 ELSE 0 END)
   + (CASE WHEN suggested_task_type = 'regression' THEN 18
           WHEN suggested_task_type IN ('binary', 'multiclass') THEN 16 ELSE 0 END)
   + (CASE WHEN kind IN ('numeric', 'boolean', 'categorical') THEN 10 ELSE 0 END)
   + (CASE WHEN missing_values = 0 THEN 6 ELSE 0 END)
   - (CASE WHEN distinct_values < 2 THEN 100 ELSE 0 END)
   - (CASE WHEN looks_like_identifier THEN 50 ELSE 0 END)
   - (CASE WHEN kind IN ('datetime', 'time') THEN 35 ELSE 0 END)
   - (CASE WHEN ratio > 0.98 AND kind = 'text' THEN 20 ELSE 0 END) AS INTEGER) AS target_score,
  (distinct_values >= 2 AND NOT looks_like_identifier AND kind NOT IN ('datetime', 'time')) AS target_eligible
FROM t
"""


def dataset_summary_sql(table: str, target: str, target_numeric: bool) -> str:
    cols = [c for c, _, _ in TABLE_COLUMNS[table]]
    missing = " + ".join(f"(count(*) - count({c}))" for c in cols)
    if target_numeric:
        task = """CASE WHEN target_distinct = 2 THEN 'binary'
      WHEN target_distinct <= 10 AND target_distinct / greatest(tnn, 1) < 0.2 THEN 'multiclass'
      ELSE 'regression' END"""
    else:
        task = "CASE WHEN target_distinct = 2 THEN 'binary' ELSE 'multiclass' END"
    return f"""
WITH m AS (
  SELECT count(*) AS n_rows, {missing} AS missing_values, count(*) - count({target}) AS target_nulls,
         count(DISTINCT {target}) AS target_distinct, count({target}) AS tnn
  FROM {table}
), d AS (
  SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM {table} GROUP BY {", ".join(cols)})
)
SELECT '{target}' AS target, n_rows, {len(cols)} AS n_columns, missing_values, duplicate_rows, target_nulls,
  target_distinct, {task} AS task_type,
  (n_rows > 0 AND target_nulls = 0 AND target_distinct >= 2) AS valid
FROM m, d
"""


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def condition_sql(conditions: dict, fields: set[str]) -> str:
    """SQL form of the rule condition language (for oracles): *_min / *_max numeric
    bounds (null fails), *_in membership, *_equals and bare keys equality."""
    parts = []
    for key, expected in conditions.items():
        if key.endswith("_min") or key.endswith("_max"):
            f = key[:-4]
            op = ">=" if key.endswith("_min") else "<="
            parts.append(f"({f} IS NOT NULL AND CAST({f} AS DOUBLE) {op} {float(expected)!r})" if f in fields
                         else "FALSE")
        elif key.endswith("_in"):
            f = key[:-3]
            vals = expected if isinstance(expected, list) else [expected]
            lits = ", ".join(_sql_lit(v) for v in vals if v is not None)
            parts.append(f"coalesce({f} IN ({lits}), FALSE)" if f in fields and lits else "FALSE")
        else:
            f = key[:-7] if key.endswith("_equals") else key
            parts.append((f"{f} IS NULL" if expected is None else f"coalesce({f} = {_sql_lit(expected)}, FALSE)")
                         if f in fields else ("TRUE" if expected is None else "FALSE"))
    return " AND ".join(parts) if parts else "TRUE"


def rule_case_sql(rule_set_name: str, attr: str, fields: set[str]) -> str:
    """CASE expression returning ``attr`` (rule_id / scenario / summary) of the first
    matching rule ordered by (priority, rule_id) descending."""
    from verdin.operators.rulesets import RULE_SETS
    rules = sorted(RULE_SETS[rule_set_name]["rules"], key=lambda r: (int(r.get("priority", 0)), str(r["rule_id"])),
                   reverse=True)
    whens = " ".join(f"WHEN {condition_sql(r.get('conditions', {}), fields)} THEN {_sql_lit(r[attr])}" for r in rules)
    return f"CASE {whens} END"
