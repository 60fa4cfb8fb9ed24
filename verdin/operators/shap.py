"""Kernel SHAP as a distributed job.

rows × coalitions × background rows are generated with ``explode`` over two
arrays (coalition masks, ≤ 20 background rows — both bounded by
construction) and scored in ONE model transform.  Values are mixed raw, each column in its own type
(number, text, time, date), before any projection or encoding of the model.  All rows share the masks and
weights, so the constrained weighted least-squares solution is one fixed matrix, computed
once on the driver (M × at most ``nsamples``): a SHAP value is a weighted sum of
scores, taken by one grouped aggregate per row in built-in expressions.  All
coalitions are enumerated when 2^M − 2 ≤ nsamples (exact Shapley values for the
background distribution); otherwise the smallest and largest coalitions are enumerated
with their kernel weights and the rest of the kernel's mass goes to seeded pairs of a
coalition and its complement.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.operators.profile import type_family

MAX_BACKGROUND = 20


def default_nsamples(m: int) -> int:
    """Fixed rule: min(100, 2M + 20) coalition evaluations."""
    return min(100, 2 * m + 20)


def kernel_weight(m: int, s: int) -> float:
    return (m - 1) / (math.comb(m, s) * s * (m - s))


def coalitions(m: int, nsamples: int, seed: int = 42) -> list[tuple[list[bool], float]]:
    """Non-trivial coalitions with kernel weights, at most ``nsamples``: sizes s and m − s are
    enumerated, the heaviest first, while all their coalitions fit; then coalitions of the other
    sizes are drawn with their complements, by kernel mass, and share that mass by times drawn."""
    if m < 2:
        return []
    out, left = [], nsamples
    sizes = list(range(1, m // 2 + 1))          # a size stands for its complement too
    while sizes:
        s = sizes[0]
        both = {s, m - s}
        number = sum(math.comb(m, x) for x in both)
        if number > left:
            break
        out += [([j in members for j in range(m)], kernel_weight(m, x))
                for x in sorted(both) for members in itertools.combinations(range(m), x)]
        left -= number
        sizes.pop(0)
    if not sizes or left < 2:
        return out
    mass = np.array([len({s, m - s}) * (m - 1) / (s * (m - s)) for s in sizes])
    rng = np.random.default_rng(seed)
    drawn: dict = {}
    for _ in range(20 * nsamples):
        if len(drawn) + 2 > left:
            break
        s = int(rng.choice(sizes, p=mass / mass.sum()))
        mask = np.zeros(m, bool)
        mask[rng.choice(m, size=s, replace=False)] = True
        for z in (mask, ~mask):
            drawn[tuple(z.tolist())] = drawn.get(tuple(z.tolist()), 0) + 1
    times = sum(drawn.values())
    return out + [(list(z), float(mass.sum()) * n / times) for z, n in drawn.items()]


def solution(m: int, coal: list[tuple[list[bool], float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, a, t): the SHAP values are A·v − a·base + t·(f(x) − base), where v are the coalition
    values.  The last feature is eliminated by Σφ = f(x) − base; the rest is least squares."""
    if m == 1:
        return np.zeros((1, 0)), np.zeros(1), np.ones(1)
    z = np.array([mask for mask, _ in coal], float)
    root = np.sqrt(np.array([w for _, w in coal]))[:, None]
    head = np.linalg.pinv((z[:, :-1] - z[:, [-1]]) * root) * root.T
    matrix = np.vstack([head, -head.sum(axis=0)])
    total = -matrix @ z[:, -1]
    total[-1] += 1.0
    return matrix, matrix.sum(axis=1), total


def kernel_shap(rows: DataFrame, background: DataFrame, features: Sequence[str], id_col: str,
                score: Callable[[DataFrame], DataFrame], nsamples: int | None = None, seed: int = 42) -> DataFrame:
    """Per row and feature: SHAP value of ``score`` (a function adding a ``score`` column),
    with base value E[f(background)] and the row's prediction f(x)."""
    features = list(features)
    m = len(features)
    # numbers as doubles; text, times and dates keep their type, so ``score`` gets what it gets for whole rows
    typed = {f: F.col(f"`{f}`").cast("double") if type_family(rows.schema[f].dataType) in ("numeric", "boolean") else
             F.col(f"`{f}`").cast(rows.schema[f].dataType) for f in features}
    bg_df = background.select(*[c.alias(f) for f, c in typed.items()]).limit(MAX_BACKGROUND).checkpoint(eager=True)   # ≤ 20 rows
    n_bg = bg_df.count()
    if not n_bg:
        raise ValueError("background sample is empty")
    coal = coalitions(m, nsamples or default_nsamples(m), seed)
    matrix, of_base, of_total = solution(m, coal)
    # the full coalition, scored with one background row alone, is the row's own prediction
    full = len(coal)
    every = [mask for mask, _ in coal] + [[True] * m]
    masks = F.array(*[F.struct(F.lit(i).alias("cid"), F.array(*[F.lit(b) for b in mask]).alias("mask"))
                      for i, mask in enumerate(every)])
    from verdin.operators.ml import balanced
    from verdin.operators.profile import one_row_join
    # spread rows before the ×(coalitions × background) expansion so every core scores
    base_rows = balanced(rows.select(F.col(f"`{id_col}`").alias("row_id"), *[c.alias(f) for f, c in typed.items()]), "row_id")
    sample = bg_df.agg(F.collect_list(F.struct(*[F.col(f"`{f}`") for f in features])).alias("__bgs"))    # one row
    own = [F.col(f"`{f}`") for f in features]
    # internal names start with "__" so they cannot collide with feature names
    synth = (one_row_join(base_rows, sample).select("row_id", *own, "__bgs", F.explode(masks).alias("__coal"))
             .select("row_id", "__coal", *own, F.posexplode("__bgs").alias("__at", "__bg"))
             .where((F.col("__coal.cid") < full) | (F.col("__at") == 0)))
    mixed = synth.select("row_id", F.col("__coal.cid").alias("cid"),
                         *[F.when(F.col("__coal.mask")[j], F.col(f"`{f}`")).otherwise(F.col("__bg")[f]).alias(f)
                           for j, f in enumerate(features)])
    base = score(bg_df).agg(F.avg("score").alias("base"))

    def weighed(j):
        weights = F.array(*[F.lit(float(x) / n_bg) for x in matrix[j]], F.lit(0.0))
        return F.sum(F.col("score") * F.get(weights, F.col("cid"))).alias(f"__v{j}")

    sums = score(mixed).groupBy("row_id").agg(F.max(F.when(F.col("cid") == full, F.col("score"))).alias("fx"),
                                              *[weighed(j) for j in range(m)])
    j = one_row_join(sums, base)
    each = [F.struct(F.lit(f).alias("feature"),
                     (F.col(f"__v{i}") - F.lit(float(of_base[i])) * F.col("base")
                      + F.lit(float(of_total[i])) * (F.col("fx") - F.col("base"))).alias("shap_value"))
            for i, f in enumerate(features)]
    return (j.select("row_id", "base", "fx", F.explode(F.array(*each)).alias("__e"))
            .select("row_id", "__e.feature", "__e.shap_value", F.col("base").alias("base_value"),
                    F.col("fx").alias("prediction")))


def shap_top_factors(shap_values: DataFrame, rows: DataFrame, id_col: str, background_first: dict | None = None,
                     k: int = 5) -> DataFrame:
    """K1: per row the k largest |SHAP| values (ties by feature order), zeros dropped after
    picking; each factor carries value and first background value (as numbers, null where they are none, and as
    text), direction, strength, impact |φ| and φ (6 dp).  The per-row list holds one entry per feature (bounded)."""
    from verdin.functions.numeric import strength
    feats = [r["feature"] for r in shap_values.select("feature").distinct().orderBy("feature").collect()]
    order = {f: i for i, f in enumerate(feats)}
    idx = F.create_map(*[x for f, i in order.items() for x in (F.lit(f), F.lit(i))])
    vals = rows.select(F.col(id_col).alias("row_id"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), _number(rows, f).alias("value"), F.col(f"`{f}`").cast("string").alias("value_text")) for f in feats])).alias("v")) \
        .select("row_id", "v.*")
    j = shap_values.join(vals, ["row_id", "feature"])
    first = background_first or {}
    base = F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(first.get(f) if isinstance(first.get(f), (int, float)) else None).cast("double"))])
    told = F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(None if first.get(f) is None else str(first.get(f))).cast("string"))])
    item = F.struct((-F.abs("shap_value")).alias("_k"), idx[F.col("feature")].alias("_i"), F.col("feature"),
                    F.col("value"), base[F.col("feature")].alias("baseline"), F.col("value_text"), told[F.col("feature")].alias("baseline_text"),
                    F.when(F.col("shap_value") >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
                    strength(F.abs("shap_value")).alias("strength"),
                    F.bround(F.abs("shap_value"), 6).alias("impact_score"),
                    F.bround("shap_value", 6).alias("shap_value"))
    g = j.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    top = F.filter(F.slice("_all", 1, k), lambda f: f["shap_value"] != 0)
    return g.select("row_id", F.transform(top, lambda f: f.dropFields("_k", "_i")).alias("top_factors"))


def _number(rows: DataFrame, f: str):
    numeric = type_family(rows.schema[f].dataType) in ("numeric", "boolean")
    return F.col(f"`{f}`").cast("double") if numeric else F.lit(None).cast("double")


def explain_rows(model, rows: DataFrame, background: DataFrame, features, id_col: str, score,
                 proxy) -> tuple[str, DataFrame, str | None]:
    """E1 with the documented fallback: Kernel SHAP unless the task is multiclass; any
    failure (checked by materializing the result) falls back to the proxy method E2.  Returns the
    method, the factors and why it fell back (None where it did not)."""
    reason = "Kernel SHAP explains one score; a multiclass model has several"
    if getattr(model, "task_type", None) != "multiclass":
        try:
            vals = kernel_shap(rows, background, features, id_col, score).checkpoint(eager=True)
            first = {f: r[f] for r in background.limit(1).collect() for f in features}
            return "shap-kernel", shap_top_factors(vals, rows, id_col, first), None
        except Exception as exc:  # noqa: BLE001 — any failure selects the fallback, and is told
            reason = f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"
    return "proxy-feature-impact", proxy(), reason
