"""Ordered-series primitive and the window operators built on it.

Why not ``Window.partitionBy(series)``: one series may hold a third of all rows,
and an unpartitioned window collapses onto one task.  :func:`sequenced` instead
cuts a hot series between quantiles of its order into many chunks of like size,
numbers rows inside each chunk, turns per-chunk counts into global ordinals, and
hands every chunk a *halo* with the ``halo`` rows that precede it.  Lag and
rolling windows of reach ≤ ``halo`` then run per chunk, exactly as if the whole
series were one window, and halo rows are dropped afterwards.

Shuffles: partial counts per series, quantiles of the series over ``chunk_rows`` rows, one
hash exchange on ``(keys, chunk)``, a tiny aggregate over ``(keys, chunk)`` counts and
one exchange after the halo union.
Nothing is broadcast by hint; AQE may broadcast the count table at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Autoregressive lag and rolling-window candidates (positions) and history tail.
LAG_CANDIDATES = (1, 2, 3, 6, 12, 24, 48)
ROLLING_CANDIDATES = (3, 6, 12, 24, 48)
HISTORY_TAIL_ROWS = 240

_HELPERS = ("_chunk", "_lrn", "_lcnt", "_offset", "_crank", "_halo")
DEFAULT_CHUNK_ROWS = 1_000_000


#: Quantiles that bound the slices of a hot series, and the rank error allowed to them (1 in ACCURACY).
SLICES, ACCURACY = 128, 10_000
_EXACT = ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def _order_number(c: str, dtype) -> Column:
    """A double that never decreases along the order of ``c``.  Text: its first six bytes; types
    without a number: one constant, so that they stay in one chunk."""
    name = dtype.typeName()
    if name in ("timestamp", "timestamp_ntz", "date"):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"),
                                F.col(c).cast("timestamp_ntz")).cast("double")
    if name in ("string", "varchar", "char", "binary"):
        head = F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if name in _EXACT or name == "decimal":
        return F.col(c).cast("double")
    return F.when(F.col(c).isNotNull(), F.lit(0.0))


def _with_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each column ``n`` of ``names``, ``_c<n>``: its cell among the sorted bounds ``_b<n>`` (how many of them are not above
    it, by bisection), ``_from<n>`` and ``_to<n>``, the ends of that cell; and ``_below``: how many bounds are below the first of them
    (the place of the first bound like the one that it equals).  A projection a step, which compiles (while the method of the whole
    stage keeps under 8000 bytes, the JVM's limit); a higher-order function would be interpreted."""
    out = df.withColumns({f"_c{n}": F.lit(0) for n in names})
    for k in range(1, SLICES.bit_length()):
        width = SLICES >> k
        out = out.withColumns({f"_c{n}": F.col(f"_c{n}") + F.when(F.get(F.col(f"_b{n}"), F.col(f"_c{n}") + F.lit(width - 1)) <= F.col(n), F.lit(width)).otherwise(F.lit(0))
                               for n in names})

    ends = {}
    for n in names:
        c, bounds = F.col(f"_c{n}"), F.col(f"_b{n}")
        ends[f"_from{n}"] = F.when(c == 0, F.col(f"_lo{n}")).otherwise(F.get(bounds, c - 1))
        ends[f"_to{n}"] = F.when(c == SLICES - 1, F.col(f"_hi{n}")).otherwise(F.get(bounds, c))
    c = F.col(f"_c{names[0]}")
    return out.withColumns(ends | {"_below": F.when(F.get(F.col(f"_b{names[0]}"), c - 1) == F.col(names[0]), F.get(F.col("_first"), c - 1)).otherwise(c)})


def _firsts(bounds: str) -> Column:
    """For each of the sorted bounds the place of the first one like it."""
    return F.transform(bounds, lambda b: F.array_position(bounds, b).cast("int") - 1)


def _place(v: str) -> Column:
    """Place of ``v`` on the scale 0 to SLICES: its cell, and how far it is inside it."""
    x, lo, hi = F.col(v), F.col(f"_from{v}"), F.col(f"_to{v}")
    inside = (F.when(F.isnan(x), F.lit(1.0))
              .when(hi > lo, F.nanvl((x - lo) / (hi - lo), F.lit(0.0))).otherwise(F.lit(0.0)))
    return F.col(f"_c{v}") + F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))


def chunk_rows_setting(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("verdin.series.chunkRows", str(DEFAULT_CHUNK_ROWS)))


def with_chunks(df: DataFrame, keys: list[str], order: Sequence[str], chunk_rows: int | None = None) -> DataFrame:
    """Chunk id that never decreases along ``order`` inside a series: a series of n rows is cut into
    about ceil(n / chunk_rows) slices of like size.

    Slices lie between quantiles of the first order column, so outliers and skew do not fill one
    slice.  Rows that tie on it, and rows where it is null, are cut by the quantiles of the second order
    column.  Text is cut by its first six bytes, and texts alike in those stay together; so do ties
    of decimals and of numbers beyond 2^53.  Series within ``chunk_rows`` stay in chunk 0 and are never
    sorted for it.  The id depends on the row and on aggregates of its series, so every branch of a
    plan sees the same chunks."""
    rows = chunk_rows or chunk_rows_setting(df)
    order = list(order)
    names = [f"_ov{i}" for i in range(min(2, len(order)))]
    types = [df.schema[c].dataType for c in order[:2]]
    grp = keys or ["_all"]
    base = df.withColumns({n: _order_number(c, t) for n, c, t in zip(names, order, types, strict=False)})
    if not keys:
        base = base.withColumn("_all", F.lit(1))

    sizes = base.groupBy(*grp).agg(F.count(F.lit(1)).alias("_sn")).where(F.col("_sn") > rows)
    hot = sizes.select(*[F.col(k).alias(f"_h_{k}") for k in grp], "_sn")
    # hot series are few: one for every ``rows`` rows of the table at most, so both joins broadcast them.  Dealt by their keys,
    # all rows of a hot series would go to one task.
    of_hot = base.join(F.broadcast(hot), [base[k].eqNullSafe(hot[f"_h_{k}"]) for k in grp]).drop(*[f"_h_{k}" for k in grp])
    cuts = [i / SLICES for i in range(1, SLICES)]
    stats = of_hot.groupBy(*grp).agg(
        F.max("_sn").alias("_sn"), F.count_if(F.col(names[0]).isNull()).alias("_snull"),
        *[x for n in names for x in (F.percentile_approx(n, cuts, ACCURACY).alias(f"_b{n}"), F.min(n).alias(f"_lo{n}"),
                                     F.max(n).alias(f"_hi{n}"))])
    stats = stats.withColumn("_first", _firsts(f"_b{names[0]}"))
    helpers = [c for c in stats.columns if c not in grp]
    side = stats.select(*[F.col(k).alias(f"_g_{k}") for k in grp], *helpers)
    joined = base.join(F.broadcast(side), [base[k].eqNullSafe(side[f"_g_{k}"]) for k in grp], "left").drop(*[f"_g_{k}" for k in grp])

    joined = _with_cells(joined, names).drop(*[c for c in helpers if c not in ("_sn", "_snull")])
    v, place = F.col(names[0]), _place(names[0])
    void = F.lit(-1)
    if len(names) == 2:
        # 0 to 1 along the second order column; nulls, which sort first, are at 0
        along = F.coalesce(_place(names[1]) / SLICES, F.lit(0.0))
        if types[0].typeName() in _EXACT:
            cell, below = F.col(f"_c{names[0]}"), F.col("_below")
            place = F.when((cell - below >= 2) & (F.abs(v) < 2.0 ** 53),
                           below + 1 + (cell - below - 1) * along).otherwise(place)
        slices = F.ceil(F.col("_snull") / F.lit(rows))
        void = F.least(F.floor(along * slices) - slices, F.lit(-1))
    number = F.ceil(F.col("_sn") / F.lit(rows))
    chunk = F.when(v.isNull(), void).otherwise(F.least(F.floor(place * number / SLICES), number - 1))
    # never null, and known as such: else each join on it pushes a test of the whole expression below the projections
    chunk = F.when(F.col("_sn").isNull(), F.lit(0)).otherwise(chunk).cast("long")
    out = joined.withColumn("_chunk", F.coalesce(chunk, F.lit(0).cast("long")))
    return out.drop(*names, "_sn", "_snull", "_below", *[f"_{x}{n}" for n in names for x in ("c", "from", "to")], *([] if keys else ["_all"]))


def sequenced(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int = 0,
              compute: Callable[[DataFrame, Window], DataFrame] | None = None,
              chunk_rows: int | None = None) -> DataFrame:
    """Add ``_pos`` (1-based ordinal inside ``keys`` by ``order``) and ``_n`` (rows in the
    series); optionally run ``compute(frame, window)`` where ``window`` is partitioned by
    chunk and ordered by ``order`` and the frame carries ``halo`` preceding rows per chunk.

    ``order`` must be unique inside each series (deduplicate with J4 first)."""
    keys, order = list(keys), list(order)
    ranged = with_chunks(df, keys, order, chunk_rows)
    part = keys + ["_chunk"]
    w_local = Window.partitionBy(*part).orderBy(*order)
    local = (ranged.withColumn("_lrn", F.row_number().over(w_local))
             .withColumn("_lcnt", F.count(F.lit(1)).over(Window.partitionBy(*part))))

    counts = local.groupBy(*part).agg(F.count(F.lit(1)).alias("_cnt"))
    w_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    stats = (counts
             .withColumn("_offset", F.coalesce(
                 F.sum("_cnt").over(w_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*keys)))
             .withColumn("_crank", F.row_number().over(w_chunks))
             .drop("_cnt"))
    renamed = stats.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_chunk", "_offset", "_n", "_crank")
    cond = [local["_chunk"] == renamed["_chunk"]] + [local[k].eqNullSafe(renamed[f"_s_{k}"]) for k in keys]
    main = (local.join(renamed, cond).drop(renamed["_chunk"]).drop(*[f"_s_{k}" for k in keys])
            .withColumn("_pos", (F.col("_offset") + F.col("_lrn")).cast("long"))
            .withColumn("_halo", F.lit(False)))

    if compute is None:
        return main.drop(*_HELPERS)

    frame = main
    if halo > 0:
        # rows that may precede a later chunk: the last `halo` rows of their own chunk,
        # offered to the next `halo` chunks of the same series (each chunk has ≥ 1 row).
        cand = (main.filter(F.col("_lcnt") - F.col("_lrn") < halo)
                .withColumn("_trank", F.explode(F.sequence(F.col("_crank") + 1, F.col("_crank") + halo))))
        targets = stats.select(*[F.col(k).alias(f"_t_{k}") for k in keys],
                               F.col("_crank").alias("_t_rank"), F.col("_chunk").alias("_t_chunk"),
                               F.col("_offset").alias("_t_offset"))
        tcond = [cand["_trank"] == targets["_t_rank"]] + [cand[k].eqNullSafe(targets[f"_t_{k}"]) for k in keys]
        halo_rows = (cand.join(targets, tcond)
                     .filter(F.col("_pos") > F.col("_t_offset") - halo)
                     .withColumn("_chunk", F.col("_t_chunk"))
                     .withColumn("_halo", F.lit(True))
                     .select(*main.columns))
        frame = main.unionByName(halo_rows)
    window = Window.partitionBy(*part).orderBy(*order)
    out = compute(frame, window)
    return out.filter(~F.col("_halo")).drop(*_HELPERS)


# ---------------------------------------------------------------------------
# Autoregressive features


def usable_lags(n_rows: int | None = None, lags: Sequence[int] = LAG_CANDIDATES) -> list[int]:
    return [k for k in lags if n_rows is None or k < n_rows]


def lag_columns(y: str, window: Window, lags: Sequence[int]) -> list[Column]:
    """``target_lag_k`` = value k positions back."""
    return [F.lag(F.col(y), k).over(window).alias(f"target_lag_{k}") for k in lags]


def rolling_columns(y: str, window: Window, widths: Sequence[int]) -> list[Column]:
    """Mean / population std / min / max over the previous ``w`` rows, current row excluded."""
    out = []
    for w in widths:
        frame = window.rowsBetween(-w, -1)
        out += [F.avg(y).over(frame).alias(f"target_roll_mean_{w}"),
                F.stddev_pop(y).over(frame).alias(f"target_roll_std_{w}"),
                F.min(y).over(frame).alias(f"target_roll_min_{w}"),
                F.max(y).over(frame).alias(f"target_roll_max_{w}")]
    return out


def diff_column(y: str, window: Window) -> Column:
    """Previous value minus the one before it, 0.0 when absent."""
    return F.coalesce(F.lag(F.col(y), 1).over(window) - F.lag(F.col(y), 2).over(window),
                      F.lit(0.0)).alias("target_diff_1")


def required_history(lags: Sequence[int], widths: Sequence[int]) -> int:
    return max([2] + list(lags) + list(widths))


def autoregressive_features(series: DataFrame, keys: Sequence[str], ts: str, y: str,
                            lags: Sequence[int] = LAG_CANDIDATES,
                            widths: Sequence[int] = ROLLING_CANDIDATES,
                            keep_all: bool = False) -> DataFrame:
    """lag/rolling/diff features per series; a row is kept once its position
    exceeds max(2, lags, widths) (``_pos`` is 1-based so ``_pos > required``)."""
    need = required_history(lags, widths)

    def compute(frame: DataFrame, w: Window) -> DataFrame:
        return frame.select("*", *lag_columns(y, w, lags), *rolling_columns(y, w, widths), diff_column(y, w))

    out = sequenced(series, keys, [ts], halo=need, compute=compute)
    return out if keep_all else out.filter(F.col("_pos") > need)


def series_gate(series: DataFrame, keys: Sequence[str], min_rows: int = 12) -> DataFrame:
    """Per-series eligibility with the same gates as the trainer.

    lags/windows are restricted to those below n; needs n ≥ 12, n > required + 4,
    at least 8 feature rows and a training split of at least 6."""
    n = F.col("n_rows")
    lag_list = F.filter(F.array(*[F.lit(k) for k in LAG_CANDIDATES]), lambda k: k < n)
    win_list = F.filter(F.array(*[F.lit(k) for k in ROLLING_CANDIDATES]), lambda k: k < n)
    req = F.array_max(F.array_union(F.array(F.lit(2)), F.array_union(lag_list, win_list)))
    feature_rows = n - req
    test = F.greatest(F.lit(1), F.bround(feature_rows * 0.2, 0).cast("long"))
    agg = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return (agg.withColumn("required_history", req)
            .withColumn("feature_rows", feature_rows)
            .withColumn("eligible", (n >= min_rows) & (F.size(lag_list) > 0) & (n > req + 4)
                        & (feature_rows >= 8) & (feature_rows - test >= 6)))


def chrono_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], test_fraction: float = 0.2) -> DataFrame:
    """Per series, the last max(1, round(fraction·n)) rows (half-even) are ``test``."""
    seq = sequenced(df, keys, order)
    test_n = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(test_fraction), 0).cast("long"))
    return seq.withColumn("split", F.when(F.col("_pos") > F.col("_n") - test_n, F.lit("test")).otherwise(F.lit("train")))


def series_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = HISTORY_TAIL_ROWS) -> DataFrame:
    """The last ``k`` rows of each series (ordinal from the end ≤ k)."""
    seq = sequenced(df, keys, order)
    return seq.filter(F.col("_pos") > F.col("_n") - k)


def history_window(df: DataFrame, keys: Sequence[str], ts: str, days: int) -> DataFrame:
    """Rows within ``days`` of the series' last timestamp, inclusive.

    The max per series is a grouped aggregate joined back (no global window)."""
    grp = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    last = base.groupBy(*grp).agg(F.max(ts).alias("_last_ts"))
    # without keys the right side is one row (a scalar), so broadcasting it is bounded
    joined = base.join(last if keys else F.broadcast(last), grp, "inner")
    out = joined.filter(F.col(ts) >= F.col("_last_ts") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_last_ts")
    return out if keys else out.drop("_all")


def eval_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], fraction: float) -> DataFrame:
    """The last max(2, round(n·fraction)) rows are ``evaluation``, the rest ``train``."""
    seq = sequenced(df, keys, order)
    k = F.greatest(F.lit(2), F.bround(F.col("_n") * F.lit(fraction), 0).cast("long"))
    return seq.withColumn("role", F.when(F.col("_pos") > F.col("_n") - k, F.lit("evaluation"))
                          .otherwise(F.lit("train")))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                chunk_rows: int | None = None) -> DataFrame:
    """Running totals ``cum_<c>`` (inclusive) of ``cols`` along ``order`` inside ``keys``.

    Same chunking as :func:`sequenced`: per-chunk totals (a tiny table) give each
    chunk its starting offset, a window inside the chunk adds the local running sum.
    ``order`` must be unique inside each series."""
    keys, order = list(keys), list(order)
    ranged = with_chunks(df, keys, order, chunk_rows)
    part = keys + ["_chunk"]
    totals = ranged.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_chunk").alias("_o_chunk"),
                            *[F.coalesce(F.sum(f"_t_{c}").over(w_chunks), F.lit(0)).alias(f"_off_{c}") for c in cols])
    cond = [ranged["_chunk"] == offsets["_o_chunk"]] + [ranged[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys]
    j = ranged.join(offsets, cond).drop("_o_chunk", *[f"_o_{k}" for k in keys])
    w_local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = j.select("*", *[(F.sum(c).over(w_local) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols])
    return out.drop("_chunk", *[f"_off_{c}" for c in cols])
