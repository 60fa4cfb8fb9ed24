"""Autoregressive forecasting for many series at once.

Every eligible series is forecast.  Rows without a time or a value go first, and of one time the last
value counts.  Series of the same required history (W5) use the same lags and share a forest.  Each series is
learned and forecast on its own scale: the features of a series are taken from its mean and divided by its deviation, and
predictions go back the same way, so series of any level can share the trees; the scale is part of
the series' state.  For the evaluation the scale is that of the training rows alone.  The recursive forecast keeps, per series,
the last ``max(required, 240)`` values as an array column; each step builds the
feature row from that array with array functions, scores *all series in one
transform*, appends the prediction and cuts lineage with a reliable
``checkpoint()`` in the shared checkpoint folder.  The step loop runs on the
driver because step k needs prediction k−1; its state is one row per series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdin.functions.timefuncs import CALENDAR_COLUMNS, calendar_features
from verdin.operators.metrics import regression_metrics
from verdin.operators.ml import balanced_checkpoint
from verdin.operators.series import (HISTORY_TAIL_ROWS, LAG_CANDIDATES, ROLLING_CANDIDATES, autoregressive_features,
                                     chrono_split, series_gate, series_tail)
from verdin.operators.temporal import cadence_minutes

FORECAST_TREES = 400   # fixed value: trees in the forecasting forest
DEFAULT_STEPS = 12
DEFAULT_HORIZON = 30


def feature_columns(lags: Sequence[int] = LAG_CANDIDATES, widths: Sequence[int] = ROLLING_CANDIDATES) -> list[str]:
    cols = list(CALENDAR_COLUMNS) + [f"target_lag_{k}" for k in lags]
    for w in widths:
        cols += [f"target_roll_mean_{w}", f"target_roll_std_{w}", f"target_roll_min_{w}", f"target_roll_max_{w}"]
    return cols + ["target_diff_1"]


@dataclass
class Regime:
    """What the series with the same usable lags share: their forest and their history state."""
    model: PipelineModel
    features: list[str]
    lags: list[int]
    widths: list[int]
    required: int
    history_window: int
    state: DataFrame            # keys, history array<double>, last_ts, cadence_minutes, the series' scale


@dataclass
class ForecastBundle:
    keys: list[str]
    regimes: list[Regime]       # one for each required history met, at most one a lag candidate
    metrics: dict
    historical_fit: DataFrame
    training_rows: int
    extra: dict = field(default_factory=dict)

    @property
    def state(self) -> DataFrame:
        return _union([r.state for r in self.regimes])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _forest(num_trees: int, seed: int, max_depth: int, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        RandomForestRegressor(labelCol="y", featuresCol="features", numTrees=num_trees, seed=seed,
                              maxDepth=max_depth, featureSubsetStrategy="all", maxMemoryInMB=1024,
                              cacheNodeIds=True, checkpointInterval=10)])


def clean_series(series: DataFrame, keys: Sequence[str], ts: str, y: str) -> DataFrame:
    """Rows with a time and a finite value; of one time the largest value (the order of equal times is not defined)."""
    value = F.col(y).cast("double")
    usable = F.col(ts).isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return series.where(usable).groupBy(*keys, ts).agg(F.max(value).alias(y))


def series_scale(rows: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Mean and deviation of each series; a flat series has deviation 0, and its forecast is its level."""
    return rows.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_spread"))


def _share(c: Column) -> Column:
    return F.when(F.col("_spread") > 0, c / F.col("_spread")).otherwise(F.lit(0.0))


def _with(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``side`` columns (one row a series) on the rows of the series; a null key is a series too."""
    named = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    same = [df[k].eqNullSafe(named[f"_k_{k}"]) for k in keys] or [F.lit(True)]
    return df.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


def on_own_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features in units of the series: levels from the mean, differences and deviations by their size."""
    sizes = [c for c in features if c.startswith("target_roll_std_") or c == "target_diff_1"]
    levels = [c for c in features if c.startswith("target_") and c not in sizes]
    return df.withColumns({**{c: _share(F.col(c) - F.col("_mean")) for c in levels}, **{c: _share(F.col(c)) for c in sizes}})


def _fitted(pipeline: Pipeline, rows: DataFrame, features: Sequence[str]) -> PipelineModel:
    return pipeline.fit(on_own_scale(rows, features).withColumn("y", _share(F.col("y") - F.col("_mean"))))


def _predicted(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with the prediction in the series' own units."""
    own = [c for c in rows.columns if c not in features]
    return model.transform(on_own_scale(rows, features)).withColumn("prediction", F.col("_mean") + F.col("_spread") * F.col("prediction")).select(*own, "prediction")


def train_forecaster(series: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y",
                     num_trees: int = FORECAST_TREES, seed: int = 42, max_depth: int = 5) -> ForecastBundle:
    """Eligibility (W5), supervised rows (W4 + X3), chronological 80/20 evaluation (W7) with
    k = features + 1, refit on all rows, in-sample fit, history state (W8) and cadence (W6).

    Every eligible series is trained, with the lags and widths that its length allows: series of
    the same required history share a forest.  Raises ValueError when no series is eligible."""
    keys = list(keys)
    series = clean_series(series, keys, ts, y).checkpoint(eager=True)
    gate = series_gate(series, keys).filter("eligible").select(*keys, "required_history").checkpoint(eager=True)
    needs = [r[0] for r in gate.select("required_history").distinct().orderBy(F.desc("required_history")).collect()]
    if not needs:
        raise ValueError("no series is long enough to forecast")
    regimes, scored, fits, n_rows = [], [], [], 0
    for need in needs:          # at most one value a lag candidate
        lags, widths = [k for k in LAG_CANDIDATES if k <= need], [k for k in ROLLING_CANDIDATES if k <= need]
        features = feature_columns(lags, widths)
        members = gate.filter(F.col("required_history") == need).select(*[F.col(k).alias(f"_m_{k}") for k in keys])
        same = [series[k].eqNullSafe(F.col(f"_m_{k}")) for k in keys]   # W5 gates a null key as a series of its own
        s = series.join(members, same, "left_semi").select(*keys, ts, y)
        rows = autoregressive_features(s, keys, ts, y, lags, widths)
        rows = rows.select(*keys, ts, F.col(y).cast("double").alias("y"),
                           *[c.alias(n) for c, n in zip(calendar_features(F.col(ts)), CALENDAR_COLUMNS)],
                           *[c for c in rows.columns if c.startswith("target_")])
        rows = balanced_checkpoint(rows, *keys, ts)
        split = chrono_split(rows, keys, [ts])
        train, test = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")
        past = series_scale(train, keys)
        eval_model = _fitted(_forest(num_trees, seed, max_depth, features), _with(train, past, keys), features)
        scored.append(_predicted(eval_model, _with(test, past, keys), features).select("y", "prediction"))
        scale = series_scale(rows, keys)
        scaled = _with(rows, scale, keys)
        model = _fitted(_forest(num_trees, seed, max_depth, features), scaled, features)
        fits.append(_predicted(model, scaled, features).select(*keys, ts, F.col("y").alias("target"),
                                                               F.bround("prediction", 6).alias("prediction")))
        window = max(need, HISTORY_TAIL_ROWS)
        tail = series_tail(s, keys, [ts], window)
        state = (tail.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col(y).cast("double").alias("v"))))
                                         .alias("_h"), F.max(ts).alias("last_ts"))   # ≤ `window` values per series
                 .select(*keys, F.transform("_h", lambda e: e["v"]).alias("history"), "last_ts"))
        cad = cadence_minutes(s, keys, ts).select(*[F.col(k).alias(f"_c_{k}") for k in keys], "cadence_minutes")
        state = state.join(cad, [state[k].eqNullSafe(cad[f"_c_{k}"]) for k in keys], "left") \
            .drop(*[f"_c_{k}" for k in keys])
        state = _with(state, scale, keys).checkpoint(eager=True)
        regimes.append(Regime(model, features, lags, widths, need, window, state))
        n_rows += rows.count()
    k = len(regimes[0].features) + 1
    m = regression_metrics(_union(scored), "y", "prediction", k=k).first().asDict()
    metrics = {n: m[n] for n in ("r", "mse", "rmse", "mae", "r2", "aic", "bic", "aicc") if m[n] is not None}
    return ForecastBundle(keys, regimes, metrics, _union(fits), n_rows)


def _roll(h: Column, w: int) -> tuple[Column, Column, Column, Column]:
    tail = F.slice(h, F.size(h) - w + 1, w)
    mean = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x) / w
    var = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / w
    return mean, F.sqrt(var), F.array_min(tail), F.array_max(tail)


def step_features(state: DataFrame, ts: Column, lags: Sequence[int], widths: Sequence[int]) -> DataFrame:
    """One feature row per series from its history array (same definitions as W1–W3)."""
    h = F.col("history")
    cols = [c.alias(n) for c, n in zip(calendar_features(ts), CALENDAR_COLUMNS)]
    cols += [F.element_at(h, -k).alias(f"target_lag_{k}") for k in lags]
    for w in widths:
        mean, std, mn, mx = _roll(h, w)
        cols += [mean.alias(f"target_roll_mean_{w}"), std.alias(f"target_roll_std_{w}"),
                 mn.alias(f"target_roll_min_{w}"), mx.alias(f"target_roll_max_{w}")]
    cols.append(F.when(F.size(h) >= 2, F.element_at(h, -1) - F.element_at(h, -2)).otherwise(F.lit(0.0))
                .alias("target_diff_1"))
    return state.select("*", ts.alias("ts_step"), *cols)


def recursive_forecast(bundle: ForecastBundle, steps: int = DEFAULT_STEPS,
                       horizon_minutes: int | None = None) -> DataFrame:
    """M15 + M17: ``steps`` predictions per series, each ``horizon_minutes`` after the
    previous one (default: the smaller of 30 and the series cadence), fed back into the history.
    Adds a warning when the horizon differs from the training cadence."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    if horizon_minutes is not None and horizon_minutes < 1:
        raise ValueError("horizon must be at least 1 minute")
    keys = bundle.keys
    hmin = (F.lit(int(horizon_minutes)) if horizon_minutes is not None
            else F.when(F.col("cadence_minutes") > 0, F.least(F.lit(DEFAULT_HORIZON), F.col("cadence_minutes")))
            .otherwise(F.lit(DEFAULT_HORIZON)))
    outputs = []
    for regime in bundle.regimes:
        state = regime.state.withColumn("horizon_minutes", hmin.cast("int"))
        most = regime.history_window
        for k in range(1, steps + 1):
            ts_k = F.timestamp_add("MINUTE", F.col("horizon_minutes") * k, F.col("last_ts"))
            feats = step_features(state, ts_k, regime.lags, regime.widths)
            stepped = _predicted(regime.model, feats, regime.features).select(*state.columns, "ts_step", "prediction").checkpoint(eager=True)
            outputs.append(stepped.select(*keys, F.lit(k).alias("step"), F.col("ts_step").alias("ts"),
                                          F.bround("prediction", 6).alias("prediction"), "horizon_minutes",
                                          "cadence_minutes"))
            grown = F.concat(F.col("history"), F.array(F.col("prediction")))
            state = stepped.select(*[c for c in state.columns if c != "history"],
                                   F.slice(grown, F.greatest(F.size(grown) - most + 1, F.lit(1)), most).alias("history"))
    out = _union(outputs)
    warn = F.when((F.col("cadence_minutes") > 0) & (F.col("horizon_minutes") != F.col("cadence_minutes")),
                  F.concat(F.lit("steps of "), F.col("horizon_minutes").cast("string"), F.lit(" min on a series of one value each "),
                           F.col("cadence_minutes").cast("string"), F.lit(" min")))
    return out.withColumn("warning", warn)


def recent_history(series: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y",
                   k: int = HISTORY_TAIL_ROWS) -> DataFrame:
    """W8 recent history rows (last 240 per series) used as the A13 baseline."""
    return series_tail(series, keys, [ts], k).select(*keys, ts, y)
