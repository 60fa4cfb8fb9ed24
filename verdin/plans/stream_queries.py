"""Streaming queries (R1–R4): each drains a file stream staged from the driver tables
and returns the sink table, checked against the batch SQL after the drain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdin.operators import asof, decide, explain
from verdin.plans import inline, timeseries  # noqa: F401  (their oracles are reused below)
from verdin.plans.decisions import seasonal_backtest
from verdin.plans.inline import DOC_IMPORTANCES
from verdin.plans.registry import ORACLE, register
from verdin.sources.tables import table
from verdin.streaming import streams


@register("stream_hourly", """
SELECT date_trunc('hour', ts) AS window_start, event_type, round(sum(value), 6) AS value, count(*) AS n
FROM events GROUP BY 1, 2
""")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """R2: watermarked hourly tumbling windows per event type over a replayed event stream."""
    return streams.run_hourly(spark, table(spark, sf, "events"))


#: Events left out, so that the stream has hours without events of a type.
_GAP = "NOT (event_type = 'click' AND hour(ts) BETWEEN 3 AND 7) AND NOT (event_type = 'view' AND ts >= TIMESTAMP '2024-01-03 00:00:00')"


@register("stream_regular_hourly", f"""
WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type, value FROM events WHERE {_GAP}),
g AS (SELECT h, event_type, round(sum(value), 6) AS value, count(*) AS n FROM e GROUP BY 1, 2),
k AS (SELECT event_type, unnest(generate_series(min(h), (SELECT max(h) FROM e), INTERVAL 1 HOUR)) AS h FROM e GROUP BY event_type)
SELECT k.h AS window_start, k.event_type, coalesce(g.value, 0) AS value, coalesce(g.n, 0) AS n FROM k LEFT JOIN g USING (h, event_type)
""")
def stream_regular_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """R2: the hourly feed with a row for every hour of each type, gaps filled by keyed state and event-time timers."""
    return streams.run_regular_feed(spark, table(spark, sf, "events").where(F.expr(_GAP)))


def _doc_scorer(spark: SparkSession, sf: str):
    static = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("kchars"), "lang",
                                                  "source")
    profile = explain.baseline_profile(static, ["kchars"], ["lang", "source"], digits=6).checkpoint(eager=True)

    def score(batch: DataFrame) -> DataFrame:
        d = batch.select("doc_id", (F.col("n_chars") / 1000.0).alias("kchars"), "lang", "source")
        d = (d.withColumn("prediction", (F.col("kchars") >= 2.0).cast("int"))
             .withColumn("confidence", F.bround(F.least(F.lit(0.99), 0.5 + F.abs(F.col("kchars") - 2.0) / 20.0), 6)))
        x = explain.proxy_impact(d, profile, DOC_IMPORTANCES, ["kchars"], ["lang", "source"])
        r = decide.recommendations(decide.build_facts(x, "binary"), "inline_default")
        return r.select("doc_id", "risk_level", "rule_id", "scenario_id")
    return score


@register("stream_decisions", ORACLE["rule_match_inline"])
def stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arriving as a stream are scored, explained, turned into facts and
    matched to inline_default rules batch by batch (profile from the static table)."""
    docs = table(spark, sf, "documents")
    return streams.run_decisions(spark, docs, _doc_scorer(spark, sf))


@register("stream_postfactum", ORACLE["postfactum_match"])
def stream_postfactum(spark: SparkSession, sf: str) -> DataFrame:
    """Actual events streamed against stored forecast points (stream–static bucketed join)."""
    points, _ = seasonal_backtest(spark, sf)
    points = points.select("series_id", "step", "ts", F.bround("prediction", 6).alias("prediction")) \
        .checkpoint(eager=True)
    matched = streams.run_postfactum(spark, table(spark, sf, "events"), points, 1800)
    return asof.postfactum_errors(matched)


@register("stream_drift", """
WITH c AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1),
g AS (SELECT c.*, coalesce(r.p, 0) AS p, n / sum(n) OVER (PARTITION BY window_start) AS q
      FROM c LEFT JOIN r USING (event_type)),
m AS (SELECT *, (p + q) / 2 AS mm FROM g),
j AS (SELECT window_start, CAST(sum(n) AS BIGINT) AS events,
        0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / mm) ELSE 0 END)
        + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / mm) ELSE 0 END) + 0.5 * (1 - sum(p)) AS js
      FROM m GROUP BY 1)
SELECT window_start, events, round_even(js, 6) AS js_divergence, js > 0.1 AS drifted FROM j
""")
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Daily event-type counts from the stream vs the static reference mix (JS divergence)."""
    return streams.run_drift(spark, table(spark, sf, "events"))
