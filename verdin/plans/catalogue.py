"""Imports every plan module so the registry is complete."""

from verdin.plans import (decisions, drift_queries, ingest, inline, modeling, profiling, quality,  # noqa: F401
                          stream_queries, timeseries, versions)
from verdin.plans.registry import ORACLE, QUERIES  # noqa: F401
