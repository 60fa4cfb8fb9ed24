import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001
from verdin.sources.tables import TABLES

ML = {"tabular_regression", "tabular_classification", "permutation_importance", "automl_leaderboard",
      "training_record", "recursive_forecast", "forecast_decisions_model", "kernel_shap"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rule_id" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


def _norm(v):
    import numbers

    import pandas as pd
    try:
        if v is None or pd.isna(v):
            return None
    except (TypeError, ValueError):   # arrays
        return str(list(v))
    import numpy as np
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, numbers.Integral):
        return int(v)
    if isinstance(v, numbers.Real):
        return round(float(v), 4) + 0.0
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - ML))
def test_query_matches_oracle_at_sf0001(spark, duck, name):
    sp = entry.queries()[name](spark, SF0001).toPandas()
    dd = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    cols = sorted(sp.columns)
    key = lambda df: sorted(repr(tuple(_norm(v) for v in r)) for r in df[cols].itertuples(index=False))
    assert key(sp) == key(dd)
