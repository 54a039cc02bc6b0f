"""Every registered query with oracle SQL matches DuckDB on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SKIP_SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    import datetime
    import pandas as pd
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (int, float, str)):
        v = v.tolist() if hasattr(v, "tolist") else v
        if isinstance(v, list):
            return tuple(_norm(x) for x in v)
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return None
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


NAMES = sorted(n for n in E.oracle_sql() if n not in SKIP_SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    op = con.sql(E.oracle_sql()[name]).df()
    sc, sr = _rows(sp)
    oc, orr = _rows(op)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "organic_growth_score" in df.columns
