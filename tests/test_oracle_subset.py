"""A few registered queries against their DuckDB oracle on sf0.001 (the full
set runs with tools/oracle_check.py)."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from popsight.sources.tables import TABLES
from tests.conftest import SF_SMALL

NAMES = ["t5_business_impact", "v2_overall_metrics", "m1_missing_profile",
         "a6_low_cardinality_distributions", "e5_preprocess_fit_transform", "k9_segment_personas"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = _rows(entry.queries()[name](spark, SF_SMALL).toPandas())
    exp = _rows(con.execute(entry.oracle_sql()[name]).df())
    assert got[0] == exp[0]
    assert got[1] == exp[1]
