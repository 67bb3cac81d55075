"""Driver contract: entry runs, every query has an oracle, queries run."""

import duckdb
import pytest
from conftest import SF0001

import __spark_entry__ as E
from faretrail.config import JourneyConfig
from faretrail.plans import catalogue

TABLES = ["events", "orders", "lineitem", "region", "nation", "supplier"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["IMTT_DESC", "TAG1_TS_NM", "TAG1_LAT_VAL", "TAG1_LONG_VAL", "count"]
    assert df.count() > 0


def test_every_query_has_oracle():
    """The library's own queries all have one; some of the optional
    training-data queries cannot be expressed in SQL."""
    own = set(catalogue.queries(JourneyConfig.for_test_events()))
    assert own <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", ["r01_departure", "journey_clean", "covariance_q9", "box_q12", "r50_card_count",
                                 "file_row_counts", "freq_mode"])
def test_query_matches_oracle_sf0001(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = E.queries()[key](spark, SF0001)
    res = con.execute(E.oracle_sql()[key])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    order = sorted(df.columns)
    s_rows = sorted(tuple(r[c] for c in order) for r in df.collect())
    idx = [d_cols.index(c) for c in order]
    d_rows = sorted(tuple(r[i] for i in idx) for r in res.fetchall())
    assert s_rows == d_rows
