"""Every registered query with an oracle must equal DuckDB on sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from strata.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.oracle_check import close, rows

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    gc, gr = rows(got)
    wc, wr = rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert all(close(a, b) for a, b in zip(gr, wr)), name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["station", "trips", "avg_delay", "median_delay", "p95_delay",
                          "delayed_trips", "delay_pct"]
