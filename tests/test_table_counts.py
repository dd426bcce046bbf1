"""Rows of the catalog."""
from strata.plans import catalog
from strata.sources.tables import TABLES, read_table
from tests.conftest import SF_SMALL


def test_tables_have_their_counts(spark):
    got = {r["name"]: r["n_rows"] for r in catalog.queries()["tables"](spark, SF_SMALL).collect()}
    assert got and set(got) <= set(TABLES)
    assert all(n == read_table(spark, SF_SMALL, t).count() for t, n in got.items())
