"""Every query with SQL equals DuckDB on the given tables; every registered name is covered."""

import pytest
from oracle import check, connect

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    problem, _, rows = check(spark, con, sf, name, queries()[name], SQL[name])
    assert problem == ""


def test_sql_keys_are_registered():
    assert set(SQL) <= set(queries())


def test_entry_returns_rows(spark, sf):
    assert entry(spark).count() > 0


# cheap queries without SQL; the costly ones are covered on planted data in the other modules
@pytest.mark.parametrize("name", [
    "smoothed_markers", "basis_and_artificial_types", "multiplet_cells", "dip_by_marker", "marker_scan",
    "two_view_correlations", "joint_projection", "multi_view_correlations", "bridged_view_correlations",
    "hierarchical_view_scores", "missing_view_alignment", "mixture_split_of_projection",
])
def test_query_without_sql_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.count() > 0
