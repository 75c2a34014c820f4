"""Registered queries against their SQL on the small tables (all of them: python tests/oracle.py)."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connection

SF = "/root/testdata/sf0.001"
SLOW = ("cl_impute_knn", "ml_", "knn_", "cu_", "dr_", "ch_density", "fs_rfe", "ev_silhouette", "ev_cluster", "ev_scaled")
FAST = [n for n in entry.oracle_sql() if not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", FAST + ["ml_split_stratified", "ml_linear_regression"])
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
