"""Registered queries: one module per area, SQL next to the query."""

from __future__ import annotations

from ..fixtures import table
from ..operators.profile import TableProfile
from ..plans.prepare import quality_report
from . import analysis_queries, model_queries, prepare_queries, profile_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)


def flagship(spark, sf_dir):
    """Quality report of the orders table."""
    return quality_report(TableProfile(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"]))
