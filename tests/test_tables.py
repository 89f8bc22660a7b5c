"""Queries that have to cover the whole of their tables."""

from lamella.plans import registry
from lamella.plans.table_queries import FEATURES, tiles
from tests.conftest import SMALL


def test_means_of_all_features_and_scans(spark):
    got = registry.queries()["agg_means_by_scan"](spark, SMALL).collect()
    assert {r["name"] for r in got} == set(FEATURES)
    assert {r["scan"] for r in got} == {r["scan"] for r in tiles(spark, SMALL).select("scan").distinct().collect()}
