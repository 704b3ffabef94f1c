"""Queries whose SQL in the catalog still takes a subset give the rows of that SQL without the subset."""

import pytest

from lexmill.operators import graph
from lexmill.plans import catalog
from tests.conftest import SF, rows_of
from tests.test_catalog import plain

#: Conditions that choose a subset of the rows. Where the SQL has none of them, it is compared as it is.
SUBSETS = (" WHERE o_orderkey % 97 = 0", " WHERE c_acctbal > 9000", " WHERE c_acctbal > 9500", " WHERE f.i % 5 = 0", " WHERE n_nationkey % 5 = 0", " WHERE n_nationkey < 3")


def same_as_whole_sql(spark, duck, name):
    sql = catalog.SQL[name]
    for condition in SUBSETS:
        sql = sql.replace(condition, "")
    wanted = duck.sql(sql)
    names = sorted(wanted.columns)
    rows = sorted(tuple(plain(r[list(wanted.columns).index(c)]) for c in names) for r in wanted.fetchall())
    found = catalog.QUERIES[name](spark, SF)
    assert sorted(found.columns) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in (x.asDict(True) for x in found.collect())) == rows


@pytest.mark.parametrize("name", ["hub_nodes", "khop_reachable", "all_paths_upto", "meeting_paths", "without_hubs"])
def test_graph_of_all_orders(spark, duck, name):
    same_as_whole_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["class_priority", "resolve_class"])
def test_classes_of_all_customers(spark, duck, name):
    same_as_whole_sql(spark, duck, name)


def test_spans_of_all_tokens(spark, duck):
    same_as_whole_sql(spark, duck, "token_char_spans")


@pytest.mark.parametrize("name", ["khop_reachable", "all_paths_upto"])
def test_starts_in_all_nations(spark, name):
    nations = {r["n_nationkey"] for r in catalog.read(spark, SF, "nation").collect()}
    assert {r["start"] for r in catalog.QUERIES[name](spark, SF).collect()} == nations


def test_ancestors_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(68)] + [(0, 0)], "sub long, super long")
    assert rows_of(graph.ancestors(links), "sub", "super") == [(a, b) for a in range(69) for b in range(a, 69)]
