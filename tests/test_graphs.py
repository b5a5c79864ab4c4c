"""Graphs and pairs against their definitions."""

from collections import Counter

from bagframe.operators import graphs
from bagframe.plans import QUERIES

SF = "/root/testdata/sf0.01"


def test_edges_both_ways(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 2, 0, 3.0)], "bag_id long, src long, dst long, dist double")
    got = Counter((r["src"], r["dst"]) for r in graphs.both_ways(edges).collect())
    assert got == {(0, 1): 2, (1, 0): 2, (2, 0): 1, (0, 2): 1}
    assert QUERIES["knn_graph_both"](spark, SF).count() == 2 * QUERIES["knn_graph"](spark, SF).count()


def test_own_partner_stays_unmixed(spark):
    bags = spark.range(400).selectExpr("id as bag_id")
    rows = graphs.chosen_pairs(bags, 0.5, 3).collect()
    assert len(rows) == 400 and 140 < sum(r["mixed"] for r in rows) < 260
    assert not graphs.chosen_pairs(bags.limit(1), 1.0).first()["mixed"]


def test_all_js_and_median(spark):
    rows = QUERIES["topj_pool_all"](spark, SF).select("bag_id", "j", "pos", "best").collect()
    assert {r["j"] for r in rows} == {1, 5, 10, 50, 100} and {r["pos"] for r in rows} == set(range(64)) and sum(r["best"] for r in rows) == 25 * 5
    assert QUERIES["aggregate_array_median"](spark, SF).first()["median"] is not None
