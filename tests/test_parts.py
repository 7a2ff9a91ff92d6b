"""Purchases and their pairs go to more parts as they grow, and once."""

import pytest

from sessionloom.operators import covisit as V
from sessionloom.plans import recommend as Q
from sessionloom.sources import events as S

EVENTS = "session long, aid long, ts long, type string"


def test_parts_grow_with_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [S.parts_for(spark, n, 10) for n in (0, 10 * least, 10 * least + 1, 1000)] == [least, least, least + 1, 100]


@pytest.mark.parametrize("parts", [1, 5])
def test_pairs_both_ways_give_the_same_neighbours(spark, parts):
    rows = [(s, (s * 7 + k * k) % 50, k * 1000, ("clicks", "carts", "orders")[k % 3]) for s in range(60) for k in range(14)]
    events = spark.createDataFrame(rows, EVENTS)
    assert sorted(V.unified_edges(events, k=4, parts=parts).collect()) == sorted(V.unified_edges(events, k=4).collect())


def test_dealt_purchases_are_grouped_where_they_are(spark):
    dealt = Q._dealt_purchases(spark, "/root/testdata/sf0.001")
    assert dealt.count() > 0  # what is kept tells its partitions
    plan = V.tails(dealt)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("InMemoryTableScan")]
    dealt.unpersist()


def test_purchases_are_joined_once_for_the_graph(spark):
    events = spark.createDataFrame([(s, k % 7, k, "carts") for s in range(20) for k in range(9)], EVENTS)
    plan = V.bipartite_edges(events)._jdf.queryExecution().analyzed().toString()
    kept = V.bipartite_edges(events)._jdf.queryExecution().withCachedData().toString()
    assert "LogicalRDD" not in kept and kept.count("InMemoryRelation") == plan.count("LogicalRDD") > 1
