"""Exploratory pairs of sessions with crowded stretches of time, against plain sums."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.operators import covisit as V

TYPES = sorted(C.EXPLORE_WEIGHT)
SCHEMA = "session long, aid long, ts long, type string"


def plain_scores(rows, gap):
    score = Counter()
    kept = [r for r in rows if None not in r[:3]]
    for x in kept:
        for y in kept:
            if x[0] == y[0] and x[1] != y[1] and abs(x[2] - y[2]) < gap:
                score[x[1], y[1]] += C.EXPLORE_WEIGHT.get(y[3], 0)
    return score


@pytest.mark.parametrize("limit", [1, 7, 1024])
@pytest.mark.parametrize("gap", [1, 2, 37, 64, 1000])
def test_crowded_sessions_equal_plain_sums(spark, gap, limit):
    r = np.random.default_rng(gap * 2000 + limit)
    drawn = zip(r.integers(0, 4, 500) ** 2, r.integers(0, 23, 500), r.integers(-900, 2500, 500), r.integers(0, 3, 500), strict=True)
    rows = [(int(s), int(a), int(t), TYPES[k]) for s, a, t, k in drawn]
    rows += rows[:40]  # repeated rows
    rows += [(0, k % 9, 500, "clicks") for k in range(60)]  # many at one time
    rows += [(None, 1, 5, "clicks"), (0, None, 5, "clicks"), (0, 1, None, "clicks"), (0, 2, 6, None), (0, 3, 6, "unknown")]
    found = V.explore_edges(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")), gap, above=0, limit=limit)
    assert {(x.aid1, x.aid2): x.score for x in found.collect()} == {k: v for k, v in plain_scores(rows, gap).items() if v > 0}


def test_empty_table(spark):
    assert V.explore_edges(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hundred_thousand_events_of_a_session(spark):
    """All in two days: no task makes the 10 ** 10 pairs of events, no join key has more than a few slices' pairs of items."""
    n, items, gap = 100_000, 200, C.DAY_MS
    r = np.random.default_rng(3)
    aid, ts, kind = r.integers(0, items, n), np.sort(r.integers(0, 2 * gap, n)) + 5 * gap + 12345, r.integers(0, 3, n)
    events = spark.createDataFrame([(1, int(a), int(t), TYPES[k]) for a, t, k in zip(aid, ts, kind, strict=True)], SCHEMA)
    weight = np.array([C.EXPLORE_WEIGHT[t] for t in TYPES])[kind]
    before = np.zeros((n + 1, items), np.int64)  # events of each item before a place
    before[np.arange(1, n + 1), aid] = 1
    before = before.cumsum(axis=0)
    low, high = np.searchsorted(ts, ts - gap, "right"), np.searchsorted(ts, ts + gap, "left")
    expected = np.zeros((items, items), np.int64)
    for b in range(items):
        of = np.flatnonzero(aid == b)
        expected[:, b] = ((before[high[of]] - before[low[of]]) * weight[of, None]).sum(axis=0)
    found = V.explore_edges(events, limit=64).collect()
    assert len(found) == items * (items - 1)
    assert all(x.score == expected[x.aid1, x.aid2] for x in found)


def test_events_of_one_time_go_to_the_levels_as_one(spark):
    """each event became 29 rows, repeated ones too."""
    rows = spark.range(600).selectExpr("1L AS session", "id % 3 AS aid", "0L AS at", "id % 2 AS offset", "1 AS weight")
    plan = V._crowded_sums(rows, 64, 8)._jdf.queryExecution().optimizedPlan().toString()
    levels = plan.rindex("Generate explode([-2")
    assert "Aggregate [" in plan[levels:]
