"""Candidates, their labels and interactions are made where their session is; cuts of training rows are conditions."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.operators import covisit as V
from sessionloom.operators import items as I
from sessionloom.operators import ordered as O
from sessionloom.operators import recommend as R
from sessionloom.operators import splits as P

ROWS = [(s, (s * 7 + k * k) % 40, k * 3_600_000 // 4, C.EVENT_TYPES[(s + k) % 3]) for s in range(40) for k in range(12)]


@pytest.mark.parametrize("held", [0, 1 << 16])
def test_carried_columns_equal_joins(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD_LISTS", held)
    monkeypatch.setattr(R, "HELD_ITEMS", held)
    events = spark.createDataFrame(ROWS, "session long, aid long, ts long, type string").persist()
    history, truth = events.filter("ts < 7000000"), P.ground_truth(events.filter("ts >= 7000000"))
    graphs = {g: V.typed_edges(history, g) for g in R.GRAPHS}
    popular = I.popular_candidates(history, 3)
    plain = R.assemble(R.candidates(history, graphs, popular), history, history)
    found = R.candidates(history, graphs, popular, truth, carry=True)
    rows = R.assemble(found, history, history)
    assert sorted(map(tuple, rows.drop(*(f"hit_{t}" for t in C.EVENT_TYPES)).select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    for kind in C.EVENT_TYPES:
        joined = R.labelled(plain, truth, kind).select("session", "candidate_aid", "label").collect()
        assert sorted(R.labelled(rows, truth, kind).select("session", "candidate_aid", "label").collect()) == sorted(joined)
        assert {r.label for r in joined} == {0, 1}
    if held:  # candidates, once written out, do not move
        plan = rows._jdf.queryExecution().executedPlan().toString()
        above, depth = plan[: plan.index("Generate explode")].splitlines(), len(plan[: plan.index("Generate explode")].splitlines()[-1])
        assert not any("Exchange hashpartitioning(candidate_aid" in line for line in above) and depth > 0


@pytest.mark.parametrize("n", [0, 1, 37, 150, 299, 300, 400])
def test_a_cut_is_the_first_rows(spark, monkeypatch, n):
    monkeypatch.setattr(O, "SORTED", 20)
    rows = spark.range(300).select((F.col("id") * 7 % 5).alias("a"), (F.col("id") * 11 % 60).alias("b"), "id").persist()
    order = [("a", True), ("b", False), ("id", False)]
    want = [r.id for r in sorted(rows.collect(), key=lambda r: (-r.a, r.b, r.id))[:n]]
    assert sorted(r.id for r in rows.filter(O.among_first(rows, order, n)).collect()) == sorted(want)
