"""What sessions are given is dealt by session once; later steps of a session move nothing."""

import contextlib
import io

from sessionloom.operators import covisit as V
from sessionloom.operators import recommend as R

EVENTS = "session long, aid long, ts long, type string"


def exchanges(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue().split("Exchange ")[1:]


def test_lists_move_before_they_are_written_out(spark):
    rows = [(s, (s * 7 + k * k) % 50, k * 1000, ("clicks", "carts", "orders")[k % 3]) for s in range(40) for k in range(12)]
    events = spark.createDataFrame(rows, EVENTS)
    found = R.reciprocal_rank(events, V.adjacency(V.unified_edges(events)))
    assert "Generate" in found._jdf.queryExecution().executedPlan().toString()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # above the step that writes candidates out (printed before it) nothing moves
    above = plan[: plan.index("Generate")]
    assert "Exchange" not in above and "Window" in above
    assert found.count() > 0
