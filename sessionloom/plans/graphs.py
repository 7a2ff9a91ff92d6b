"""Queries: co-visitation graphs, splits, labels; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import covisit as V
from sessionloom.operators import sessions as S
from sessionloom.operators import splits as P
from sessionloom.plans.analytics import _FLAGS, _sql, _web, rounded  # noqa: F401
from sessionloom.sources.events import PURCHASE_SQL, WEB_SQL, parts_for, purchase_events, purchase_rows, web_events

MONTH_MS = 30 * 86_400_000
_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def labels_text(events: DataFrame) -> DataFrame:
    out = P.future_labels(events)
    return out.select("session", "aid", "ts", "type", "next_click", _text("later_carts").alias("later_carts"), _text("later_orders").alias("later_orders"))


def history_counts(events: DataFrame) -> DataFrame:
    history, future = P.history_split(events)
    return history.withColumn("part", F.lit("history")).unionByName(future.withColumn("part", F.lit("future")))


def truth_text(events: DataFrame) -> DataFrame:
    return P.ground_truth(P.history_split(events)[1]).select("session", "type", _text("ground_truth").alias("ground_truth"))


def split_rows(events: DataFrame) -> DataFrame:
    train, test = P.temporal_split(events, 7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def truncated_text(events: DataFrame) -> DataFrame:
    out = P.truncated(events, seed=None)
    return out.select("session", "prefix_length", "next_click", _text("carts").alias("carts"), _text("orders").alias("orders"))


def week_rows(events: DataFrame) -> DataFrame:
    train, valid = P.week_split(events, 21)
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


def last_out_text(events: DataFrame) -> DataFrame:
    return P_last_out(events).select("session", _text("train").alias("train"), "valid", "test")


def P_last_out(events: DataFrame) -> DataFrame:  # noqa: N802
    return S.last_out_split(S.sequences(events, shift=0))


def one_week(events: DataFrame) -> DataFrame:
    """Sessions cut by week, so that there are short ones and ones that begin late: session * 10 + week."""
    return events.withColumn("session", F.col("session") * 10 + F.expr("ts div 604800000 % 10"))


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as a graph; in parts by session, so that they are grouped where they are."""
    return V.bipartite_edges(purchase_events(spark, d).repartition(parts_for(spark, purchase_rows(spark, d)), "session"))


WEEKLY_SQL = WEB_SQL.replace("ev AS (", "ev0 AS (", 1) + ", ev AS (SELECT session * 10 + ts // 604800000 % 10 AS session, aid, ts, type FROM ev0)"

QUERIES = {
    "covisit_unified": lambda s, d: V.unified_edges(purchase_events(s, d)),
    "covisit_unified_month": lambda s, d: V.unified_edges(purchase_events(s, d), gap_ms=MONTH_MS),
    "covisit_clicks": _web(lambda e: V.typed_edges(e, "clicks")),
    "covisit_cart_order": _web(lambda e: V.typed_edges(e, "cart_order")),
    "covisit_buy2buy": _web(lambda e: V.typed_edges(e, "buy2buy")),
    "covisit_explore": _web(V.explore_edges),
    # five sessions hold all events, so that stretches of time are crowded
    "covisit_explore_crowded": _web(lambda e: V.explore_edges(e.withColumn("session", F.expr("session % 5")), above=3.0, limit=64)),
    "adjacency_text": lambda s, d: V.adjacency(V.unified_edges(purchase_events(s, d), gap_ms=MONTH_MS)).select("aid", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["aid2"].cast("string"), x["wgt"].cast("long").cast("string"))), " ").alias("candidates")),
    "gap_pairs": _web(V.gap_pairs),
    "bipartite_edges": bipartite,
    "future_labels": _web(labels_text),
    "history_split": _web(history_counts),
    "ground_truth": _web(truth_text),
    "temporal_split": _web(lambda e: split_rows(one_week(e))),
    "split_checks": _web(lambda e: P.split_checks(*P.temporal_split(one_week(e), 7))),
    "truncated_sessions": _web(truncated_text),
    "week_scenarios": _web(lambda e: P.week_scenarios(one_week(e), 21)),
    "scenario_summary": _web(lambda e: P.scenario_summary(P.week_scenarios(one_week(e), 21))),
    "week_split": _web(lambda e: week_rows(one_week(e))),
    "within_session_split": _web(P.within_session_split),
    "leave_last_out": _web(last_out_text),
}

_BONUS = "CASE WHEN a = 'clicks' AND b = 'clicks' THEN 1 WHEN a = 'clicks' AND b = 'carts' THEN 3 WHEN a = 'clicks' AND b = 'orders' THEN 4 WHEN a = 'carts' AND b = 'carts' THEN 6 WHEN a = 'carts' AND b = 'orders' THEN 7 WHEN a = 'orders' AND b = 'orders' THEN 10 END"
_ORDINAL = "CASE {0} WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END"


def _unified(gap: int) -> str:
    first, second = _ORDINAL.format("type1"), _ORDINAL.format("type2")
    return f"""tail AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, type DESC) AS i FROM ev),
    pairs AS (SELECT DISTINCT x.session, least(x.aid, y.aid) AS aid1, greatest(x.aid, y.aid) AS aid2, CASE WHEN x.aid < y.aid THEN x.type ELSE y.type END AS type1, CASE WHEN x.aid < y.aid THEN y.type ELSE x.type END AS type2
        FROM tail AS x JOIN tail AS y ON x.session = y.session AND x.i <= 30 AND y.i <= 30 AND y.i > x.i AND y.i - x.i <= 5 AND x.aid <> y.aid AND abs(x.ts - y.ts) < {gap}),
    sums AS (SELECT aid1, aid2, CAST(sum({_BONUS}) AS BIGINT) AS wgt FROM (SELECT *, CASE WHEN {first} <= {second} THEN type1 ELSE type2 END AS a, CASE WHEN {first} <= {second} THEN type2 ELSE type1 END AS b FROM pairs) GROUP BY aid1, aid2),
    edges AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY aid1 ORDER BY wgt DESC, aid2 DESC) AS INT) AS rank FROM (SELECT * FROM sums UNION ALL SELECT aid2, aid1, wgt FROM sums)) WHERE rank <= 20)"""


def _typed(gap: int, k: int, weight: str, types: str = "") -> str:
    return _sql(f"""SELECT aid, candidate_aid, round(wgt, 6) AS wgt, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY wgt DESC, candidate_aid) AS r FROM
        (SELECT aid, candidate_aid, CAST(sum(CAST({weight} AS DECIMAL(28, 9))) AS DOUBLE) AS wgt FROM kept, (SELECT min(ts) AS t0, max(ts) AS t1 FROM kept) GROUP BY aid, candidate_aid)) WHERE r <= {k}""", WEB_SQL,
        f"tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, type DESC) AS i FROM ev {types}) WHERE i <= 30)",
        f"kept AS (SELECT * FROM (SELECT x.session, x.aid, y.aid AS candidate_aid, x.ts, y.ts AS ts_y, y.type AS type_y, row_number() OVER (PARTITION BY x.session, x.aid, y.aid ORDER BY x.ts DESC, y.ts DESC, y.type DESC) AS n FROM tail AS x JOIN tail AS y ON x.session = y.session AND x.aid <> y.aid AND abs(x.ts - y.ts) < {gap}) WHERE n = 1)")


_PARTS = "h AS (SELECT *, max(ts) OVER (PARTITION BY session) - 86400000 AS cut, max(ts) OVER () AS top FROM ev), history AS (SELECT session, aid, ts, type FROM h WHERE ts <= cut AND ts >= top - 14 * 86400000), future AS (SELECT session, aid, ts, type FROM h WHERE ts > cut)"
_SPLIT = """m AS (SELECT *, min(ts) OVER (PARTITION BY session) AS first_ts, max(ts) OVER () - 604800000 AS cut FROM ev),
    tr0 AS (SELECT session, aid, ts, type FROM m WHERE first_ts <= cut AND ts < cut), train AS (SELECT tr0.* FROM tr0 SEMI JOIN (SELECT session FROM tr0 GROUP BY 1 HAVING count(*) >= 2) USING (session)),
    te0 AS (SELECT session, aid, ts, type FROM m SEMI JOIN train USING (aid) WHERE first_ts > cut), test AS (SELECT te0.* FROM te0 SEMI JOIN (SELECT session FROM te0 GROUP BY 1 HAVING count(*) >= 2) USING (session))"""
_SCENARIO = """mk AS (SELECT *, ts >= (SELECT min(ts) FROM ev) + 21 * 86400000 AS late FROM ev),
    sc AS (SELECT session, count(*) FILTER (NOT late) AS events_before, count(*) FILTER (late) AS events_after, count(*) FILTER (NOT late AND type = 'orders') AS orders_before, count(*) FILTER (late AND type = 'orders') AS orders_after, arg_max(type, (ts, aid, type)) AS last_type,
        CASE WHEN bool_and(late) THEN 3 WHEN bool_or(late) THEN 2 ELSE 1 END AS scenario FROM mk GROUP BY session)"""
_GAP_BUCKET = " + ".join(f"(g > {b})::INT" for b in (1, 10, 60, 300, 1800, 7200, 21600, 43200, 86400, 172800, 345600, 604800, 864000, 1209600, 1814400))



def _explore(session: str = "session", above: int = 1) -> str:
    weight = "CASE y.type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 3 ELSE 6 END"
    near = f"x.{session} = y.{session} AND x.aid <> y.aid AND abs(x.ts - y.ts) < 86400000"
    score = f"SELECT x.aid AS aid1, y.aid AS aid2, CAST(sum({weight}) AS BIGINT) AS score FROM ev AS x JOIN ev AS y ON {near}"
    return _sql(f"{score} GROUP BY 1, 2 HAVING score > {above}")


ORACLES = {
    "covisit_unified": _sql("SELECT * FROM edges", PURCHASE_SQL, _unified(86_400_000)),
    "covisit_unified_month": _sql("SELECT * FROM edges", PURCHASE_SQL, _unified(MONTH_MS)),
    "covisit_clicks": _typed(86_400_000, 20, "1.0 + 3.0 * CAST(ts - t0 AS DOUBLE) / greatest(t1 - t0, 1)"),
    "covisit_cart_order": _typed(86_400_000, 15, "CASE type_y WHEN 'clicks' THEN 1 WHEN 'carts' THEN 6 ELSE 3 END"),
    "covisit_buy2buy": _typed(14 * 86_400_000, 15, "1", "WHERE type IN ('carts', 'orders')"),
    "covisit_explore": _explore(),
    "covisit_explore_crowded": _explore("session % 5", 3),
    "adjacency_text": _sql("SELECT aid1 AS aid, string_agg(aid2 || ':' || wgt, ' ' ORDER BY wgt DESC, aid2 DESC) AS candidates FROM edges GROUP BY aid1", PURCHASE_SQL, _unified(MONTH_MS)),
    "gap_pairs": _sql(f"SELECT type1, type2, {_GAP_BUCKET} AS bucket, count(*) AS pairs FROM (SELECT x.type AS type1, y.type AS type2, (y.ts - x.ts) / 1000.0 AS g FROM tail AS x JOIN tail AS y ON x.session = y.session AND x.i > y.i AND x.i <= 30) GROUP BY ALL", WEB_SQL, "tail AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, type DESC) AS i FROM ev)"),
    "bipartite_edges": _sql("SELECT s AS src, i AS dst, w AS weight FROM e UNION ALL SELECT i, s, w FROM e", PURCHASE_SQL, """ss AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS s FROM (SELECT DISTINCT session FROM ev)), ii AS (SELECT aid, row_number() OVER (ORDER BY aid) - 1 + (SELECT count(*) FROM ss) AS i FROM (SELECT DISTINCT aid FROM ev)),
        e AS (SELECT s, i, max(CASE type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 6 ELSE 3 END) AS w FROM ev JOIN ss USING (session) JOIN ii USING (aid) GROUP BY ALL)"""),
    "future_labels": _sql("""SELECT session, aid, ts, type, next_click, coalesce(array_to_string(list_sort(list_distinct(c)), ' '), '') AS later_carts, coalesce(array_to_string(list_sort(list_distinct(o)), ' '), '') AS later_orders FROM (SELECT *, first(CASE WHEN type = 'clicks' THEN aid END IGNORE NULLS) OVER w AS next_click,
        array_agg(CASE WHEN type = 'carts' THEN aid END) OVER w AS c, array_agg(CASE WHEN type = 'orders' THEN aid END) OVER w AS o, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts, aid, type ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE n > 0"""),
    "history_split": _sql("SELECT *, 'history' AS part FROM history UNION ALL SELECT *, 'future' FROM future", WEB_SQL, _PARTS),
    "ground_truth": _sql("SELECT session, type, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY aid) AS ground_truth FROM (SELECT DISTINCT session, type, aid FROM future) GROUP BY ALL", WEB_SQL, _PARTS),
    "temporal_split": _sql("SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test", WEEKLY_SQL, _SPLIT),
    "split_checks": _sql("""SELECT 'no shared sessions' AS "check", (SELECT count(*) FROM (SELECT session FROM train INTERSECT SELECT session FROM test)) = 0 AS passed UNION ALL SELECT 'test items known', (SELECT count(*) FROM test ANTI JOIN train USING (aid)) = 0
        UNION ALL SELECT 'train sessions have two events', (SELECT count(*) FROM (SELECT session FROM train GROUP BY 1 HAVING count(*) < 2)) = 0 UNION ALL SELECT 'test sessions have two events', (SELECT count(*) FROM (SELECT session FROM test GROUP BY 1 HAVING count(*) < 2)) = 0
        UNION ALL SELECT 'no nulls', (SELECT count(*) FROM (SELECT * FROM train UNION ALL SELECT * FROM test) WHERE session IS NULL OR aid IS NULL OR ts IS NULL OR type IS NULL) = 0 UNION ALL SELECT 'train ends before test', coalesce((SELECT max(ts) FROM train) <= (SELECT min(ts) FROM test), true)""", WEEKLY_SQL, _SPLIT),
    "truncated_sessions": _sql("""SELECT session, p AS prefix_length, arg_min(aid, place) FILTER (type = 'clicks' AND place > p) AS next_click, coalesce(array_to_string(list_sort(list_distinct(array_agg(aid) FILTER (type = 'carts' AND place > p))), ' '), '') AS carts, coalesce(array_to_string(list_sort(list_distinct(array_agg(aid) FILTER (type = 'orders' AND place > p))), ' '), '') AS orders
        FROM (SELECT *, session % (n - 1) + 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, aid, type) AS place, count(*) OVER (PARTITION BY session) AS n FROM ev) WHERE n >= 2) GROUP BY session, p"""),
    "week_scenarios": _sql("SELECT * FROM sc", WEEKLY_SQL, _SCENARIO),
    "scenario_summary": _sql("SELECT scenario, count(*) AS sessions, count(*) FILTER (orders_before > 0 AND orders_after > 0) AS orders_both, count(*) FILTER (events_before > events_after) AS mostly_before, count(*) FILTER (last_type = 'orders') AS end_in_order, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM sc GROUP BY scenario", WEEKLY_SQL, _SCENARIO),
    "week_split": _sql("SELECT session, aid, ts, type, CASE WHEN scenario = 3 THEN 'valid' ELSE 'train' END AS part FROM mk JOIN sc USING (session) WHERE scenario = 3 OR NOT late", WEEKLY_SQL, _SCENARIO),
    "within_session_split": _sql("SELECT *, ts <= min(ts) OVER w + 0.8 * (max(ts) OVER w - min(ts) OVER w) AS is_train FROM ev WINDOW w AS (PARTITION BY session)"),
    "leave_last_out": _sql("SELECT session, array_to_string(CASE WHEN len(x) >= 3 THEN x[:-3] WHEN len(x) = 2 THEN x[:1] ELSE x END, ' ') AS train, CASE WHEN len(x) >= 3 THEN x[-2] END AS valid, CASE WHEN len(x) >= 2 THEN x[-1] END AS test FROM (SELECT session, array_agg(aid ORDER BY ts, aid, type) AS x FROM ev GROUP BY session)"),
}
