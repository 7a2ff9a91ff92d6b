"""Queries: interaction matrices and samples; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import evaluate as E
from sessionloom.operators import interactions as N
from sessionloom.plans.analytics import _sql, _weeks, rounded
from sessionloom.plans.evaluation import _BASE, _METRICS, _lists
from sessionloom.sources.events import WEB_SQL, web_events

#: Sessions that the sampled metrics look at, as in the evaluation of embeddings.
SAMPLED_SESSIONS = 1000


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return N.interaction_matrices(*_weeks(web_events(spark, d)))[0]


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return N.interaction_matrices(*_weeks(web_events(spark, d)))[1].groupBy("user", "item").agg(F.count(F.lit(1)).alias("purchases"))


def sampled_recall(spark: SparkSession, d: str) -> DataFrame:
    predictions, future = _lists(spark, d)
    return rounded(E.mean_metrics(E.ranking_metrics(predictions, N.sessions_by_draw(future, SAMPLED_SESSIONS))))


def activity_weights(spark: SparkSession, d: str) -> DataFrame:
    """Each item's weight: views count 1 and purchases 3, times how many cells the user has. The matrix in row blocks, multiplied."""
    cells = matrix(spark, d).select(F.col("user").alias("row"), F.col("item").alias("col"), F.when(F.col("behaviour") == "buy", 3).otherwise(1).alias("value"))
    active = cells.groupBy("row").agg(F.count(F.lit(1)).alias("factor"))
    return N.transposed_product(N.row_blocks(cells), active).select(F.col("col").alias("item"), F.col("value").cast("long").alias("weight"))


QUERIES = {
    "interaction_matrix": matrix,
    "activity_weights": activity_weights,
    "held_out_purchases": held_out,
    "session_sample": lambda spark, d: N.session_sample(web_events(spark, d), 0.1),
    "event_sample": lambda spark, d: N.event_sample(web_events(spark, d), 0.1),
    "sampled_recall": sampled_recall,
    "row_sample": lambda spark, d: N.row_sample(web_events(spark, d), 500),
}

_WEEK = "w AS (SELECT *, ts < (SELECT min(ts) FROM ev) + 3 * 604800000 AS early FROM ev)"
_MATRIX = """pv AS (SELECT DISTINCT session AS u, aid AS i FROM w WHERE type = 'clicks'), buy AS (SELECT DISTINCT session AS u, aid AS i FROM w WHERE type = 'orders' AND early),
    users AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS "user" FROM (SELECT u FROM pv INTERSECT SELECT u FROM buy)),
    seen AS (SELECT 'pv' AS behaviour, * FROM pv SEMI JOIN users USING (u) UNION ALL SELECT 'buy', * FROM buy SEMI JOIN users USING (u)),
    items AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS item FROM (SELECT DISTINCT i FROM seen WHERE i IS NOT NULL))"""


def _draw(key: str) -> str:
    return f"CAST('0x' || substr(md5('42:' || {key}), 1, 8) AS BIGINT) / 4294967296.0"


ORACLES = {
    "activity_weights": _sql(
        """SELECT item, CAST(sum(CASE behaviour WHEN 'buy' THEN 3 ELSE 1 END * cells) AS BIGINT) AS weight
        FROM seen JOIN items USING (i) JOIN (SELECT u, count(*) AS cells FROM seen WHERE i IS NOT NULL GROUP BY u) USING (u) GROUP BY item""",
        WEB_SQL, _WEEK, _MATRIX,
    ),
    "interaction_matrix": _sql('SELECT behaviour, "user", item FROM seen JOIN users USING (u) JOIN items USING (i)', WEB_SQL, _WEEK, _MATRIX),
    "held_out_purchases": _sql("""SELECT "user", item, count(*) AS purchases FROM w JOIN users ON w.session = u JOIN items ON w.aid = i WHERE type = 'orders' AND NOT early GROUP BY ALL""", WEB_SQL, _WEEK, _MATRIX),
    "session_sample": _sql(f"SELECT * FROM ev WHERE {_draw('CAST(session AS VARCHAR)')} < 0.1", WEB_SQL),
    "event_sample": _sql(f"""SELECT * FROM ev WHERE {_draw("concat_ws(':', coalesce(CAST(session AS VARCHAR), ''), coalesce(CAST(aid AS VARCHAR), ''), coalesce(CAST(ts AS VARCHAR), ''), coalesce(type, ''))")} < 0.1""", WEB_SQL),
    "row_sample": _sql(f"SELECT session, aid FROM (SELECT DISTINCT session, aid FROM ev) ORDER BY {_draw("session || ':' || aid")}, session, aid LIMIT 500", WEB_SQL),
    "sampled_recall": _sql(
        f"""SELECT count(*) AS sessions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met SEMI JOIN
        (SELECT session FROM (SELECT DISTINCT session FROM future WHERE session IS NOT NULL) ORDER BY {_draw('CAST(session AS VARCHAR)')}, session LIMIT {SAMPLED_SESSIONS}) USING (session)""", *_BASE, _METRICS,
    ),
}
