"""Queries: ranking quality; with DuckDB SQL. Predictions are each session's last distinct items before its last day, truth what comes in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.operators import evaluate as E
from sessionloom.operators import splits as P
from sessionloom.plans.analytics import _sql, rounded
from sessionloom.plans.graphs import _PARTS
from sessionloom.sources.events import WEB_SQL, web_events


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    history, future = P.history_split(web_events(spark, d))
    last = history.groupBy("session", "aid").agg(F.max("ts").alias("ts"))
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ts"), "aid"))).filter("rank <= 20")
    return ranked.select("session", "rank", "aid"), future


def ranking(spark: SparkSession, d: str) -> DataFrame:
    predictions, future = _lists(spark, d)
    return rounded(E.ranking_metrics(predictions, future))


def ranking_means(spark: SparkSession, d: str) -> DataFrame:
    predictions, future = _lists(spark, d)
    return rounded(E.mean_metrics(E.ranking_metrics(predictions, future)))


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    predictions, future = _lists(spark, d)
    return predictions.withColumn("type", F.explode(F.array(F.lit("clicks"), F.lit("carts"), F.lit("orders")))), future


def competition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.competition_recall(*_typed(spark, d)))


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.weighted_recall(E.competition_recall(*_typed(spark, d))))


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Relevance: 1 for a click, 2 for a cart, 3 for an order."""
    predictions, future = _lists(spark, d)
    level = F.when(F.col("type") == "orders", 3).when(F.col("type") == "carts", 2).otherwise(1)
    return rounded(E.hit_rate(predictions, future.groupBy("session", "aid").agg(F.max(level).alias("relevance"))))


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    """Each session's items with their number of events as score; the greatest item is the target."""
    events = web_events(spark, d)
    counts = events.groupBy("session", "aid").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return counts.withColumn("is_target", (F.col("aid") == F.max("aid").over(Window.partitionBy("session"))).cast("int"))


def sampled(ties: str):
    return lambda spark, d: rounded(E.sampled_rank(_sampled(spark, d), ties=ties))


def online(spark: SparkSession, d: str) -> DataFrame:
    predictions, future = _lists(spark, d)
    third = lambda a, b: F.transform(F.filter("x", lambda y: y["rank"].between(a, b)), lambda y: y["aid"])
    lists = predictions.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("x")).select("session", third(1, 7).alias("clicks"), third(8, 14).alias("carts"), third(15, 20).alias("orders"))
    return rounded(E.online_hits(lists, future.select("session", "aid", "type")))


QUERIES = {
    "ranking_metrics": ranking,
    "ranking_means": ranking_means,
    "competition_recall": competition,
    "weighted_recall": weighted,
    "graded_hit_rate": graded,
    "sampled_rank": sampled("standard"),
    "sampled_rank_conservative": sampled("conservative"),
    "sampled_rank_median": sampled("median"),
    "online_hits": online,
}

_BASE = (WEB_SQL, _PARTS, "pred AS (SELECT * FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY max(ts) DESC, aid) AS rank FROM history GROUP BY session, aid) WHERE rank <= 20)")
_METRICS = """met AS (SELECT session, coalesce(hits / n_distinct, 0) AS recall, coalesce(1.0 / first, 0) AS mrr, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n_all, 20) AS BIGINT) + 1) AS r(i)), 0) AS ndcg FROM (SELECT session, count(*) AS n_all, count(DISTINCT aid) AS n_distinct FROM future GROUP BY 1)
    LEFT JOIN (SELECT session, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM pred SEMI JOIN future USING (session, aid) GROUP BY 1) USING (session))"""
_RECALL = """rec AS (SELECT type, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(m) AS BIGINT) AS possible, sum(h) / sum(m) AS recall FROM (SELECT f.session, f.type, least(count(*), 20) AS m, count(p.aid) AS h FROM (SELECT DISTINCT session, type, aid FROM future) AS f LEFT JOIN pred AS p ON f.session = p.session AND f.aid = p.aid GROUP BY 1, 2) GROUP BY type)"""


def _sampled_sql(place: str) -> str:
    return _sql(f"""SELECT count(*) AS sessions, round(avg((r <= 10)::INT), 6) AS hit_rate, round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg FROM (SELECT t.session, 1 + {place} AS r FROM c AS t LEFT JOIN c AS o ON t.session = o.session AND o.aid <> t.aid WHERE t.aid = t.top GROUP BY t.session)""", WEB_SQL, "c AS (SELECT session, aid, count(*) AS s, max(aid) OVER (PARTITION BY session) AS top FROM ev GROUP BY session, aid)")


_ABOVE, _EQUAL = "count(*) FILTER (o.s > t.s)", "count(*) FILTER (o.s = t.s)"
ORACLES = {
    "ranking_metrics": _sql("SELECT session, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM met", *_BASE, _METRICS),
    "ranking_means": _sql("SELECT count(*) AS sessions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met", *_BASE, _METRICS),
    "competition_recall": _sql("SELECT type, hits, possible, round(recall, 6) AS recall FROM rec", *_BASE, _RECALL),
    "weighted_recall": _sql("SELECT round(sum(recall * CASE type WHEN 'clicks' THEN 0.1 WHEN 'carts' THEN 0.3 ELSE 0.6 END), 6) AS weighted_recall FROM rec", *_BASE, _RECALL),
    "graded_hit_rate": _sql("""SELECT count(*) AS sessions, round(avg((dcg IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg FROM (SELECT session, sum((2 ** rel - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rel DESC, aid) AS r FROM truth) WHERE r <= 20 GROUP BY 1)
        LEFT JOIN (SELECT session, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg FROM pred JOIN truth USING (session, aid) GROUP BY 1) USING (session)""", *_BASE, "truth AS (SELECT session, aid, max(CASE type WHEN 'orders' THEN 3 WHEN 'carts' THEN 2 ELSE 1 END) AS rel FROM future GROUP BY ALL)"),
    "sampled_rank": _sampled_sql(_ABOVE),
    "sampled_rank_conservative": _sampled_sql(f"{_ABOVE} + {_EQUAL}"),
    "sampled_rank_median": _sampled_sql(f"{_ABOVE} + {_EQUAL} / 2"),
    "online_hits": _sql("SELECT f.session, f.aid, f.type AS event_type, rank IS NOT NULL AS is_hit, coalesce((rank IS NOT NULL)::INT::DOUBLE, 0) AS recall, round(coalesce(1.0 / rank, 0), 6) AS mrr, round(coalesce(1 / log2(rank + 1), 0), 6) AS ndcg FROM future AS f SEMI JOIN pred USING (session) LEFT JOIN pred AS p ON p.session = f.session AND p.aid = f.aid WHERE f.type IN ('carts', 'orders')", *_BASE),
}
