"""Queries over result tables as serving and monitoring ask them; the tables are made from the test data. With DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.normalize import gap_bucket, type_code, type_name
from sessionloom.operators import items as I
from sessionloom.operators import reports as B
from sessionloom.operators import sessions as S
from sessionloom.operators.ordered import quantiles
from sessionloom.plans.analytics import _COUNTS, _sql, rounded
from sessionloom.sources.events import WEB_SQL, web_events


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a log of predictions: customer as session, priority as model, price as latency."""
    return _orders(spark, d).select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("model_used"), F.col("o_totalprice").alias("latency_ms"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a log of micro-batches: quantity and its half rows in and out a second, price as duration."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select((F.col("l_quantity") - 1).alias("input_rows_per_second"), (F.col("l_quantity") / 2).alias("process_rows_per_second"), F.col("l_extendedprice").alias("batch_duration_ms"))


def popular_scoped(spark: SparkSession, d: str) -> DataFrame:
    events = web_events(spark, d)
    scope = F.when(F.col("ts") % 2 == 0, "even").otherwise("odd")
    return events.groupBy(F.col("type").alias("event_type"), scope.alias("time_scope"), "aid").agg(F.count(F.lit(1)).alias("count"))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Age of events when the last one comes, in seconds."""
    events = web_events(spark, d)
    top = F.broadcast(events.agg(F.max("ts").alias("now")))
    return rounded(B.freshness(events.crossJoin(top).withColumn("created_sec", F.col("ts") / 1000.0), F.col("now") / 1000.0))


def sla(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on quantiles of the order prices as latencies."""
    orders = _orders(spark, d)
    p50, p95 = quantiles(orders.select((F.col("o_totalprice") / 1000).alias("ms")), "ms", (0.5, 0.95))
    figures = orders.agg(F.lit(p50).cast("double").alias("api_p50_ms"), F.lit(p95).cast("double").alias("api_p95_ms"), F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("error_rate"))
    rows = figures.unpivot([], ["api_p50_ms", "api_p95_ms", "error_rate"], "metric", "value")
    judged = F.lit(None).cast("string")
    for m in ("api_p50_ms", "api_p95_ms", "error_rate"):
        judged = F.when(F.col("metric") == m, B.verdict(m, F.col("value"))).otherwise(judged)
    return rounded(rows.withColumn("verdict", judged))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Carts and orders of items with an even number are hits."""
    events = web_events(spark, d).filter("type != 'clicks'")
    return rounded(B.hit_summary(events.select(F.col("type").alias("event_type"), (F.col("aid") % 2 == 0).alias("is_hit"))))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    events = web_events(spark, d)
    return events.select(F.concat(F.lit("m"), (F.col("session") % 3).cast("string")).alias("model_used"), F.when(F.col("ts") % 2 == 0, "recall@20").otherwise("mrr@20").alias("metric_name"), F.col("type").alias("event_type"), (F.col("aid") / 100.0).alias("metric_value"), F.col("ts").alias("created_at"))


def funnel_stages(spark: SparkSession, d: str) -> DataFrame:
    events = web_events(spark, d)
    funnels = S.funnel(events).withColumn("computed_at", F.lit(1)).filter("total_sessions < 0")
    return B.funnel_display(funnels, I.traffic(events, 3_600_000))


def funnel_computed(spark: SparkSession, d: str) -> DataFrame:
    """With a funnel row the display takes it, not the last hour."""
    events = web_events(spark, d)
    return B.funnel_display(S.funnel(events).withColumn("computed_at", F.lit(1)), I.traffic(events, 3_600_000))


def gauge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.weighted_gauge(metrics(spark, d), "recall@20"))


def rewritten_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rows written twice, the second time with the events of carts and orders alone: the later row of a window stands."""
    events = web_events(spark, d)
    hourly = lambda rows, shift: I.traffic(rows, 3_600_000).select("window_start", "total_events", (F.col("window_start") + shift).alias("id"))
    return B.last_per_window(hourly(events, 0).unionByName(hourly(events.filter("type != 'clicks'"), 1)))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return web_events(spark, d).filter("session = 7").orderBy("ts", "aid")


def recoded(spark: SparkSession, d: str) -> DataFrame:
    """Types through their codes and back, and gaps in buckets."""
    rows = S.interarrival(web_events(spark, d)).withColumn("code", type_code())
    return rows.groupBy(F.col("code").alias("code"), type_name(F.col("code")).alias("name"), gap_bucket(F.coalesce("gap_sec", F.lit(0.0))).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


QUERIES = {
    "prediction_stats": lambda s, d: rounded(B.prediction_stats(predictions(s, d))),
    "model_usage": lambda s, d: rounded(B.model_usage(predictions(s, d))),
    "batch_health": lambda s, d: rounded(B.batch_health(batches(s, d))),
    "popular_ranks": lambda s, d: B.ranked(popular_scoped(s, d)),
    "freshness": freshness,
    "sla_verdicts": sla,
    "hit_summary": hits,
    "metric_trend": lambda s, d: rounded(B.metric_trend(metrics(s, d), "recall@20")),
    "metric_summary": lambda s, d: rounded(B.metric_summary(metrics(s, d))),
    "funnel_stages": funnel_stages,
    "funnel_computed": funnel_computed,
    "metric_gauge": gauge,
    "rewritten_windows": rewritten_windows,
    "funnel_melted": lambda s, d: B.melted(S.funnel(web_events(s, d))),
    "active_sessions": lambda s, d: B.active_sessions(web_events(s, d), F.lit(1_706_000_000_000)),
    "top_predictions": lambda s, d: B.latest(_orders(s, d).select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20),
    "best_converting_items": lambda s, d: rounded(B.latest(I.item_conversion(web_events(s, d)), [F.desc("click_to_order_rate"), F.asc("aid")], 20)),
    "session_lookup": point_lookup,
    "recoded_types": recoded,
}

ORACLES = {
    "prediction_stats": "SELECT count(*) AS predictions, round(avg(o_totalprice), 6) AS avg_latency_ms, count(DISTINCT o_custkey) AS sessions FROM orders",
    "model_usage": "SELECT o_orderpriority AS model_used, count(*) AS count, round(avg(o_totalprice), 6) AS avg_latency_ms FROM orders GROUP BY 1",
    "batch_health": """SELECT batches, round(avg_ms, 6) AS avg_ms, max_ms, round(rps, 6) AS avg_rows_per_second, round(efficiency, 6) AS efficiency, slow_batches, round(avg_ms / 10000, 6) AS stability, CASE WHEN avg_ms / 10000 < 0.5 THEN 'STABLE' WHEN avg_ms / 10000 < 1 THEN 'BUSY' ELSE 'UNSTABLE' END AS verdict
        FROM (SELECT count(*) AS batches, avg(l_extendedprice) AS avg_ms, round(max(l_extendedprice), 6) AS max_ms, avg(l_quantity / 2) AS rps, avg((l_quantity / 2) / nullif(l_quantity - 1, 0)) AS efficiency, count(*) FILTER (l_extendedprice > 10000) AS slow_batches FROM lineitem)""",
    "popular_ranks": _sql("SELECT event_type, time_scope, aid, count, CAST(row_number() OVER (PARTITION BY event_type, time_scope ORDER BY count DESC, aid) AS INT) AS rank FROM (SELECT type AS event_type, CASE WHEN ts % 2 = 0 THEN 'even' ELSE 'odd' END AS time_scope, aid, count(*) AS count FROM ev GROUP BY ALL)"),
    "freshness": _sql("SELECT events, round(a, 6) AS avg_age, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, round(m, 6) AS max_age, CASE WHEN p50 < 10 THEN 'PASS' WHEN p50 < 30 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM (SELECT count(*) AS events, avg(g) AS a, quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.9) AS p90, quantile_cont(g, 0.95) AS p95, max(g) AS m FROM (SELECT CAST(max(ts) OVER () - ts AS DOUBLE) / 1000.0 AS g FROM ev))"),
    "sla_verdicts": """WITH q AS (SELECT quantile_cont(o_totalprice / 1000, 0.5) AS a, quantile_cont(o_totalprice / 1000, 0.95) AS b, avg((o_orderstatus = 'P')::INT) AS c FROM orders)
        SELECT 'api_p50_ms' AS metric, round(a, 6) AS value, CASE WHEN a < 100 THEN 'PASS' WHEN a < 200 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM q UNION ALL SELECT 'api_p95_ms', round(b, 6), CASE WHEN b < 200 THEN 'PASS' WHEN b < 500 THEN 'WARN' ELSE 'FAIL' END FROM q UNION ALL SELECT 'error_rate', round(c, 6), CASE WHEN c < 0.001 THEN 'PASS' WHEN c < 0.01 THEN 'WARN' ELSE 'FAIL' END FROM q""",
    "hit_summary": _sql("SELECT type AS event_type, count(*) AS events, count(*) FILTER (aid % 2 = 0) AS hits, round(avg((aid % 2 = 0)::INT), 6) AS hit_rate FROM ev WHERE type <> 'clicks' GROUP BY type"),
    "metric_trend": _sql("SELECT 'm' || (session % 3) AS model_used, round(avg(aid / 100.0), 6) AS avg_value, count(*) AS count, max(ts) AS last_at FROM ev WHERE ts % 2 = 0 GROUP BY 1"),
    "metric_summary": _sql("SELECT 'm' || (session % 3) AS model_used, CASE WHEN ts % 2 = 0 THEN 'recall@20' ELSE 'mrr@20' END AS metric_name, type AS event_type, round(avg(aid / 100.0), 6) AS avg_value, count(*) AS count FROM ev GROUP BY 1, 2, 3"),
    "funnel_stages": _sql("SELECT 'clicks' AS stage, total_clicks AS sessions FROM h UNION ALL SELECT 'carts', total_carts FROM h UNION ALL SELECT 'orders', total_orders FROM h", WEB_SQL, f"h AS (SELECT {_COUNTS} FROM ev GROUP BY ts // 3600000 ORDER BY ts // 3600000 DESC LIMIT 1)"),
    "funnel_melted": _sql("SELECT 'sessions_with_' || t AS stage, count(DISTINCT session) FILTER (type = t) AS sessions FROM ev, unnest(['clicks', 'carts', 'orders']) AS u(t) GROUP BY t"),
    "active_sessions": _sql("SELECT count(*) FILTER (m > 1706000000000 - 1800000) AS active_sessions FROM (SELECT max(ts) AS m FROM ev GROUP BY session)"),
    "top_predictions": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "best_converting_items": _sql(f"""SELECT aid, total_clicks, total_carts, total_orders, round(CASE WHEN total_clicks > 0 THEN total_carts / total_clicks ELSE 0 END, 6) AS click_to_cart_rate, round(r, 6) AS click_to_order_rate, round(CASE WHEN total_carts > 0 THEN total_orders / total_carts ELSE 0 END, 6) AS cart_to_order_rate
        FROM (SELECT *, CASE WHEN total_clicks > 0 THEN total_orders / total_clicks ELSE 0 END AS r FROM (SELECT aid, {_COUNTS} FROM ev GROUP BY aid)) ORDER BY r DESC, aid LIMIT 20"""),
    "funnel_computed": _sql("SELECT t AS stage, count(DISTINCT session) FILTER (type = t) AS sessions FROM ev, unnest(['clicks', 'carts', 'orders']) AS u(t) GROUP BY t"),
    "metric_gauge": _sql("SELECT round(100.0 * avg(v), 6) AS gauge_pct FROM (SELECT avg(aid / 100.0) AS v FROM ev WHERE ts % 2 = 0 GROUP BY session % 3, type)"),
    "rewritten_windows": _sql("SELECT window_start, CASE WHEN m > 0 THEN m ELSE n END AS total_events, window_start + (m > 0)::INT AS id FROM (SELECT ts // 3600000 * 3600000 AS window_start, count(*) AS n, count(*) FILTER (type <> 'clicks') AS m FROM ev GROUP BY 1)"),
    "session_lookup": _sql("SELECT * FROM ev WHERE session = 7"),
    "recoded_types": _sql("SELECT CASE type WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END AS code, type AS name, " + " + ".join(f"(g > {b})::INT" for b in (1, 10, 60, 300, 1800, 7200, 21600, 43200, 86400, 172800, 345600, 604800, 864000, 1209600, 1814400)) + " AS bucket, count(*) AS events FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, aid, type)) / 1000.0, 0) AS g FROM ev) GROUP BY ALL"),
}
