"""Queries that run as streams over files until nothing is left, and give what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.plans.analytics import _POPULAR, WEB_SQL, _sql, rounded, with_model
from sessionloom.plans.analytics import ORACLES as _analytics
from sessionloom.plans.graphs import _unified
from sessionloom.sources.events import PURCHASE_SQL, TASK_ROWS, decode_messages, micros, web_events
from sessionloom.sources.folders import shared_folder
from sessionloom.streaming import keyed
from sessionloom.streaming import unified as U
from sessionloom.streaming.graph import GraphSink
from sessionloom.streaming.sinks import AppendSink, MergeSink, messages


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` file as a stream of events, with a model for each session."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = "events*.parquet"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(sf_dir)
    rows = rows.filter("event_type in ('view', 'click', 'signup', 'purchase')")
    kind = F.when(F.col("event_type").isin("view", "click"), "clicks").when(F.col("event_type") == "signup", "carts").otherwise("orders")
    flat = rows.select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("aid"), F.floor(micros("ts") / 1000).alias("ts"), kind.alias("type"))
    return with_model(flat)


#: Rows of a file that a stream reads, so that a batch of many rows is many tasks.
FILE_ROWS = 1 << 17


def quarter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in four parts, one a quarter of their time, each a batch of its own, of as many files as any other."""
    base, events = _folder(spark), with_model(web_events(spark, sf_dir)).persist()
    first, last, rows = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    files = min(events.rdd.getNumPartitions(), max(1, -(-rows // (4 * FILE_ROWS))))
    starts = [first + -(-(last - first + 1) * k // 4) for k in range(5)]
    for k in range(4):
        events.filter((F.col("ts") >= starts[k]) & (F.col("ts") < starts[k + 1])).coalesce(files).write.mode("append").parquet(f"{base}/events")
        # tasks without rows write no file, and a batch is told by its number of files
        for _ in range(files * (k + 1) - len(spark.read.schema(events.schema).parquet(f"{base}/events").inputFiles())):
            events.limit(0).coalesce(1).write.mode("append").parquet(f"{base}/events")
    events.unpersist()
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/events")


KEYS = {"popular_items": ["time_scope", "event_type", "aid"], "stats_items": ["aid"], "stats_sessions": ["session_type"], "advanced_funnel_stats": ["model_used"]}


def run_unified(spark: SparkSession, stream: DataFrame, table: str) -> DataFrame:
    base = _folder(spark)
    sink = MergeSink(f"{base}/{table}", KEYS[table]) if table in KEYS else AppendSink(f"{base}/{table}")
    query = U.start_compat(stream, {table: sink}, f"{base}/checkpoint", {"availableNow": True}, exact=True)
    query.awaitTermination()
    return sink.read(spark).drop("part", "batch_id")


def streamed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(run_unified(spark, event_stream(spark, sf_dir), "stats_items"))


def streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(run_unified(spark, event_stream(spark, sf_dir), "stats_sessions"))


def streamed_item_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: of each item the counters of the last batch that has it."""
    return rounded(run_unified(spark, quarter_stream(spark, sf_dir), "stats_items"))


def streamed_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: of each item and type the count and rank of the last batch that lists it."""
    return run_unified(spark, quarter_stream(spark, sf_dir), "popular_items")


def streamed_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(run_unified(spark, quarter_stream(spark, sf_dir), "advanced_funnel_stats"))


def streamed_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, each with traffic of its own: a minute that two of them share has two rows."""
    return rounded(run_unified(spark, quarter_stream(spark, sf_dir), "stats_hourly"))


def streamed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages, some of them broken, decoded from a stream of text; the time moved by seven hours."""
    base, events = _folder(spark), web_events(spark, sf_dir)
    broken = events.limit(5).select(F.lit("no json").alias("value"))
    messages(events).select("value").union(broken).write.text(f"{base}/messages")
    stream = spark.readStream.text(f"{base}/messages")
    return _appended(spark, U.from_messages(decode_messages(stream), 7).drop("model_used"))


def streamed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice; repeats within the watermark are dropped."""
    stream = event_stream(spark, sf_dir).drop("model_used")
    return _appended(spark, U.without_repeats(stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")))


def _appended(spark: SparkSession, stream: DataFrame) -> DataFrame:
    base = _folder(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows under a watermark, distinct counts by sketches. Windows that end after the watermark (the last event less two minutes) are not out yet."""
    return _appended(spark, U.windowed_traffic(event_stream(spark, sf_dir), width="1 hour"))


def _counted(windows: DataFrame) -> DataFrame:
    """Windows without the sketches; their ends as milliseconds."""
    return rounded(windows.select(F.unix_millis("window_start").alias("window_start"), F.unix_millis("window_end").alias("window_end"), "total_events", *(f"total_{t}" for t in ("clicks", "carts", "orders")), "click_to_cart_rate", "cart_to_order_rate"))


def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_appended(spark, U.windowed_traffic(event_stream(spark, sf_dir), width="1 hour")))


def streamed_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_appended(spark, U.windowed_traffic(event_stream(spark, sf_dir), width="1 hour", slide="30 minutes")))


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    found = _appended(spark, U.session_windows(event_stream(spark, sf_dir)))
    return found.withColumns({c: F.unix_millis(c) for c in ("session_start", "session_end")})


def streamed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions kept as keyed state over four batches, those that the watermark has ended."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.rocksdb(spark)
    try:
        return _appended(spark, keyed.session_features(quarter_stream(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def _shown(events: DataFrame) -> DataFrame:
    """At each cart of a session, the list that it was shown a minute before: the item of the cart, then those numbered next."""
    carts = events.filter("type = 'carts'")
    next_ones = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda k: F.col("aid") + k)
    return carts.select("session", (F.col("ts") - 60_000).alias("shown_at"), next_ones(0, 6).alias("clicks"), next_ones(7, 13).alias("carts"), next_ones(14, 20).alias("orders"))


def streamed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists shown and what was bought within three days, as two streams joined under their watermarks."""
    base, events = _folder(spark), web_events(spark, sf_dir).persist()
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    for name, rows, at in (("events", events, "ts"), ("lists", _shown(events), "shown_at")):
        quarter = F.floor((F.col(at) - F.lit(first)) * 4 / F.lit(last - first + 1))
        for k in range(4):
            rows.filter(F.greatest(quarter, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"{base}/{name}").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
    found = keyed.online_hits(stream("lists"), stream("events"), "3 days")
    events.unpersist()
    return rounded(_appended(spark, found))


def streamed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified graph after four batches, each of which changes what its sessions touch."""
    base = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sink = GraphSink(f"{base}/graph", gap_ms=30 * 86_400_000, parts=max(8, -(-rows // TASK_ROWS)))
    writer = quarter_stream(spark, sf_dir).writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark)


#: Three standard errors of a sketch of 2 ** 12 registers.
SKETCH_ERROR = 3 * 1.04 / 64


def streamed_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the sketches of minutes that four batches stored; whether the estimates are within the stated error of the exact counts."""
    base = _folder(spark)
    sink = MergeSink(f"{base}/sketches", ["window_start", "model_used"], add=("total_events",), sketches=("session_sketch", "aid_sketch"))
    writer = quarter_stream(spark, sf_dir).writeStream.foreachBatch(lambda rows, k: sink.write(U.traffic_sketches(rows), k))
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    day = lambda c: F.floor(F.col(c) / 86_400_000).alias("day")
    found = U.united(sink.read(spark), {"day": day("window_start")})
    exact = web_events(spark, sf_dir).groupBy(day("ts").alias("of_day")).agg(F.count_distinct("session").alias("sessions"), F.count_distinct("aid").alias("aids"))
    near = lambda c: (F.abs(F.col(f"unique_{c}") - F.col(c)) <= F.greatest(F.lit(1.0), SKETCH_ERROR * F.col(c))).alias(f"{c}_within")
    return found.join(exact, F.col("day") == F.col("of_day")).select("day", "total_events", "sessions", "aids", near("sessions"), near("aids"))


def six_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream that writes all six tables; of each table its rows and the sum of its counts."""
    base = _folder(spark)
    sinks = {name: MergeSink(f"{base}/{name}", KEYS[name]) if name in KEYS else AppendSink(f"{base}/{name}") for name in U.TABLES}
    query = U.start_compat(event_stream(spark, sf_dir), sinks, f"{base}/checkpoint", {"availableNow": True}, exact=True)
    query.awaitTermination()
    counted = {"stats_hourly": "total_events", "anomaly_logs": "event_count", "popular_items": "count", "stats_items": "total_clicks", "advanced_funnel_stats": "total_sessions", "stats_sessions": "count"}
    parts = [sinks[name].read(spark).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(c).alias("counted")).select("name", "rows", "counted") for name, c in counted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "streamed_features": streamed_features,
    "streamed_hits": streamed_hits,
    "streamed_graph": streamed_graph,
    "streamed_uniques": streamed_uniques,
    "six_tables": six_tables,
    "streamed_items": streamed_items,
    "streamed_segments": streamed_segments,
    "streamed_item_batches": streamed_item_batches,
    "streamed_popular": streamed_popular,
    "streamed_funnel": streamed_funnel,
    "streamed_traffic": streamed_traffic,
    "streamed_messages": streamed_messages,
    "streamed_distinct": streamed_distinct,
    "streamed_windows": streamed_windows,
    "streamed_hours": streamed_hours,
    "streamed_slides": streamed_slides,
    "streamed_sessions": streamed_sessions,
}
_QUARTERS = "b AS (SELECT *, ((ts - (SELECT min(ts) FROM ev)) * 4) // (SELECT max(ts) - min(ts) + 1 FROM ev) AS q FROM ev)"
_COUNTED = "count(*) AS total_events, count(*) FILTER (type = 'clicks') AS total_clicks, count(*) FILTER (type = 'carts') AS total_carts, count(*) FILTER (type = 'orders') AS total_orders"
_RATES = """round(CASE WHEN total_clicks > 0 THEN total_carts / total_clicks ELSE 0 END, 6) AS click_to_cart_rate,
        round(CASE WHEN total_carts > 0 THEN total_orders / total_carts ELSE 0 END, 6) AS cart_to_order_rate"""


def _windows(slide: int, copies: int) -> str:
    """Windows of an hour that begin every ``slide`` milliseconds and end by the watermark."""
    return _sql(f"""SELECT *, window_start + 3600000 AS window_end, {_RATES} FROM
        (SELECT (ts // {slide} - k) * {slide} AS window_start, {_COUNTED} FROM ev, unnest(range({copies})) AS u(k) GROUP BY 1)
        WHERE window_start + 3600000 <= (SELECT max(ts) - 120000 FROM ev)""")


_SESSIONS = "flags AS (SELECT session, count(*) AS length, max((type = 'carts')::INT) AS c, max((type = 'orders')::INT) AS o, (max(ts) - min(ts)) / 1000.0 AS s FROM ev GROUP BY session)"
_RUNS = """runs AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, aid, type ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, (ts - lag(ts, 1, -1000000000000) OVER (PARTITION BY session ORDER BY ts, aid, type) > 1800000)::INT AS new FROM ev))"""
_SIX = """SELECT 'stats_hourly' AS name, count(DISTINCT ts // 60000) AS rows, count(*) AS counted FROM ev
    UNION ALL SELECT 'anomaly_logs', count(*), CAST(sum(event_count) AS BIGINT) FROM ({bots})
    UNION ALL SELECT 'popular_items', count(*), CAST(sum(count) AS BIGINT) FROM ({popular})
    UNION ALL SELECT 'stats_items', count(DISTINCT aid), count(*) FILTER (type = 'clicks') FROM ev
    UNION ALL SELECT 'advanced_funnel_stats', count(DISTINCT session % 3), count(DISTINCT session) FROM ev
    UNION ALL SELECT 'stats_sessions', count(DISTINCT kind), count(*) FROM
        (SELECT CASE WHEN bool_or(type = 'orders') THEN 2 WHEN bool_or(type = 'carts') THEN 1 ELSE 0 END AS kind FROM ev GROUP BY session)"""
ORACLES = {
    "streamed_features": _sql(
        """SELECT session, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS length, count(*) FILTER (type = 'clicks') AS n_clicks,
            count(*) FILTER (type = 'carts') AS n_carts, count(*) FILTER (type = 'orders') AS n_orders, count(DISTINCT aid) AS unique_items,
            max_by(aid, (ts, aid, type)) AS last_aid
        FROM runs GROUP BY session, run HAVING max(ts) + 1800000 <= (SELECT max(ts) - 120000 FROM ev)""",
        WEB_SQL, _RUNS,
    ),
    "streamed_hits": _sql(
        """SELECT e.session, e.aid, e.type AS event_type, c.ts - 60000 AS shown_at, e.ts, e.aid BETWEEN c.aid AND c.aid + 20 AS is_hit,
            CASE WHEN e.aid BETWEEN c.aid AND c.aid + 19 THEN 1.0::DOUBLE ELSE 0 END AS recall,
            CASE WHEN e.aid BETWEEN c.aid AND c.aid + 19 THEN round(1 / (e.aid - c.aid + 1), 6) ELSE 0 END AS mrr,
            CASE WHEN e.aid BETWEEN c.aid AND c.aid + 19 THEN round(1 / log2(e.aid - c.aid + 2), 6) ELSE 0 END AS ndcg
        FROM ev AS e JOIN ev AS c ON e.session = c.session AND c.type = 'carts' AND e.type IN ('carts', 'orders')
            AND e.ts BETWEEN c.ts - 60000 AND c.ts - 60000 + 259200000""",
    ),
    "streamed_graph": _sql("SELECT * FROM edges", WEB_SQL, _unified(30 * 86_400_000)),
    "streamed_uniques": _sql(
        """SELECT ts // 86400000 AS day, count(*) AS total_events, count(DISTINCT session) AS sessions, count(DISTINCT aid) AS aids,
            true AS sessions_within, true AS aids_within FROM ev GROUP BY 1""",
    ),
    "six_tables": _sql(_SIX.format(bots=_analytics["bot_sessions"].replace(PURCHASE_SQL, WEB_SQL), popular=_POPULAR.format("ev", 100))),
    "streamed_items": _sql("""SELECT aid, k AS total_clicks, c AS total_carts, o AS total_orders, round(CASE WHEN k > 0 THEN c / k ELSE 0 END, 6) AS click_to_cart_rate, round(CASE WHEN k > 0 THEN o / k ELSE 0 END, 6) AS click_to_order_rate, round(CASE WHEN c > 0 THEN o / c ELSE 0 END, 6) AS cart_to_order_rate
        FROM (SELECT aid, count(*) FILTER (type = 'clicks') AS k, count(*) FILTER (type = 'carts') AS c, count(*) FILTER (type = 'orders') AS o FROM ev GROUP BY aid)"""),
    "streamed_segments": _sql("SELECT CASE WHEN o > 0 THEN 'buyer' WHEN c > 0 THEN 'cart_abandoner' ELSE 'browse_only' END AS session_type, count(*) AS count, round(avg(length), 6) AS avg_length, round(avg(s), 6) AS avg_duration_sec, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_of_total FROM flags GROUP BY 1", WEB_SQL, _SESSIONS),
    "streamed_item_batches": _sql("""SELECT aid, k AS total_clicks, c AS total_carts, o AS total_orders, round(CASE WHEN k > 0 THEN c / k ELSE 0 END, 6) AS click_to_cart_rate,
        round(CASE WHEN k > 0 THEN o / k ELSE 0 END, 6) AS click_to_order_rate, round(CASE WHEN c > 0 THEN o / c ELSE 0 END, 6) AS cart_to_order_rate
        FROM (SELECT aid, q, count(*) FILTER (type = 'clicks') AS k, count(*) FILTER (type = 'carts') AS c, count(*) FILTER (type = 'orders') AS o, row_number() OVER (PARTITION BY aid ORDER BY q DESC) AS last
            FROM b GROUP BY aid, q) WHERE last = 1""", WEB_SQL, _QUARTERS),
    "streamed_popular": _sql("""SELECT 'all_time' AS time_scope, event_type, aid, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type, aid ORDER BY q DESC) AS last FROM
        (SELECT type AS event_type, aid, q, count(*) AS count, CAST(row_number() OVER (PARTITION BY type, q ORDER BY count(*) DESC, aid) AS INT) AS rank FROM b GROUP BY type, aid, q) WHERE rank <= 100) WHERE last = 1""", WEB_SQL, _QUARTERS),
    "streamed_funnel": _sql("""SELECT model_used, t AS total_sessions, k AS sessions_with_clicks, c AS sessions_with_carts, o AS sessions_with_orders, round(CASE WHEN k > 0 THEN o / k ELSE 0 END, 6) AS click_to_order_rate FROM
        (SELECT 'm' || (session % 3) AS model_used, q, count(DISTINCT session) AS t, count(DISTINCT session) FILTER (type = 'clicks') AS k, count(DISTINCT session) FILTER (type = 'carts') AS c,
            count(DISTINCT session) FILTER (type = 'orders') AS o, row_number() OVER (PARTITION BY 'm' || (session % 3) ORDER BY q DESC) AS last FROM b GROUP BY 1, 2) WHERE last = 1""", WEB_SQL, _QUARTERS),
    "streamed_traffic": _sql(f"""SELECT window_start, window_start + 60000 AS window_end, total_events, total_clicks, total_carts, total_orders, unique_sessions, unique_sessions AS total_sessions, unique_items, {_RATES} FROM
        (SELECT ts // 60000 * 60000 AS window_start, q, {_COUNTED}, count(DISTINCT session) AS unique_sessions, count(DISTINCT aid) AS unique_items FROM b GROUP BY 1, 2)""", WEB_SQL, _QUARTERS),
    "streamed_messages": _sql("SELECT session, aid, type, ts + 25200000 AS ts FROM ev"),
    "streamed_distinct": _sql("SELECT DISTINCT session, aid, type, ts FROM ev"),
    "streamed_hours": _windows(3_600_000, 1),
    "streamed_slides": _windows(1_800_000, 2),
    "streamed_sessions": _sql("""SELECT session, min(ts) AS session_start, max(ts) + 1800000 AS session_end, count(*) AS length, count(*) FILTER (type = 'clicks') AS n_clicks, count(*) FILTER (type = 'carts') AS n_carts, count(*) FILTER (type = 'orders') AS n_orders
        FROM (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, aid, type ROWS UNBOUNDED PRECEDING) AS run FROM
            (SELECT *, (ts - lag(ts, 1, -1000000000000) OVER (PARTITION BY session ORDER BY ts, aid, type) > 1800000)::INT AS new FROM ev))
        GROUP BY session, run HAVING max(ts) + 1800000 <= (SELECT max(ts) - 120000 FROM ev)"""),
}
