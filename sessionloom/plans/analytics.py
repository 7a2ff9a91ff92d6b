"""Queries: session and item analytics, filters, distributions, reports; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import items as I
from sessionloom.operators import sessions as S
from sessionloom.sources.events import PURCHASE_SQL, WEB_SQL, purchase_events, web_events

WEEK_MS = 604_800_000
_FLAGS = "flags AS (SELECT session, count(*) AS length, max((type = 'clicks')::INT) AS has_clicks, max((type = 'carts')::INT) AS has_carts, max((type = 'orders')::INT) AS has_orders FROM ev GROUP BY session)"
_SEGMENT = "CASE WHEN has_orders > 0 THEN 'buyer' WHEN has_carts > 0 THEN 'cart_abandoner' ELSE 'browse_only' END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, as the SQL counterparts round too."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _web(query):
    return lambda spark, sf_dir: rounded(query(web_events(spark, sf_dir)))


def by_day(events: DataFrame) -> DataFrame:
    """Sessions cut by day: short ones, so that every segment and length class occurs."""
    return events.withColumn("session", F.col("session") * 100 + F.expr("ts div 86400000 % 100"))


def _daily(query):
    return lambda spark, sf_dir: rounded(query(by_day(web_events(spark, sf_dir))))


DAILY_SQL = WEB_SQL.replace("ev AS (", "ev0 AS (", 1) + ", ev AS (SELECT session * 100 + ts // 86400000 % 100 AS session, aid, ts, type FROM ev0)"


def with_model(events: DataFrame) -> DataFrame:
    return events.withColumn("model_used", F.concat(F.lit("m"), (F.col("session") % 3).cast("string")))


def _weeks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first three weeks since the first event, and what follows."""
    top = F.broadcast(events.agg(F.min("ts").alias("t0")))
    marked = events.crossJoin(top)
    return marked.filter(F.col("ts") < F.col("t0") + 3 * WEEK_MS).drop("t0"), marked.filter(F.col("ts") >= F.col("t0") + 3 * WEEK_MS).drop("t0")


def id_sets(events: DataFrame) -> DataFrame:
    """Items in both parts, only in training, only in the test."""
    train, test = (x.select("aid").distinct() for x in _weeks(events))
    parts = (("both", train.intersect(test)), ("train_only", train.exceptAll(test)), ("test_only", test.exceptAll(train)))
    out = None
    for name, rows in parts:
        row = rows.agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("part"), "items")
        out = row if out is None else out.unionByName(row)
    return out


def sequences_text(events: DataFrame) -> DataFrame:
    """Sequences, leave-one-out target and shifted labels as text."""
    seq = S.sequences(events)
    both = S.shifted_labels(seq).join(S.leave_one_out(seq).select("session", "target"), "session")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return both.select("session", text("inputs").alias("inputs"), text("labels").alias("labels"), "target")


def padded_text(events: DataFrame) -> DataFrame:
    out = S.padded(S.sequences(events), 60)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("session", text("padded").alias("padded"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("real"))


def _lifespans(events: DataFrame) -> DataFrame:
    top = F.broadcast(events.agg(F.min("ts").alias("t0")))
    return S.lifespans(events.crossJoin(top), F.col("t0"))


#: Queries that are also asked of whole, long sessions.
_WHOLE = {
    "session_segments": S.segments, "session_segment_durations": S.segment_durations, "funnel_rates": S.funnel, "human_sessions": S.human_sessions, "length_histogram": S.length_histogram,
    "length_stats": S.length_stats, "duration_buckets": S.duration_buckets, "minutes_stats": S.minutes_stats, "short_sessions": lambda e: S.short_sessions(e, 3),
}


def bot_details(events: DataFrame) -> DataFrame:
    """The JSON of anomaly rows read back by its schema."""
    read = F.from_json("details", "event_count_per_min long, batch_mean double, batch_std double, z_threshold double")
    return S.bot_sessions(events).select("session_id", read.alias("d")).select("session_id", "d.*")


QUERIES = {
    "session_segments": _daily(S.segments),
    "session_segment_durations": _daily(S.segment_durations),
    "funnel_rates": _daily(S.funnel),
    "model_funnel": _daily(lambda e: S.model_funnel(with_model(e))),
    "popular_items_web": _web(lambda e: I.popular_items(e, 20)),
    "popular_items_purchases": lambda spark, d: rounded(I.popular_items(purchase_events(spark, d), 100)),
    "popular_candidates": _web(I.popular_candidates),
    "item_conversion": _web(I.item_conversion),
    "item_features": _web(I.item_features),
    "session_features": _web(S.session_features),
    "interaction_features": _web(S.interaction_features),
    "last_items": _web(S.last_items),
    "interarrival": _web(S.interarrival),
    "traffic_per_minute": _web(I.traffic),
    "traffic_per_hour": _web(lambda e: I.traffic(e, 3_600_000)),
    "bot_sessions": lambda spark, d: rounded(S.bot_sessions(purchase_events(spark, d)).drop("details")),
    "bot_details": lambda spark, d: bot_details(purchase_events(spark, d)),
    "human_sessions": _daily(S.human_sessions),
    "long_sessions": _daily(lambda e: S.long_sessions(e, 2)),
    "purchase_sessions": _daily(S.purchase_sessions),
    "order_ended_sessions": _daily(lambda e: S.purchase_sessions(e, last_is_order=True)),
    "known_item_sessions": _web(lambda e: S.known_sessions(_weeks(e)[1], _weeks(e)[0])),
    "session_lifespans": _web(_lifespans),
    "length_histogram": _daily(S.length_histogram),
    "length_stats": _daily(S.length_stats),
    "duration_buckets": _daily(S.duration_buckets),
    "minutes_stats": _daily(S.minutes_stats),
    "short_sessions": _daily(lambda e: S.short_sessions(e, 3)),
    "dataset_stats": _web(I.dataset_stats),
    "type_shares": _web(I.type_shares),
    "click_to_order": _web(I.click_to_order_pct),
    "hourly_types": _web(I.hourly_types),
    "weekday_types": _web(I.weekday_types),
    "weekly_events": _web(I.weekly_events),
    "top_share": lambda spark, d: rounded(I.top_share(purchase_events(spark, d))),
    "long_tail": lambda spark, d: I.long_tail(purchase_events(spark, d)),
    "hidden_gems": _web(lambda e: I.hidden_gems(I.item_conversion(e))),
    "cold_start": lambda spark, d: rounded(I.cold_start(*reversed(_weeks(web_events(spark, d))))),
    "catalogue_coverage": lambda spark, d: rounded(I.coverage(*reversed(_weeks(web_events(spark, d))))),
    "id_sets": _web(id_sets),
    "sampling_distribution": _web(I.sampling_distribution),
    "training_sequences": _web(sequences_text),
    "padded_sequences": _web(padded_text),
    "least_length": _daily(lambda e: S.least_length(e, 3)),
    "session_offsets": _daily(S.session_offsets),
    "sessions_by_start": _daily(S.sessions_by_start),
    "item_places": lambda spark, d: I.item_places(purchase_events(spark, d)),
    "joined_parts": lambda spark, d: S.joined_parts(*_weeks(web_events(spark, d))),
} | {f"{name}_whole": _web(query) for name, query in _WHOLE.items()}


def _sql(body: str, source: str = WEB_SQL, *more: str) -> str:
    return "WITH " + ", ".join([source, *more]) + " " + body


_WEEKS = "t AS (SELECT min(ts) AS t0 FROM ev), train AS (SELECT ev.* FROM ev, t WHERE ts < t0 + 1814400000), test AS (SELECT ev.* FROM ev, t WHERE ts >= t0 + 1814400000)"
_COUNTS = "count(*) FILTER (type = 'clicks') AS total_clicks, count(*) FILTER (type = 'carts') AS total_carts, count(*) FILTER (type = 'orders') AS total_orders"
_ITEMS = f"conv0 AS (SELECT aid, {_COUNTS} FROM ev GROUP BY aid), conv AS (SELECT *, CASE WHEN total_clicks > 0 THEN total_carts / total_clicks ELSE 0 END AS click_to_cart_rate, CASE WHEN total_clicks > 0 THEN total_orders / total_clicks ELSE 0 END AS click_to_order_rate, CASE WHEN total_carts > 0 THEN total_orders / total_carts ELSE 0 END AS cart_to_order_rate FROM conv0)"
_POPULAR = "SELECT event_type, aid, count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY count DESC, aid) AS rank FROM (SELECT type AS event_type, aid, count(*) AS count FROM {0} GROUP BY ALL)) WHERE rank <= {1}"
_SEQ = "seq AS (SELECT session, array_agg(aid + 1 ORDER BY ts, aid, type) AS items FROM ev GROUP BY session)"


def _traffic(width: int) -> str:
    return _sql(f"""SELECT *, window_start + {width} AS window_end, unique_sessions AS total_sessions,
        round(CASE WHEN total_clicks > 0 THEN total_carts / total_clicks ELSE 0 END, 6) AS click_to_cart_rate, round(CASE WHEN total_carts > 0 THEN total_orders / total_carts ELSE 0 END, 6) AS cart_to_order_rate
        FROM (SELECT ts // {width} * {width} AS window_start, count(*) AS total_events, {_COUNTS}, count(DISTINCT session) AS unique_sessions, count(DISTINCT aid) AS unique_items FROM ev GROUP BY 1)""")


ORACLES = {
    "session_segments": _sql(f"SELECT {_SEGMENT} AS session_type, count(*) AS count, round(avg(length), 6) AS avg_length, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_of_total FROM flags GROUP BY 1", DAILY_SQL, _FLAGS),
    "session_segment_durations": _sql(f"SELECT {_SEGMENT} AS session_type, count(*) AS count, round(avg(length), 6) AS avg_length, round(avg(sec), 6) AS avg_duration_sec, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_of_total FROM flags JOIN (SELECT session, (max(ts) - min(ts)) / 1000.0 AS sec FROM ev GROUP BY 1) USING (session) GROUP BY 1", DAILY_SQL, _FLAGS),
    "funnel_rates": _sql("""SELECT *, round(CASE WHEN sessions_with_clicks > 0 THEN sessions_with_carts / sessions_with_clicks ELSE 0 END, 6) AS click_to_cart_rate, round(CASE WHEN sessions_with_carts > 0 THEN sessions_with_orders / sessions_with_carts ELSE 0 END, 6) AS cart_to_order_rate,
        round(CASE WHEN sessions_with_clicks > 0 THEN sessions_with_orders / sessions_with_clicks ELSE 0 END, 6) AS click_to_order_rate
        FROM (SELECT count(*) AS total_sessions, CAST(sum(has_clicks) AS BIGINT) AS sessions_with_clicks, CAST(sum(has_carts) AS BIGINT) AS sessions_with_carts, CAST(sum(has_orders) AS BIGINT) AS sessions_with_orders FROM flags)""", DAILY_SQL, _FLAGS),
    "model_funnel": _sql("""SELECT *, round(CASE WHEN sessions_with_clicks > 0 THEN sessions_with_orders / sessions_with_clicks ELSE 0 END, 6) AS click_to_order_rate FROM (SELECT 'm' || (session % 3) AS model_used, count(DISTINCT session) AS total_sessions,
        count(DISTINCT session) FILTER (type = 'clicks') AS sessions_with_clicks, count(DISTINCT session) FILTER (type = 'carts') AS sessions_with_carts, count(DISTINCT session) FILTER (type = 'orders') AS sessions_with_orders FROM ev GROUP BY 1)""", DAILY_SQL),
    "popular_items_web": _sql(_POPULAR.format("ev", 20)),
    "popular_items_purchases": _sql(_POPULAR.format("ev", 100), PURCHASE_SQL),
    "popular_candidates": _sql("SELECT DISTINCT aid FROM (" + _POPULAR.format("(SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - 604800000)", 20) + ")"),
    "item_conversion": _sql("SELECT aid, total_clicks, total_carts, total_orders, round(click_to_cart_rate, 6) AS click_to_cart_rate, round(click_to_order_rate, 6) AS click_to_order_rate, round(cart_to_order_rate, 6) AS cart_to_order_rate FROM conv", WEB_SQL, _ITEMS),
    "item_features": _sql("""SELECT aid, n AS n_all, k AS click_all, c AS cart_all, o AS order_all, s AS sessions_all, round(c / (k + 10), 6) AS cart_ratio_all, round(o / (k + 10), 6) AS buy_ratio_all, round(o / (c + 10), 6) AS cart_buy_ratio_all
        FROM (SELECT aid, count(*) AS n, count(*) FILTER (type = 'clicks') AS k, count(*) FILTER (type = 'carts') AS c, count(*) FILTER (type = 'orders') AS o, count(DISTINCT session) AS s FROM ev GROUP BY aid)"""),
    "session_features": _sql("""SELECT *, round(n_carts / (session_length + 1), 6) AS cart_ratio, round(n_orders / (session_length + 1), 6) AS order_ratio FROM (SELECT session, count(*) AS session_length, count(DISTINCT aid) AS unique_aids, max(ts) AS session_end_ts, (max(ts) - min(ts)) // 1000 AS duration_sec,
        count(*) FILTER (type = 'clicks') AS n_clicks, count(*) FILTER (type = 'carts') AS n_carts, count(*) FILTER (type = 'orders') AS n_orders FROM ev GROUP BY session)"""),
    "interaction_features": _sql("SELECT session, aid, count(*) AS repetitions, max(ts) AS last_ts, min(ts) AS first_ts FROM ev GROUP BY ALL"),
    "last_items": _sql("SELECT session, aid AS last_aid, ts AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC) AS n FROM ev) WHERE n = 1"),
    "interarrival": _sql("SELECT *, round((ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, aid, type)) / 1000.0, 6) AS gap_sec FROM ev"),
    "traffic_per_minute": _traffic(60_000),
    "traffic_per_hour": _traffic(3_600_000),
    "bot_details": _sql(
        """SELECT session AS session_id, n AS event_count_per_min, round(mean, 2) AS batch_mean, round(std, 2) AS batch_std, CAST(3 AS DOUBLE) AS z_threshold
        FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, minute) AS r
        FROM c, (SELECT count(*) AS g, avg(n) AS mean, stddev_samp(n) AS std FROM c) WHERE g >= 10 AND std > 0 AND n > mean + 3 * std) WHERE r = 1""",
        PURCHASE_SQL, "c AS (SELECT ts // 60000 * 60000 AS minute, session, count(*) AS n FROM ev GROUP BY ALL)",
    ),
    "bot_sessions": _sql("""SELECT session AS session_id, 'bot_like' AS anomaly_type, minute, n AS event_count, round(mean, 2) AS batch_mean, round(std, 2) AS batch_std FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, minute) AS r
        FROM c, (SELECT count(*) AS g, avg(n) AS mean, stddev_samp(n) AS std FROM c) WHERE g >= 10 AND std > 0 AND n > mean + 3 * std) WHERE r = 1""", PURCHASE_SQL, "c AS (SELECT ts // 60000 * 60000 AS minute, session, count(*) AS n FROM ev GROUP BY ALL)"),
    "human_sessions": _sql("SELECT ev.* FROM ev SEMI JOIN (SELECT session FROM (SELECT session, count(*) AS n, (max(ts) - min(ts)) / 1000.0 AS s FROM ev GROUP BY 1) WHERE n / (s + 0.1) <= 2 AND s BETWEEN 1 AND 86400 AND n BETWEEN 2 AND 250) USING (session)", DAILY_SQL),
    "long_sessions": _sql("SELECT ev.* FROM ev SEMI JOIN (SELECT session FROM ev GROUP BY 1 HAVING count(*) > 2 OR bool_or(type = 'orders')) USING (session)", DAILY_SQL),
    "purchase_sessions": _sql("SELECT session, count(*) AS length FROM ev GROUP BY 1 HAVING count(*) > 1 AND bool_or(type = 'orders')", DAILY_SQL),
    "order_ended_sessions": _sql("SELECT session, n AS length FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, type DESC) AS r FROM ev) WHERE r = 1 AND n > 1 AND type = 'orders'", DAILY_SQL),
    "known_item_sessions": _sql("SELECT test.* FROM test ANTI JOIN (SELECT DISTINCT session FROM test ANTI JOIN train USING (aid)) USING (session)", WEB_SQL, _WEEKS),
    "session_lifespans": _sql("""SELECT session, min((ts - t0) // 604800000 + 1) AS first_week, max((ts - t0) // 604800000 + 1) AS last_week, bool_or(type = 'orders') AS ordered, count(*) FILTER (type = 'orders') AS n_orders,
        arg_max(type, (ts, aid, type)) AS last_type FROM ev, t GROUP BY session""", WEB_SQL, _WEEKS),
    "length_histogram": _sql("SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS length, count(*) AS sessions FROM (SELECT count(*) AS n FROM ev GROUP BY session) GROUP BY 1", DAILY_SQL),
    "length_stats": _sql("SELECT count(*) AS sessions, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95 FROM (SELECT count(*) AS n FROM ev GROUP BY session)", DAILY_SQL),
    "duration_buckets": _sql("""SELECT place, bucket, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest, min(n) AS shortest, round(avg(n), 6) AS mean_length, round(quantile_cont(n, 0.5), 6) AS median_length FROM (SELECT n, CASE WHEN s < 60 THEN 0 WHEN s < 3600 THEN 1 WHEN s < 86400 THEN 2 WHEN s < 604800 THEN 3 ELSE 4 END AS place,
        CASE WHEN s < 60 THEN 'under_minute' WHEN s < 3600 THEN 'under_hour' WHEN s < 86400 THEN 'under_day' WHEN s < 604800 THEN 'under_week' ELSE 'week_or_more' END AS bucket FROM (SELECT count(*) AS n, (max(ts) - min(ts)) / 1000.0 AS s FROM ev GROUP BY session)) GROUP BY 1, 2""", DAILY_SQL),
    "minutes_stats": _sql("""SELECT max(n) AS max_length, min(n) AS min_length, round(avg(n), 6) AS avg_length, round(max(m), 6) AS max_minutes, round(min(m), 6) AS min_minutes, round(avg(m), 6) AS avg_minutes, round(quantile_cont(n, 0.5), 6) AS median_length, round(quantile_cont(m, 0.5), 6) AS median_minutes
        FROM (SELECT count(*) AS n, (max(ts) - min(ts)) / 60000.0 AS m FROM ev GROUP BY session)""", DAILY_SQL),
    "short_sessions": _sql("SELECT round(100.0 * avg((length < 3)::INT), 6) AS short_pct, count(*) FILTER (length < 3) AS short_sessions, count(*) FILTER (length < 3 AND has_orders > 0) AS short_with_orders, count(*) FILTER (length < 3 AND has_carts > 0) AS short_with_carts FROM flags", DAILY_SQL, _FLAGS),
    "dataset_stats": _sql("""SELECT *, round(100.0 * events / sessions / items, 6) AS density_pct FROM (SELECT count(DISTINCT session) AS sessions, count(DISTINCT aid) AS items, count(*) AS events, count(*) FILTER (type = 'clicks') AS n_clicks, count(*) FILTER (type = 'carts') AS n_carts, count(*) FILTER (type = 'orders') AS n_orders, min(ts) AS first_ts, max(ts) AS last_ts FROM ev)"""),
    "type_shares": _sql("SELECT type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ev GROUP BY type"),
    "click_to_order": _sql("SELECT round(100.0 * count(*) FILTER (type = 'orders') / count(*) FILTER (type = 'clicks'), 6) AS click_to_order_pct FROM ev"),
    "hourly_types": _sql("SELECT ts // 3600000 % 24 AS hour, type, count(*) AS count FROM ev GROUP BY ALL"),
    "weekday_types": _sql("SELECT CAST(isodow(make_timestamp(ts * 1000)) AS BIGINT) AS weekday, type, count(*) AS count FROM ev GROUP BY ALL"),
    "weekly_events": _sql("SELECT (ts - t0) // 604800000 + 1 AS week, count(*) AS count FROM ev, t GROUP BY 1", WEB_SQL, _WEEKS),
    "top_share": _sql("SELECT max(head) AS top_items, round(100.0 * sum(n) FILTER (r <= head) / sum(n), 6) AS top_share_pct FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, greatest(1, CAST(floor(count(*) OVER () * 0.01) AS BIGINT)) AS head FROM (SELECT count(*) AS n FROM ev GROUP BY aid))", PURCHASE_SQL),
    "long_tail": _sql("SELECT n AS interactions, count(*) AS items FROM (SELECT count(*) AS n FROM ev GROUP BY aid) GROUP BY 1", PURCHASE_SQL),
    "hidden_gems": _sql("""SELECT aid, total_clicks, total_carts, total_orders, round(click_to_cart_rate, 6) AS click_to_cart_rate, round(click_to_order_rate, 6) AS click_to_order_rate, round(cart_to_order_rate, 6) AS cart_to_order_rate
        FROM conv WHERE total_clicks >= 10 AND click_to_order_rate >= (SELECT quantile_cont(click_to_order_rate, 0.75) FROM conv WHERE total_clicks >= 10) AND total_clicks <= (SELECT quantile_cont(total_clicks, 0.25) FROM conv WHERE total_clicks >= 10)""", WEB_SQL, _ITEMS),
    "cold_start": _sql("SELECT c AS cold_sessions, s AS sessions, round(CASE WHEN s > 0 THEN 100.0 * c / s ELSE 0 END, 6) AS cold_pct FROM (SELECT count(DISTINCT session) AS c FROM test ANTI JOIN train USING (aid)), (SELECT count(DISTINCT session) AS s FROM test)", WEB_SQL, _WEEKS),
    "catalogue_coverage": _sql("SELECT a AS test_items, k AS known_items, round(100.0 * k / a, 6) AS coverage_pct FROM (SELECT count(DISTINCT aid) AS a FROM test), (SELECT count(DISTINCT aid) AS k FROM test SEMI JOIN train USING (aid))", WEB_SQL, _WEEKS),
    "id_sets": _sql("""SELECT 'both' AS part, count(*) AS items FROM (SELECT aid FROM train INTERSECT SELECT aid FROM test) UNION ALL SELECT 'train_only', count(*) FROM (SELECT aid FROM train EXCEPT SELECT aid FROM test) UNION ALL SELECT 'test_only', count(*) FROM (SELECT aid FROM test EXCEPT SELECT aid FROM train)""", WEB_SQL, _WEEKS),
    "sampling_distribution": _sql("SELECT aid, round(w, 6) AS weight, round(sum(w) OVER (ORDER BY aid) / sum(w) OVER (), 6) AS cumulative FROM (SELECT aid, pow(count(*), 0.75) AS w FROM ev GROUP BY aid)"),
    "training_sequences": _sql("SELECT session, array_to_string(items[:-2], ' ') AS inputs, array_to_string(items[2:], ' ') AS labels, items[-1] AS target FROM seq WHERE len(items) >= 2", WEB_SQL, _SEQ),
    "padded_sequences": _sql("SELECT session, array_to_string(list_concat(CASE WHEN len(items) < 60 THEN list_transform(range(60 - len(items)), lambda x: CAST(0 AS BIGINT)) ELSE [] END, items[-60:]), ' ') AS padded, CAST(least(len(items), 60) AS INT) AS real FROM seq", WEB_SQL, _SEQ),
    "least_length": _sql("SELECT session, aid, ts, type FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM ev) WHERE n >= 3", DAILY_SQL),
    "session_offsets": _sql("SELECT session, n AS length, CAST(sum(n) OVER (ORDER BY session) - n AS BIGINT) AS \"offset\" FROM (SELECT session, count(*) AS n FROM ev GROUP BY session)", DAILY_SQL),
    "sessions_by_start": _sql("SELECT session, s AS start_ts, row_number() OVER (ORDER BY s, session) - 1 AS place FROM (SELECT session, min(ts) AS s FROM ev GROUP BY session)", DAILY_SQL),
    "item_places": _sql("SELECT aid, n AS interactions, row_number() OVER (ORDER BY n DESC, aid) - 1 AS place FROM (SELECT aid, count(*) AS n FROM ev GROUP BY aid)", PURCHASE_SQL),
    "joined_parts": _sql("SELECT session AS \"session:token\", aid AS \"aid:token\", CAST(ts AS DOUBLE) * 1e9 AS \"ts:float\" FROM ev"),
}
ORACLES |= {f"{name}_whole": ORACLES[name].replace(DAILY_SQL, WEB_SQL) for name in _WHOLE}
