"""Queries that write events in a format or to a sink and give what is read back; with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import normalize as N
from sessionloom.operators import covisit as V
from sessionloom.operators import items as I
from sessionloom.plans.analytics import _sql, rounded
from sessionloom.plans.graphs import MONTH_MS, _unified
from sessionloom.sources import events as X
from sessionloom.sources.events import PURCHASE_SQL, purchase_events, web_events
from sessionloom.sources.folders import shared_folder
from sessionloom.streaming import sinks as K


def nested(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.collect_list(F.struct("aid", "ts", "type")).alias("events"))


def nested_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "nested")
    nested(web_events(spark, d)).write.mode("overwrite").parquet(path)
    return X.read_sessions(spark, path)


def flat_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "flat")
    K.write_parquet(web_events(spark, d), path)
    return X.read_flat(spark, path, parts=8)


def _jsonl(spark: SparkSession, d: str) -> str:
    path = shared_folder(spark, "jsonl")
    nested(web_events(spark, d)).write.json(path)
    return path


def jsonl_clicks(spark: SparkSession, d: str) -> DataFrame:
    return X.read_jsonl(spark, _jsonl(spark, d), only="clicks")


def jsonl_converted(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "converted")
    X.jsonl_to_parquet(spark, _jsonl(spark, d), path)
    return X.read_sessions(spark, path)


def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """A folder of many files, of which a glob takes some."""
    path = shared_folder(spark, "folder")
    events = web_events(spark, d)
    events.repartition(4).write.parquet(path)
    events.write.mode("append").json(path)
    return X.read_folder(spark, path, "*.parquet")


def tsv_interactions(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "tsv")
    K.write_interactions(web_events(spark, d), path)
    return X.read_interactions(spark, path)


def csv_items(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "items")
    K.write_items(web_events(spark, d), path)
    return X.read_csv(spark, path, "aid long")


def atomic_interactions(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "atomic")
    K.write_atomic(web_events(spark, d), path)
    return X.read_csv(spark, path, "`session:token` long, `aid:token` long, `ts:float` double", sep="\t")


def submission_csv(spark: SparkSession, d: str) -> DataFrame:
    """Each session's distinct items as its list."""
    path = shared_folder(spark, "submission")
    listed = web_events(spark, d).groupBy("session").agg(F.array_sort(F.collect_set("aid")).alias("x"))
    labels = F.array_join(F.transform("x", lambda a: a.cast("string")), " ")
    K.write_submission(listed.select(F.concat(F.col("session").cast("string"), F.lit("_clicks")).alias("session_type"), labels.alias("labels")), path)
    return X.read_csv(spark, path, "session_type string, labels string")


def prediction_csv(spark: SparkSession, d: str) -> DataFrame:
    """Each session's commonest items as predictions."""
    path = shared_folder(spark, "predictions")
    counts = web_events(spark, d).groupBy("session", "aid").agg(F.count(F.lit(1)).cast("double").alias("score"))
    K.write_predictions(I.top_by(counts, ["session"], [F.desc("score"), F.asc("aid")], 5), path)
    return X.read_csv(spark, path, "user_id long, item_id long, rank int, score double")


#: Items that are looked up in the published lists.
LOOKED_UP = [1, 2, 3, 5, 8, 13, 21, 34]


def adjacency_lookup(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "adjacency")
    K.publish_adjacency(V.adjacency(V.unified_edges(purchase_events(spark, d), gap_ms=MONTH_MS)), path)
    found = K.lookup(spark, path, LOOKED_UP, 5)
    return found.select("aid", F.array_join(F.transform("candidates", lambda x: x["aid2"].cast("string")), " ").alias("candidates"))


def dumped_table(spark: SparkSession, d: str) -> DataFrame:
    path, name = shared_folder(spark, "dump"), f"conversion_{uuid.uuid4().hex}"
    I.item_conversion(web_events(spark, d)).createOrReplaceTempView(name)
    K.dump_tables(spark, (name,), path)
    schema = spark.table(name).schema
    spark.catalog.dropTempView(name)
    return rounded(spark.read.schema(schema).json(f"{path}/{name}"))


def artefacts(spark: SparkSession, d: str) -> DataFrame:
    """Tables that go with a model, and the names of its features."""
    path, events = shared_folder(spark, "artefacts"), web_events(spark, d)
    K.save_artefacts({"popular": I.popular_items(events, 20), "items": I.item_features(events)}, path, features=["click_all", "cart_all"])
    found = K.load_artefacts(spark, path, ("popular", "items"))
    return found["popular"].join(found["items"].select("aid", *found["features"]), "aid")


def decoded_messages(spark: SparkSession, d: str) -> DataFrame:
    return X.decode_messages(K.messages(web_events(spark, d))).drop("model_used")


def replayed(spark: SparkSession, d: str) -> DataFrame:
    return X.replay(web_events(spark, d), 100, 1_706_000_000_000).drop("model_used")


def purged(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last week."""
    path, events = shared_folder(spark, "purge"), web_events(spark, d)
    top = events.agg(F.max("ts")).first()[0]
    events.withColumn("created_at", F.timestamp_millis("ts")).write.parquet(f"{path}/all")
    K.purge(spark, f"{path}/all", f"{path}/kept", "created_at", F.timestamp_millis(F.lit(top)), 7)
    return spark.read.parquet(f"{path}/kept").drop("created_at")


# ---- keyed sinks


def _halves(events: DataFrame) -> list[DataFrame]:
    return [events.filter(f"ts div 86400000 % 2 = {k}") for k in range(2)]


def upserted_popular(spark: SparkSession, d: str) -> DataFrame:
    """Popular items of even days, then those of odd days, written twice: the later row of a key stands."""
    sink = K.MergeSink(shared_folder(spark, "popular"), ["time_scope", "event_type", "aid"])
    for batch, rows in ((0, 0), (1, 1), (1, 1)):
        sink.write(I.popular_items(_halves(web_events(spark, d))[rows], 50).withColumn("time_scope", F.lit("all_time")), batch)
    return sink.read(spark).drop("part")


def added_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of two batches added up, the second written twice; the rate is derived anew."""
    rate = {"click_to_order_rate": N.rate(F.col("total_orders"), F.col("total_clicks"))}
    sink = K.MergeSink(shared_folder(spark, "counters"), ["aid"], ("total_clicks", "total_orders"), rate)
    for batch, rows in ((0, 0), (1, 1), (1, 1)):
        counts = I.item_conversion(_halves(web_events(spark, d))[rows]).select("aid", "total_clicks", "total_orders", "click_to_order_rate")
        sink.write(counts, batch)
    return rounded(sink.read(spark).drop("part"))


def _database() -> tuple[str, dict[str, str]]:
    """A database of the driver's own process, which tasks cannot reach."""
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def database_append(spark: SparkSession, d: str) -> DataFrame:
    """Two batches appended, the second twice."""
    url, properties = _database()
    sink = K.JdbcSink(url, "stats_hourly", properties, in_process=True)
    for batch, rows in ((0, 0), (1, 1), (1, 1)):
        sink.write(I.traffic(_halves(web_events(spark, d))[rows], 86_400_000).select("window_start", "total_events"), batch)
    return sink.read(spark)


def database_replace(spark: SparkSession, d: str) -> DataFrame:
    """A table refilled: what was there is gone."""
    url, properties = _database()
    sink = K.JdbcSink(url, "popular_items", properties, replace=True, in_process=True)
    for batch, rows in enumerate(_halves(web_events(spark, d))):
        sink.write(I.popular_items(rows, 20), batch)
    return sink.read(spark).drop("batch_id")


def database_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Counters by item, the second batch twice: clicks are added up, orders are those of the last batch."""
    url, properties = _database()
    sink = K.JdbcSink(url, "stats_items", properties, keys=("aid",), add=("total_clicks",), in_process=True)
    for batch, rows in ((0, 0), (1, 1), (1, 1)):
        sink.write(I.item_conversion(_halves(web_events(spark, d))[rows]).select("aid", "total_clicks", "total_orders"), batch)
    return sink.read(spark).drop("batch_id")


# ---- normalisation


def tolerant_types(spark: SparkSession, d: str) -> DataFrame:
    """Raw kinds, padded and in capitals, by their code; what is no event type counts as a click."""
    raw = web_events(spark, d).select(F.when(F.col("ts") % 3 == 0, F.upper("type")).when(F.col("ts") % 3 == 1, F.concat(F.lit(" "), "type")).otherwise(F.concat("type", F.lit("?"))).alias("type"))
    return raw.groupBy(N.type_code(strict=False).alias("code")).agg(F.count(F.lit(1)).alias("events"))


def invalid_types(spark: SparkSession, d: str) -> DataFrame:
    raw = web_events(spark, d).select(F.when(F.col("ts") % 3 == 2, F.concat("type", F.lit("?"))).otherwise(F.col("type")).alias("type"))
    return N.invalid_types(raw)


def narrow_events(spark: SparkSession, d: str) -> DataFrame:
    """Narrow columns, times in seconds, ids from 1, of events that have an item."""
    some = web_events(spark, d).withColumn("aid", F.when(F.col("ts") % 7 != 0, F.col("aid")))
    out = N.bounded_types(N.known_keys(N.to_seconds(some)))
    return out.withColumn("aid", N.shifted("aid")).withColumn("aid_again", N.unshifted("aid"))


def local_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events by the hour of a clock seven hours ahead."""
    hour = F.floor(F.unix_millis(N.event_time("ts", 7)) / 3_600_000) % 24
    return web_events(spark, d).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("events"))


QUERIES = {
    "nested_parquet": nested_parquet,
    "flat_parquet": flat_parquet,
    "jsonl_events": lambda spark, d: X.read_jsonl(spark, _jsonl(spark, d)),
    "jsonl_clicks": jsonl_clicks,
    "jsonl_converted": jsonl_converted,
    "folder_scan": folder_scan,
    "tsv_interactions": tsv_interactions,
    "csv_items": csv_items,
    "atomic_interactions": atomic_interactions,
    "submission_csv": submission_csv,
    "prediction_csv": prediction_csv,
    "adjacency_lookup": adjacency_lookup,
    "dumped_table": dumped_table,
    "artefacts": artefacts,
    "decoded_messages": decoded_messages,
    "replayed_sessions": replayed,
    "purged_events": purged,
    "upserted_popular": upserted_popular,
    "added_counters": added_counters,
    "database_append": database_append,
    "database_replace": database_replace,
    "database_upserts": database_upserts,
    "tolerant_types": tolerant_types,
    "invalid_types": invalid_types,
    "narrow_events": narrow_events,
    "local_hours": local_hours,
}

_EVENTS = _sql("SELECT session, aid, ts, type FROM ev")
_POPULAR = """SELECT event_type, aid, count, CAST(rank AS INT) AS rank, p FROM (SELECT *, row_number() OVER (PARTITION BY event_type, p ORDER BY count DESC, aid) AS rank FROM
        (SELECT type AS event_type, aid, ts // 86400000 % 2 AS p, count(*) AS count FROM ev GROUP BY ALL)) WHERE rank <= {0}"""

ORACLES = {
    "nested_parquet": _EVENTS,
    "flat_parquet": _EVENTS,
    "jsonl_events": _EVENTS,
    "jsonl_clicks": _sql("SELECT session, aid, ts, type FROM ev WHERE type = 'clicks'"),
    "jsonl_converted": _EVENTS,
    "folder_scan": _EVENTS,
    "tsv_interactions": _sql('SELECT CAST(session AS INT) AS "user", CAST(aid AS INT) AS item FROM ev'),
    "csv_items": _sql("SELECT DISTINCT aid FROM ev"),
    "atomic_interactions": _sql('SELECT session AS "session:token", aid AS "aid:token", CAST(ts AS DOUBLE) AS "ts:float" FROM ev'),
    "submission_csv": _sql("SELECT session || '_clicks' AS session_type, array_to_string(list_sort(list_distinct(array_agg(aid))), ' ') AS labels FROM ev GROUP BY session"),
    "prediction_csv": _sql("""SELECT session AS user_id, aid AS item_id, CAST(r AS INT) AS rank, CAST(n AS DOUBLE) AS score FROM
        (SELECT session, aid, count(*) AS n, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, aid) AS r FROM ev GROUP BY session, aid) WHERE r <= 5"""),
    "adjacency_lookup": _sql(
        f"SELECT aid1 AS aid, string_agg(CAST(aid2 AS VARCHAR), ' ' ORDER BY rank) AS candidates FROM edges WHERE rank <= 5 AND aid1 IN ({', '.join(map(str, LOOKED_UP))}) GROUP BY aid1", PURCHASE_SQL, _unified(MONTH_MS)
    ),
    "dumped_table": _sql("""SELECT aid, k AS total_clicks, c AS total_carts, o AS total_orders, round(CASE WHEN k > 0 THEN c / k ELSE 0 END, 6) AS click_to_cart_rate,
        round(CASE WHEN k > 0 THEN o / k ELSE 0 END, 6) AS click_to_order_rate, round(CASE WHEN c > 0 THEN o / c ELSE 0 END, 6) AS cart_to_order_rate
        FROM (SELECT aid, count(*) FILTER (type = 'clicks') AS k, count(*) FILTER (type = 'carts') AS c, count(*) FILTER (type = 'orders') AS o FROM ev GROUP BY aid)"""),
    "artefacts": _sql(
        """SELECT event_type, aid, count, CAST(rank AS INT) AS rank, click_all, cart_all FROM
        (SELECT type AS event_type, aid, count(*) AS count, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, aid) AS rank FROM ev GROUP BY type, aid)
        JOIN (SELECT aid, count(*) FILTER (type = 'clicks') AS click_all, count(*) FILTER (type = 'carts') AS cart_all FROM ev GROUP BY aid) USING (aid) WHERE rank <= 20"""
    ),
    "decoded_messages": _sql("SELECT session AS session_id, aid, type, ts FROM ev"),
    "replayed_sessions": _sql("""SELECT session AS session_id, aid, type, 1706000000000 + row_number() OVER (PARTITION BY session ORDER BY ts, aid, type) - 1 AS ts
        FROM ev SEMI JOIN (SELECT DISTINCT session FROM ev ORDER BY session LIMIT 100) USING (session)"""),
    "purged_events": _sql("SELECT session, aid, ts, type FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - 604800000"),
    "upserted_popular": _sql(
        "SELECT 'all_time' AS time_scope, event_type, aid, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type, aid ORDER BY p DESC) AS n FROM (" + _POPULAR.format(50) + ")) WHERE n = 1"
    ),
    "added_counters": _sql("""SELECT aid, k AS total_clicks, o AS total_orders, round(CASE WHEN k > 0 THEN o / k ELSE 0 END, 6) AS click_to_order_rate
        FROM (SELECT aid, count(*) FILTER (type = 'clicks') AS k, count(*) FILTER (type = 'orders') AS o FROM ev GROUP BY aid)"""),
    "database_append": _sql("SELECT ts // 86400000 * 86400000 AS window_start, count(*) AS total_events, ts // 86400000 % 2 AS batch_id FROM ev GROUP BY ALL"),
    "database_replace": _sql("SELECT event_type, aid, count, rank FROM (" + _POPULAR.format(20) + ") WHERE p = 1"),
    "database_upserts": _sql("""SELECT aid, CAST(sum(k) AS BIGINT) AS total_clicks, arg_max(o, p) AS total_orders FROM
        (SELECT aid, ts // 86400000 % 2 AS p, count(*) FILTER (type = 'clicks') AS k, count(*) FILTER (type = 'orders') AS o FROM ev GROUP BY ALL) GROUP BY aid"""),
    "tolerant_types": _sql("SELECT CASE WHEN ts % 3 = 2 OR type = 'clicks' THEN 0 WHEN type = 'carts' THEN 1 ELSE 2 END AS code, count(*) AS events FROM ev GROUP BY 1"),
    "invalid_types": _sql("SELECT DISTINCT type || '?' AS type FROM ev WHERE ts % 3 = 2"),
    "narrow_events": _sql("""SELECT session, CAST(aid + 1 AS INT) AS aid, CAST(aid AS INT) AS aid_again, ts // 1000 AS ts, CAST(CASE type WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END AS TINYINT) AS type
        FROM ev WHERE ts % 7 <> 0"""),
    "local_hours": _sql("SELECT (ts // 3600000 + 7) % 24 AS hour, count(*) AS events FROM ev GROUP BY 1"),
}
