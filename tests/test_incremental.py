"""State kept over batches: the graph, keyed sessions, hits, sketches; and lookups that read one file a bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import covisit as V
from sessionloom.operators import evaluate as E
from sessionloom.streaming import keyed, sinks
from sessionloom.streaming import unified as U
from sessionloom.streaming.graph import GraphSink

EVENTS = "session long, aid long, ts long, type string"
TYPES = ("clicks", "carts", "orders")
#: Streams begin with a watermark of 0: what is no later is late.
BASE = 1_700_000_000_000


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def events(spark):
    r = np.random.default_rng(8)
    rows = [(int(r.integers(12)), int(r.integers(15)), int(k * 60_000 + r.integers(60_000)), TYPES[r.integers(3)]) for k in range(600)]
    return spark.createDataFrame(rows + rows[:3], EVENTS).persist()


def test_graph_by_batches_is_the_whole_graph(spark, events, tmp_path):
    sink = GraphSink(str(tmp_path / "g"), tail=12, parts=2)
    edge = ("aid1", "aid2", "wgt", "rank")
    batches = [events.filter(F.floor(F.col("ts") / 9_000_001) == k) for k in range(4)]
    so_far = None
    for k, batch in enumerate(batches):
        so_far = batch if so_far is None else so_far.union(batch)
        sink.write(batch, k)
        assert rows_of(sink.read(spark), *edge) == rows_of(V.unified_edges(so_far, tail=12), *edge)
    # sessions span batches, and the last tail holds none of what the first batch brought
    assert batches[0].join(batches[3], "session", "left_semi").count() > 0
    sink.write(batches[3], 3)
    assert rows_of(sink.read(spark), *edge) == rows_of(V.unified_edges(events, tail=12), *edge)
    # a batch touches only the items of its sessions' pairs
    one = spark.createDataFrame([(999, 1, 10**9, "clicks"), (999, 2, 10**9 + 1, "orders")], EVENTS)
    sink.write(one, 4)
    assert {r.aid for r in spark.read.parquet(str(tmp_path / "g" / "weights" / "version=4")).select(F.col("aid1").alias("aid")).distinct().collect()} >= {1, 2}
    assert rows_of(sink.read(spark), *edge) == rows_of(V.unified_edges(events.union(one), tail=12), *edge)


def run(spark, stream, path):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), query


def batches_of(spark, batches, path, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_keyed_sessions_end_by_time_to_live(spark, tmp_path):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.rocksdb(spark)
    try:
        minute = 60_000
        batches = [
            [(1, 5, 0, "clicks"), (1, 6, 10 * minute, "carts"), (2, 7, 5 * minute, "clicks"), (1, 5, 10 * minute, "clicks")],
            [(1, 5, 20 * minute, "orders"), (2, 8, 36 * minute, "clicks"), (2, 9, 80 * minute, "carts")],  # 2 has a gap of 31 and of 44 minutes
            [(3, 1, 200 * minute, "clicks")],  # the watermark ends 1 and 2
            [(1, 4, 201 * minute, "clicks"), (1, 4, 100 * minute, "orders"), (3, 1, 500 * minute, "clicks")],  # 1 comes again, and late
        ]
        batches = [[(session, aid, BASE + ts, kind) for session, aid, ts, kind in rows] for rows in batches]
        found, query = run(spark, keyed.session_features(batches_of(spark, batches, tmp_path / "in", EVENTS)), tmp_path)
        found = found.withColumns({"session_start": F.col("session_start") - BASE, "last_ts": F.col("last_ts") - BASE})
        assert rows_of(found, "session", "session_start", "last_ts", "length", "n_clicks", "n_carts", "n_orders", "unique_items", "last_aid") == [
            (1, 0, 20 * minute, 4, 2, 1, 1, 2, 5),
            (1, 100 * minute, 100 * minute, 1, 0, 0, 1, 1, 4),
            (1, 201 * minute, 201 * minute, 1, 1, 0, 0, 1, 4),
            (2, 5 * minute, 5 * minute, 1, 1, 0, 0, 1, 7),
            (2, 36 * minute, 36 * minute, 1, 1, 0, 0, 1, 8),
            (2, 80 * minute, 80 * minute, 1, 0, 1, 0, 1, 9),
            (3, 200 * minute, 200 * minute, 1, 1, 0, 0, 1, 1),
        ]
        # one session is open at the end: its sums, its item, its timer
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_keyed_sessions_by_the_watermark_alone(spark, tmp_path):
    """An event that bridges two sessions joins them, and a session whose time to live ends with the watermark is given out."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.rocksdb(spark)
    try:
        minute = 60_000
        batches = [
            [(1, 5, 40 * minute, "clicks"), (2, 5, 2 * minute, "clicks"), (2, 6, 2 * minute, "carts")],
            [(1, 6, 0, "carts"), (1, 5, 20 * minute, "orders"), (3, 1, 72 * minute, "clicks")],  # 0 and 40 are two sessions without 20
            [(3, 2, 500 * minute, "clicks"), (4, 1, 468 * minute, "clicks"), (4, 1, 468 * minute + 1, "carts"), (5, 1, 468 * minute, "clicks")],
        ]
        batches = [[(session, aid, BASE + ts, kind) for session, aid, ts, kind in rows] for rows in batches]
        found, _ = run(spark, keyed.session_features(batches_of(spark, batches, tmp_path / "in", EVENTS)), tmp_path)
        found = found.withColumns({"session_start": F.col("session_start") - BASE, "last_ts": F.col("last_ts") - BASE})
        assert rows_of(found, "session", "session_start", "last_ts", "length", "unique_items", "last_aid") == [
            (1, 0, 40 * minute, 3, 2, 5),
            (2, 2 * minute, 2 * minute, 2, 2, 6),
            (3, 72 * minute, 72 * minute, 1, 1, 1),
            (5, 468 * minute, 468 * minute, 1, 1, 1),  # 498 minutes: the watermark; 4 ends a millisecond later
        ]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_hits_of_streams_are_those_of_the_batch(spark, tmp_path):
    hour = 3_600_000
    shown = [[(1, BASE, [1, 2], [3], [4]), (2, BASE, [9], [], [])], [(1, BASE + 30 * hour, [7], [8], [])]]
    bought = [[(1, 2, hour, "carts"), (1, 9, 2 * hour, "orders"), (2, 9, hour, "clicks")], [(1, 2, 40 * hour, "carts"), (1, 8, 31 * hour, "orders"), (2, 9, 24 * hour, "carts"), (2, 9, 24 * hour + 1, "carts"), (5, 1, hour, "carts")]]
    bought = [[(session, aid, BASE + ts, kind) for session, aid, ts, kind in rows] for rows in bought]
    lists = batches_of(spark, shown, tmp_path / "lists", "session long, shown_at long, clicks array<long>, carts array<long>, orders array<long>")
    found, _ = run(spark, keyed.online_hits(lists, batches_of(spark, bought, tmp_path / "events", EVENTS)), tmp_path / "run")
    columns = ("session", "aid", "event_type", "is_hit", "recall", "mrr", "ndcg")
    served = spark.createDataFrame([r for b in shown for r in b], "session long, shown_at long, clicks array<long>, carts array<long>, orders array<long>")
    events = spark.createDataFrame([r for b in bought for r in b], EVENTS)
    pairs = [(2, 1), (9, 1), (8, 2), (2, 2), (9, 3)]  # item, and its list: the first of session 1, the second, that of session 2
    want = []
    for aid, which in pairs:
        at = served.filter(f"session = {1 if which < 3 else 2} and shown_at = {BASE + (30 * hour if which == 2 else 0)}")
        within = events.filter(f"aid = {aid} and ts <= {BASE + (54 if which == 2 else 24) * hour} and ts >= {BASE + (30 * hour if which == 2 else 0)}")
        want += rows_of(E.online_hits(at, within), *columns)
    assert rows_of(found, *columns) == sorted(want) and len(want) == 5


def test_sketches_of_batches_unite(spark, tmp_path):
    many = spark.range(60_000).select((F.col("id") % 20_000).alias("session"), (F.col("id") % 777).alias("aid"), (F.col("id") * 97 % 7_200_000).alias("ts"), F.lit("clicks").alias("type"), F.when(F.col("id") % 2 == 0, "a").alias("model_used"))
    sink = sinks.MergeSink(str(tmp_path / "s"), ["window_start", "model_used"], add=("total_events",), sketches=("session_sketch", "aid_sketch"))
    for k in range(3):  # batches share all minutes
        sink.write(U.traffic_sketches(many.filter(F.col("session") % 3 == k)), k)
    sink.write(U.traffic_sketches(many.filter(F.col("session") % 3 == 2)), 2)
    stored = sink.read(spark)
    assert stored.count() == 194
    whole = U.united(stored, {"all": F.lit(1)}).first()
    assert whole.total_events == 60_000 and abs(whole.unique_sessions - 20_000) < 0.05 * 20_000 and abs(whole.unique_aids - 777) < 0.05 * 777
    by_model = {r.model_used: r.unique_sessions for r in U.united(stored, {"model_used": F.col("model_used")}).collect()}
    assert set(by_model) == {"a", "unknown"} and all(abs(n - 10_000) < 500 for n in by_model.values())


def test_lookup_opens_the_files_of_its_buckets(spark, events, tmp_path):
    path, edges = str(tmp_path / "a"), V.adjacency(V.unified_edges(events))
    sinks.publish_adjacency(edges, path)
    whole = {r.aid: r.candidates for r in edges.collect()}
    for items in ([3], [1, 2, 3, 4], [10**6], []):
        found = sinks.lookup(spark, path, items)
        assert {r.aid: r.candidates for r in found.collect()} == {k: v for k, v in whole.items() if k in items}
        asked = {r[0] for r in spark.createDataFrame([(i,) for i in items], "aid long").select(F.pmod(F.xxhash64("aid"), F.lit(16))).collect()} if items else set()
        there = {int(f.split("bucket=")[1].split("/")[0]) for f in spark.read.parquet(path).inputFiles()}
        if items:
            scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            assert scan.metrics().apply("numFiles").value() == len(asked & there)
