"""Batches of several files, and a graph whose pairs change inside their session."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sessionloom.operators import covisit as V
from sessionloom.plans import streams
from sessionloom.streaming import graph

EVENTS = "session long, aid long, ts long, type string"
EDGE = ("aid1", "aid2", "wgt", "rank")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_batch_is_a_quarter_in_several_files(spark, monkeypatch):
    # quarters of 1, 0, 300 and 30 rows, the last ones in one partition
    rows = [(0, 0, 0, "clicks")] + [(k, k % 7, 5000 + k, "carts") for k in range(300)] + [(k, k % 7, 9000 - k, "orders") for k in range(30)]
    events = spark.createDataFrame(rows, EVENTS).coalesce(1).union(spark.createDataFrame(rows[:0], EVENTS)).union(spark.range(300).select((F.col("id") % 9).alias("session"), F.lit(1).cast("long").alias("aid"), (F.col("id") + 4501).alias("ts"), F.lit("clicks").alias("type")).repartition(3))
    monkeypatch.setattr(streams, "web_events", lambda *_: events)
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    got, files = {}, {}

    def keep(batch, k):
        got[k], files[k] = rows_of(batch, "session", "aid", "ts", "type"), batch.select(F.input_file_name()).distinct().count()

    stream = streams.quarter_stream(spark, "")
    stream.writeStream.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    first, span = 0, 9001
    want = {k: rows_of(events.filter(F.floor((F.col("ts") - first) * 4 / span) == k), "session", "aid", "ts", "type") for k in range(4)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and want[1] == []
    assert max(files.values()) > 1


def test_batches_with_nulls_and_late_events_are_the_whole_graph(spark, tmp_path):
    r = np.random.default_rng(3)
    none = lambda v: None if r.integers(12) == 0 else v
    kinds = ("clicks", "carts", "orders", "seen", "shared")
    rows = [(none(int(r.integers(8))), none(int(r.integers(9))), none(int(r.integers(10**6))), none(kinds[r.integers(5)])) for _ in range(500)]
    sink, whole = graph.GraphSink(str(tmp_path / "g"), tail=9, parts=2), spark.createDataFrame(rows, EVENTS)
    sink.write(spark.createDataFrame(rows[:300], EVENTS), 0)
    sink.write(spark.createDataFrame(rows[300:], EVENTS), 1)
    want = rows_of(V.unified_edges(whole, tail=9), *EDGE)
    assert want and rows_of(sink.read(spark), *EDGE) == want


def test_pairs_do_not_leave_their_session(spark, tmp_path):
    sink = graph.GraphSink(str(tmp_path / "g"))
    tails = sink.changed_tails(spark.createDataFrame([(s, k % 7, k, "carts") for s in range(20) for k in range(9)], EVENTS), 0).persist()
    assert tails.count() == 20
    plan = sink.change(tails)._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("InMemoryTableScan")]
    assert re.findall(r"Exchange hashpartitioning\(low\S+ high", plan) and plan.count("Exchange") == 1
    tails.unpersist()


def test_sessions_are_paired_in_pieces(monkeypatch):
    r = np.random.default_rng(4)
    tail = lambda: [{"ts": int(t), "aid": int(r.integers(5)), "type": ("clicks", "orders")[r.integers(2)]} for t in sorted(r.integers(99, size=r.integers(9)))]
    rows = [{"old": None if k % 5 == 0 else tail(), "e": tail()} for k in range(60)]
    kind = pa.list_(pa.struct([("ts", pa.int64()), ("aid", pa.int64()), ("type", pa.string())]))
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("old", kind), ("e", kind)]))
    want = {}
    for row in rows:
        for sign, events in ((-1, row["old"] or []), (1, row["e"])):
            near = {tuple(sorted([(x["aid"], x["type"]), (y["aid"], y["type"])])) for i, x in enumerate(events) for y in events[i + 1 : i + 6] if x["aid"] != y["aid"] and y["ts"] - x["ts"] < 50}
            for (a, s), (b, t) in near:
                want[a, b] = want.get((a, b), 0) + sign * {("clicks", "clicks"): 1, ("orders", "orders"): 10}.get((s, t), 4)
    for at_once in (1, 40, 10**6):
        monkeypatch.setattr(graph, "EVENTS_AT_ONCE", at_once)
        got, pieces = {}, list(graph.pair_changes(iter([batch, batch.slice(0, 0)]), 50, 5))
        for row in pa.Table.from_batches(pieces).to_pylist():
            got[row["low"], row["high"]] = got.get((row["low"], row["high"]), 0) + row["wgt"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert len(pieces) == 1 if at_once == 10**6 else len(pieces) > 1
