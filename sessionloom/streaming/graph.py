"""The unified graph kept up to date: a batch changes the pairs of its sessions and ranks anew the items that they touch, and nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.operators import covisit as V
from sessionloom.operators.items import top_by
from sessionloom.streaming.sinks import MergeSink, Sink

#: Bonus of two types by their codes; the last code is that of any other type.
BONUS = np.array([[C.PAIR_BONUS.get((a, b)) or C.PAIR_BONUS.get((b, a), 1) for b in (*C.EVENT_TYPES, None)] for a in (*C.EVENT_TYPES, None)])
#: Events of sessions that are paired at once.
EVENTS_AT_ONCE = 1 << 16


class GraphSink(Sink):
    """Three keyed tables: each session's tail, weights of ordered pairs by their first item, and each item's ranked neighbours.

    A session counts by its tail as it is now: a batch adds the pairs of the new tail and takes away those of the old one, so a session
    that spans batches counts once, and pairs that left its tail count no more. The last ``tail`` events of a session are the last of its old tail
    and its new events, so older events are not needed. Tables are versioned by batch: a repeated batch starts from what it started from.
    Old and new tail of a session meet in one row, so its pairs are told apart and taken from each other there and only sums by items move.
    """

    def __init__(self, path: str, k: int = C.TOP_K, gap_ms: int = C.DAY_MS, window: int = C.WINDOW_SIZE, tail: int = C.TAIL_SIZE, parts: int = 8):
        self.k, self.gap_ms, self.window, self.tail = k, gap_ms, window, tail
        self.tails = MergeSink(f"{path}/tails", ["session"], parts=parts)
        self.weights = MergeSink(f"{path}/weights", ["aid1", "aid2"], add=("wgt",), parts=parts, by=["aid1"])
        self.ranked = MergeSink(f"{path}/ranked", ["aid"], parts=parts)

    def changed_tails(self, table: DataFrame, batch_id: int) -> DataFrame:
        """(session, old, e, new) of all sessions in the parts that the batch touches: the tail before and now, and whether the batch has the session."""
        come = V.tails(table, self.tail).withColumn("new", F.lit(True))
        kept = self.tails.read(table.sparkSession, batch_id, self.tails.touched(table))
        if kept is None:
            return come.select("session", F.slice("e", 1, 0).alias("old"), "e", "new")
        # a null session is a session like any other
        both = come.withColumnRenamed("e", "come").join(kept.select(F.col("session").alias("of"), F.col("e").alias("old")), F.col("session").eqNullSafe(F.col("of")), "full")
        e = F.sort_array(F.concat(*(F.coalesce(c, F.array().cast(kept.schema["e"].dataType)) for c in ("old", "come"))))
        last = F.slice(e, F.greatest(F.size(e) - self.tail, F.lit(0)) + 1, self.tail)
        return both.select(F.coalesce("session", "of").alias("session"), "old", last.alias("e"), F.col("new").isNotNull().alias("new"))

    def change(self, tails: DataFrame) -> DataFrame:
        """(aid1, aid2, wgt), both ways: what the weights of pairs change by."""
        gap_ms, window = self.gap_ms, self.window
        sums = tails.filter("new").select("old", "e").mapInArrow(lambda batches: pair_changes(batches, gap_ms, window), "low long, high long, wgt long")
        sums = sums.groupBy("low", "high").agg(F.sum("wgt").alias("wgt")).filter("wgt != 0")
        ways = F.explode(F.array(F.struct(F.col("low").alias("aid1"), F.col("high").alias("aid2")), F.struct(F.col("high").alias("aid1"), F.col("low").alias("aid2"))))
        return sums.select(ways.alias("x"), "wgt").select("x.aid1", "x.aid2", "wgt")

    def write(self, table: DataFrame, batch_id: int) -> None:
        spark = table.sparkSession
        tails = self.changed_tails(table.select("session", "ts", "aid", "type"), batch_id).persist()
        change = self.change(tails).persist()
        try:
            self.tails.replace(tails.select("session", "e"), batch_id)
            self.weights.write(change, batch_id)
            items = change.select(F.col("aid1").alias("aid")).distinct()
            now = self.weights.read(spark, batch_id + 1).select("aid1", "aid2", "wgt").filter("wgt > 0")
            best = top_by(now.join(items, F.col("aid1") == F.col("aid"), "left_semi"), ["aid1"], [F.desc("wgt"), F.desc("aid2")], self.k)
            lists = best.groupBy(F.col("aid1").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "aid2", "wgt"))).alias("neighbours"))
            # an item that has lost all its neighbours has an empty list
            self.ranked.write(items.join(lists, F.col("aid") == F.col("of"), "left").select("aid", "neighbours"), batch_id)
        finally:
            change.unpersist()
            tails.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        """(aid1, aid2, wgt, rank), as ``covisit.unified_edges`` over all events so far."""
        rows = self.ranked.read(spark).select(F.col("aid").alias("aid1"), F.explode("neighbours").alias("x"))
        return rows.select("aid1", "x.aid2", "x.wgt", "x.rank")


def pair_changes(batches: Iterator[pa.RecordBatch], gap_ms: int, window: int) -> Iterator[pa.RecordBatch]:
    """Of rows of tails (old, e) the sums of bonuses by two items, low < high: those of the distinct pairs of ``e`` less those of ``old``."""
    for batch in batches:
        ends = np.cumsum(sum(pc.list_value_length(batch.column(c)).fill_null(0).to_numpy() for c in ("old", "e")))
        at = 0
        while at < batch.num_rows:
            # so many sessions as have the events, one at least
            before = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, before + EVENTS_AT_ONCE, "right")))
            yield _summed(batch.slice(at, until - at), gap_ms, window)
            at = until


def _summed(batch: pa.RecordBatch, gap_ms: int, window: int) -> pa.RecordBatch:
    old, now = batch.column("old"), batch.column("e")
    lengths = np.concatenate([pc.list_value_length(c).fill_null(0).to_numpy() for c in (old, now)])
    events = pa.concat_arrays([pa.StructArray.from_arrays(c.flatten().flatten(), ["ts", "aid", "type"]) for c in (old, now)])
    ts, aid, kind = events.flatten()
    known = pc.and_(ts.is_valid(), aid.is_valid()).to_numpy(zero_copy_only=False)
    ts, tail = ts.fill_null(0).to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
    aids, item = np.unique(aid.fill_null(0).to_numpy(), return_inverse=True)
    words = kind.dictionary_encode()
    word = words.indices.fill_null(len(words.dictionary)).to_numpy().astype(np.int64)
    code = np.array([C.TYPE_CODE.get(w, len(C.EVENT_TYPES)) for w in (*words.dictionary.to_pylist(), None)])
    # an item with a type is a node; nodes ascend by item
    nodes, node = np.unique(item * len(code) + word, return_inverse=True)
    n, keys = len(nodes), [np.empty(0, np.int64)]
    for d in range(1, min(window, len(item) - 1) + 1):
        x, y = node[:-d], node[d:]
        near = (tail[:-d] == tail[d:]) & (item[:-d] != item[d:]) & (np.abs(ts[d:] - ts[:-d]) < gap_ms) & known[:-d] & known[d:]
        keys.append((tail[d:][near] * n + np.minimum(x, y)[near]) * n + np.maximum(x, y)[near])
    found = np.unique(np.concatenate(keys))  # a pair counts once a tail
    of, pair = np.divmod(found, n * n) if n else (found, found)
    low, high = (nodes[p] for p in np.divmod(pair, n)) if n else (pair, pair)
    bonus = np.where(of < len(old), -1, 1) * BONUS[code[low % len(code)], code[high % len(code)]]
    pairs, place = np.unique(low // len(code) * len(aids) + high // len(code), return_inverse=True)
    wgt = np.zeros(len(pairs), np.int64)
    np.add.at(wgt, place, bonus)
    pairs, wgt = pairs[wgt != 0], wgt[wgt != 0]
    low, high = np.divmod(pairs, max(len(aids), 1))
    return pa.RecordBatch.from_arrays([pa.array(aids[low]), pa.array(aids[high]), pa.array(wgt)], ["low", "high", "wgt"])
