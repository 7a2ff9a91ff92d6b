"""Keyed state over batches: running session features that end by time to live, and served lists met by what is bought later."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from sessionloom.functions import constants as C
from sessionloom.operators import evaluate as E

FEATURES = "session long, session_start long, last_ts long, length long, n_clicks long, n_carts long, n_orders long, unique_items long, last_aid long"
_ROW = Row(*(f.split()[0] for f in FEATURES.split(", ")))
#: A session's runs of events that the watermark has not passed.
STATE = "runs array<struct<session_start: long, last_ts: long, n_clicks: long, n_carts: long, n_orders: long, last_aid: long, items: array<long>>>"


class SessionFeatures(StatefulProcessor):
    """Of each session its start, last event, events by type and distinct items, in milliseconds; given out when the session ends.

    A session ends where more than the time to live passes without an event, and is given out when the watermark has passed that time. Until then it is
    kept, and events join it in whatever order they come, those that bridge two sessions too. Late events are not dropped: where the session that they
    would have joined has been given out, they are sessions of their own. A key has one value as its state and one timer, at the first end of a session.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", STATE)

    def _first_end(self, runs: list[tuple]) -> int:
        return min(last for _, last, *_ in runs) + self.ttl_ms

    def _joined(self, runs: list[tuple]) -> list[tuple]:
        """Runs no more than the time to live apart as one."""
        out: list[tuple] = []
        for run in sorted(runs, key=lambda r: r[:2]):
            if out and run[0] <= out[-1][1] + self.ttl_ms:
                start, last, *counts, aid, items = out[-1]
                end, aid = max((last, aid), (run[1], run[5]))
                items.update(run[6])
                out[-1] = (start, end, *(a + b for a, b in zip(counts, run[2:5], strict=True)), aid, items)
            else:
                out.append((*run[:6], set(run[6])))
        return out

    def _given_out(self, session: int, runs: list[tuple], watermark: int) -> Iterator[Row]:
        """Those that have ended; the others stay, with a timer."""
        still = [run for run in runs if run[1] + self.ttl_ms > watermark]
        if still:
            self.runs.update(([(*run[:6], sorted(run[6])) for run in still],))
            self.handle.registerTimer(self._first_end(still))
        else:
            self.runs.clear()
        for run in runs:
            if run[1] + self.ttl_ms <= watermark:
                start, last, clicks, carts, orders, aid, items = run
                yield _ROW(session, start, last, clicks + carts + orders, clicks, carts, orders, len(items), aid)

    def _kept(self) -> list[tuple]:
        return [tuple(run) for run in self.runs.get()[0]] if self.runs.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self._kept()
        new = [(r["ts"], r["ts"], *(int(C.TYPE_CODE[r["type"]] == k) for k in range(3)), r["aid"], (r["aid"],)) for r in rows]
        if kept:
            self.handle.deleteTimer(self._first_end(kept))
        yield from self._given_out(key[0], self._joined(kept + new), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._given_out(key[0], self._joined(self._kept()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def session_features(stream: DataFrame, ttl_ms: int = C.SESSION_TTL_SECONDS * 1000, watermark: str = C.WATERMARK) -> DataFrame:
    """Rows of FEATURES for each session that has ended. stream: (session, aid, type, ts). Spark must keep state in RocksDB (see ``rocksdb``)."""
    timed = stream.select("session", "aid", "type", "ts", F.timestamp_millis("ts").alias("at")).withWatermark("at", watermark)
    return timed.groupBy("session").transformWithState(SessionFeatures(ttl_ms), FEATURES, "Append", "EventTime")


def rocksdb(spark) -> None:
    """State of many keys stands outside the heap; keyed timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def online_hits(lists: DataFrame, events: DataFrame, within: str = "1 day", k: int = 20, watermark: str = C.WATERMARK) -> DataFrame:
    """As ``evaluate.online_hits`` over two streams: each cart or order meets the lists shown to its session in the time before it.

    lists: (session, shown_at, clicks, carts, orders); events: (session, aid, type, ts); times in milliseconds. A list's state goes when the
    watermark is ``within`` beyond it, an event's when no list can come any more.
    """
    shown = lists.withColumn("shown", F.timestamp_millis("shown_at")).withWatermark("shown", watermark).withColumnRenamed("session", "of")
    bought = events.filter(F.col("type").isin(C.CART, C.ORDER)).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", watermark)
    same = (F.col("session") == F.col("of")) & (F.col("at") >= F.col("shown")) & (F.col("at") <= F.col("shown") + F.expr(f"INTERVAL {within}"))
    return E.hits(bought.join(shown, same).withColumn("served", F.concat("clicks", "carts", "orders")), k, "shown_at", "ts")
