"""One event stream, six result tables.

``compat`` aggregates each micro-batch by itself, as a stream of batches; ``stateful`` queries keep windows and sessions under a real watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.util import inheritable_thread_target

from sessionloom.functions import constants as C
from sessionloom.functions.normalize import known_keys, rate
from sessionloom.operators import items as I
from sessionloom.operators import sessions as S
from sessionloom.streaming.sinks import Sink

#: Batches that the checkpoint keeps.
BATCHES_KEPT = 10
TABLES = ("stats_hourly", "anomaly_logs", "popular_items", "stats_items", "advanced_funnel_stats", "stats_sessions")


def batch_tables(events: DataFrame, k: int = 100, exact: bool = False) -> dict[str, DataFrame]:
    """The six aggregates of a batch of (session, aid, type, ts, model_used). ``exact`` counts sessions by model without a sketch."""
    return {
        "stats_hourly": I.traffic(events),
        "anomaly_logs": S.bot_sessions(events),
        "popular_items": I.popular_items(events, k).withColumn("time_scope", F.lit("all_time")),
        "stats_items": I.item_conversion(events),
        "advanced_funnel_stats": S.model_funnel(events.na.fill("unknown", ["model_used"]), exact=exact),
        "stats_sessions": S.segment_durations(events),
    }


def from_messages(stream: DataFrame, offset_hours: int = 0) -> DataFrame:
    """Messages as events, the time moved by whole hours if a local clock is wanted."""
    return stream.select(F.col("session_id").alias("session"), "aid", "type", (F.col("ts") + offset_hours * 3_600_000).alias("ts"), "model_used")


def start_compat(stream: DataFrame, sinks: dict[str, Sink], checkpoint: str, trigger: dict | None = None, k: int = 100, exact: bool = False) -> StreamingQuery:
    """Write each micro-batch's six tables, side by side. The batch is kept while they are made; a sink that fails does not stop the others, and the batch then fails as a whole and is repeated.

    Sinks are idempotent by batch id, so a repeated batch leaves no duplicates. Spark keeps the last BATCHES_KEPT batches of the checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.minBatchesToRetain", str(BATCHES_KEPT))

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = known_keys(batch).persist()
        tables = {name: table for name, table in batch_tables(kept, k, exact).items() if name in sinks}
        try:
            with ThreadPoolExecutor(max(1, len(tables))) as pool:
                jobs = [pool.submit(inheritable_thread_target(sinks[name].write), table, batch_id) for name, table in tables.items()]
            failed = [e for e in (job.exception() for job in jobs) if e]
        finally:
            kept.unpersist()
        if failed:
            raise failed[0]

    writer = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": C.TRIGGER})).start()


def start_buffered(stream: DataFrame, sink: Sink, checkpoint: str, seconds: int = 5, trigger: dict | None = None) -> StreamingQuery:
    """Hand on what has come every few seconds, as one batch: a buffer that Spark keeps, and repeats if the sink fails. Its bound is the source's limit a trigger."""
    writer = stream.writeStream.outputMode("append").foreachBatch(sink.write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{seconds} seconds"})).start()


def windowed_traffic(stream: DataFrame, watermark: str = C.WATERMARK, width: str = C.TUMBLING, slide: str | None = None) -> DataFrame:
    """Traffic by tumbling (or sliding) windows of event time; late data beyond the watermark is dropped. Distinct counts are sketches."""
    timed = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", watermark)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    sums = timed.groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("total_events"), *(S.count_type(t).alias(f"total_{t}") for t in C.EVENT_TYPES), F.approx_count_distinct("session").alias("unique_sessions"), F.approx_count_distinct("aid").alias("unique_items")
    )
    clicks, carts, orders = (F.col(f"total_{t}") for t in C.EVENT_TYPES)
    flat = sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in sums.columns if c != "w"])
    return flat.withColumns({"click_to_cart_rate": rate(carts, clicks), "cart_to_order_rate": rate(orders, carts)})


def session_windows(stream: DataFrame, gap: str = "30 minutes", watermark: str = C.WATERMARK) -> DataFrame:
    """Sessions as runs of events with gaps below the time to live: start, end, length and events by type."""
    timed = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", watermark)
    sums = timed.groupBy(F.session_window("at", gap).alias("w"), "session").agg(F.count(F.lit(1)).alias("length"), *(S.count_type(t).alias(f"n_{t}") for t in C.EVENT_TYPES))
    return sums.select("session", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "length", *(f"n_{t}" for t in C.EVENT_TYPES))


def without_repeats(stream: DataFrame, watermark: str = C.WATERMARK) -> DataFrame:
    """Events that repeat within the watermark once."""
    timed = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", watermark)
    return timed.dropDuplicatesWithinWatermark(["session", "aid", "type", "ts"]).drop("at")


class ProgressListener(StreamingQueryListener):
    """Hands each batch's figures to ``emit`` as a dict: a row of spark_metrics."""

    def __init__(self, emit: Callable[[dict], None]):
        self.emit = emit

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.emit({"query_id": str(p.id), "query_name": p.name, "batch_id": p.batchId, "input_rows_per_second": p.inputRowsPerSecond, "process_rows_per_second": p.processedRowsPerSecond, "batch_duration_ms": p.durationMs.get("triggerExecution", 0), "timestamp": p.timestamp})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def traffic_sketches(events: DataFrame, width_ms: int = 60_000, lg_size: int = 12) -> DataFrame:
    """Per tumbling window and model: events, and sketches of the sessions and items among them, which can be united."""
    start = F.expr(f"ts div {width_ms} * {width_ms}").alias("window_start")
    sketch = lambda c: F.hll_sketch_agg(c, lg_size).alias(f"{c}_sketch")
    known = events.na.fill("unknown", ["model_used"])
    return known.groupBy(start, "model_used").agg(F.count(F.lit(1)).alias("total_events"), sketch("session"), sketch("aid"))


def united(sketches: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Events and distinct sessions and items by other keys, from stored sketches alone: hours from minutes, all models together."""
    distinct = lambda c: F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"unique_{c}s")
    return sketches.groupBy(*(v.alias(n) for n, v in keys.items())).agg(F.sum("total_events").alias("total_events"), distinct("session"), distinct("aid"))
