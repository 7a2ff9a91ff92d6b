"""Queries over result tables: predictions, freshness, health, verdicts, fallbacks, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.normalize import rate
from sessionloom.operators.ordered import quantiles

#: Targets: (metric, pass below, warn below); throughput passes above.
TARGETS = {"api_p50_ms": (100, 200), "api_p95_ms": (200, 500), "error_rate": (0.001, 0.01), "batch_ms": (5000, 10_000), "e2e_p50_s": (10, 30), "e2e_p95_s": (30, 60)}
SLOW_BATCH_MS = 10_000


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order: a top-n report."""
    return rows.orderBy(*order).limit(n)


def prediction_stats(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("predictions"), F.avg("latency_ms").alias("avg_latency_ms"), F.count_distinct("session_id").alias("sessions"))


def model_usage(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model_used").agg(F.count(F.lit(1)).alias("count"), F.avg("latency_ms").alias("avg_latency_ms"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """Per event type: events, hits, hit rate."""
    return hits.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_hit").alias("hits"), F.avg(F.col("is_hit").cast("double")).alias("hit_rate"))


def metric_trend(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.filter(F.col("metric_name") == name).groupBy("model_used").agg(F.avg("metric_value").alias("avg_value"), F.count(F.lit(1)).alias("count"), F.max("created_at").alias("last_at"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model_used", "metric_name", "event_type").agg(F.avg("metric_value").alias("avg_value"), F.count(F.lit(1)).alias("count"))


def freshness(events: DataFrame, now_sec: Column, column: str = "created_sec") -> DataFrame:
    """Age of events in seconds: number, mean, interpolated quantiles, greatest, verdict by the median."""
    age = events.select((now_sec - F.col(column)).alias("age"))
    shares = (0.5, 0.9, 0.95)
    exact = [F.lit(v).cast("double").alias(f"p{int(100 * q)}") for q, v in zip(shares, quantiles(age, "age", shares), strict=True)]
    sums = age.agg(F.count(F.lit(1)).alias("events"), F.avg("age").alias("avg_age"), *exact, F.max("age").alias("max_age"))
    return sums.withColumn("verdict", F.when(F.col("p50") < 10, "PASS").when(F.col("p50") < 30, "WARN").otherwise("FAIL"))


def batch_health(batches: DataFrame) -> DataFrame:
    """batches: (input_rows_per_second, process_rows_per_second, batch_duration_ms). Efficiency has no value without input."""
    sums = batches.agg(
        F.count(F.lit(1)).alias("batches"), F.avg("batch_duration_ms").alias("avg_ms"), F.max("batch_duration_ms").alias("max_ms"), F.coalesce(F.avg("process_rows_per_second"), F.lit(0.0)).alias("avg_rows_per_second"),
        F.avg(F.try_divide("process_rows_per_second", F.nullif("input_rows_per_second", F.lit(0.0)))).alias("efficiency"), F.count_if(F.col("batch_duration_ms") > SLOW_BATCH_MS).alias("slow_batches"),
    )
    stability = F.col("avg_ms") / SLOW_BATCH_MS
    return sums.withColumn("stability", stability).withColumn("verdict", F.when(stability < 0.5, "STABLE").when(stability < 1, "BUSY").otherwise("UNSTABLE"))


def verdict(metric: str, value: Column) -> Column:
    good, fair = TARGETS[metric]
    return F.when(value < good, "PASS").when(value < fair, "WARN").otherwise("FAIL")


def ranked(popular: DataFrame) -> DataFrame:
    """Popular items with their rank in each (event_type, time_scope), by count, ties to the smaller id."""
    return popular.withColumn("rank", F.row_number().over(Window.partitionBy("event_type", "time_scope").orderBy(F.desc("count"), "aid")))


def funnel_display(funnels: DataFrame, hourly: DataFrame) -> DataFrame:
    """Stages of the latest funnel row, else of the latest hourly row: (stage, sessions)."""
    last = funnels.groupBy().agg(F.max_by(F.struct(F.col("sessions_with_clicks").alias("clicks"), F.col("sessions_with_carts").alias("carts"), F.col("sessions_with_orders").alias("orders")), "computed_at").alias("f"))
    hour = hourly.groupBy().agg(F.max_by(F.struct(F.col("total_clicks").alias("clicks"), F.col("total_carts").alias("carts"), F.col("total_orders").alias("orders")), "window_start").alias("h"))
    row = last.crossJoin(hour).select(F.coalesce("f", "h").alias("x")).select("x.*")
    return row.unpivot([], ["clicks", "carts", "orders"], "stage", "sessions")


def weighted_gauge(metrics: DataFrame, name: str = "weighted_recall@20") -> DataFrame:
    """A gauge in per cent: the mean over models and event types of their mean value of a metric."""
    each = metric_summary(metrics.filter(F.col("metric_name") == name))
    return each.agg((100.0 * F.avg("avg_value")).alias("gauge_pct"))


def last_per_window(hourly: DataFrame, order: str = "id") -> DataFrame:
    """Of rows that repeat a window the latest written."""
    return latest_by(hourly, ["window_start"], order)


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one of greatest order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def melted(funnel: DataFrame) -> DataFrame:
    """A wide funnel row as (stage, sessions)."""
    return funnel.unpivot([], ["sessions_with_clicks", "sessions_with_carts", "sessions_with_orders"], "stage", "sessions")


def active_sessions(events: DataFrame, now_ms: Column, ttl_ms: int = 1_800_000) -> DataFrame:
    """Sessions whose last event is within the time to live."""
    last = events.groupBy("session").agg(F.max("ts").alias("last_ts"))
    return last.agg(F.count_if(F.col("last_ts") > now_ms - ttl_ms).alias("active_sessions"))


def guarded_rate(part: str, whole: str) -> Column:
    return rate(F.col(part), F.col(whole))


def retained(rows: DataFrame, column: str, now: Column, days: int = 30) -> DataFrame:
    """Rows not older than so many days."""
    return rows.filter(F.col(column) >= now - F.make_interval(days=F.lit(days)))
