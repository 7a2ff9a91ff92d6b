"""Aggregations over items: popularity, conversion, features, shares, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.functions.normalize import rate
from sessionloom.operators.ordered import quantiles, running
from sessionloom.operators.sessions import count_type, is_type


def top_by(counts: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1. Written so that Spark limits groups before the shuffle."""
    return counts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def popular_items(events: DataFrame, k: int = 100, since: Column | None = None) -> DataFrame:
    """The k commonest items of each event type, ties to the smaller id; ``since`` keeps later events only."""
    rows = events if since is None else events.filter(F.col("ts") >= since)
    counts = rows.groupBy(F.col("type").alias("event_type"), "aid").agg(F.count(F.lit(1)).alias("count"))
    return top_by(counts, ["event_type"], [F.desc("count"), F.asc("aid")], k)


def recent(events: DataFrame, days: int) -> DataFrame:
    """Events of the last so many days before the latest."""
    top = events.agg(F.max("ts").alias("top"))
    return events.crossJoin(F.broadcast(top)).filter(F.col("ts") >= F.col("top") - days * C.DAY_MS).drop("top")


def popular_candidates(events: DataFrame, k: int = 20, days: int = 7) -> DataFrame:
    """Distinct items among the k commonest of any type in the last days."""
    return popular_items(recent(events, days), k).select("aid").distinct()


def item_conversion(events: DataFrame) -> DataFrame:
    """Clicks, carts, orders of each item and the rates between them."""
    sums = events.groupBy("aid").agg(*(count_type(t).alias(f"total_{t}") for t in C.EVENT_TYPES))
    clicks, carts, orders = (F.col(f"total_{t}") for t in C.EVENT_TYPES)
    return sums.withColumns({"click_to_cart_rate": rate(carts, clicks), "click_to_order_rate": rate(orders, clicks), "cart_to_order_rate": rate(orders, carts)})


def item_features(events: DataFrame, suffix: str = "all") -> DataFrame:
    """Counts by type, distinct sessions, and ratios smoothed by 10."""
    sums = events.groupBy("aid").agg(F.count(F.lit(1)).alias("n"), *(count_type(t).alias(t[:-1]) for t in C.EVENT_TYPES), F.count_distinct("session").alias("sessions"))
    click, cart, order = F.col("click"), F.col("cart"), F.col("order")
    named = sums.withColumns({"cart_ratio": cart / (click + 10), "buy_ratio": order / (click + 10), "cart_buy_ratio": order / (cart + 10)})
    return named.select("aid", *(F.col(c).alias(f"{c}_{suffix}") for c in named.columns if c != "aid"))


def top_share(events: DataFrame, share: float = 0.01) -> DataFrame:
    """Per cent of interactions that the most used items (so large a part of the catalogue, one at least) have."""
    counts = events.groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    # items of one count are alike, so counts of counts say it all; that table has as many rows as there are distinct counts
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("items"))
    total = steps.agg(F.sum("items").alias("all_items"), F.sum(F.col("items") * F.col("n")).alias("all_events"))
    before = F.coalesce(F.sum("items").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.greatest(F.lit(1).cast("long"), F.floor(F.col("all_items") * share))
    took = steps.crossJoin(F.broadcast(total)).withColumn("head", head).withColumn("taken", F.least("items", F.greatest(F.col("head") - before, F.lit(0))))
    return took.agg(F.max("head").alias("top_items"), (100.0 * F.sum(F.col("taken") * F.col("n")) / F.max("all_events")).alias("top_share_pct"))


def long_tail(events: DataFrame) -> DataFrame:
    """How many items have each number of interactions."""
    return events.groupBy("aid").agg(F.count(F.lit(1)).alias("interactions")).groupBy("interactions").agg(F.count(F.lit(1)).alias("items"))


def item_places(events: DataFrame) -> DataFrame:
    """Items with their place, from 0, by number of interactions, ties to the smaller id: (aid, interactions, place)."""
    counts = events.filter("aid is not null").groupBy("aid").agg(F.count(F.lit(1)).alias("interactions"))
    counts = counts.withColumns({"one": F.lit(1).cast("long"), "less": -F.col("interactions")})
    before = running(counts.groupBy("less").agg(F.sum("one").alias("n")), "less", "n").select("less", "before")
    inside = running(counts, "aid", "one", "nth", ("less",))
    return inside.join(before, "less").select("aid", "interactions", (F.col("before") + F.col("nth")).alias("place"))


def hidden_gems(items: DataFrame, least_clicks: int = 10) -> DataFrame:
    """Of items with enough clicks, those whose conversion is in the upper and whose clicks are in the lower quarter."""
    enough = items.filter(F.col("total_clicks") >= least_clicks)
    rate_cut, click_cut = quantiles(enough, "click_to_order_rate", (0.75,))[0], quantiles(enough, "total_clicks", (0.25,))[0]
    return enough.filter((F.col("click_to_order_rate") >= F.lit(rate_cut)) & (F.col("total_clicks") <= F.lit(click_cut)))


def cold_start(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test sessions that touch items unknown to training: number, and per cent of all test sessions."""
    unknown = test.join(train.select("aid").distinct(), "aid", "left_anti").agg(F.count_distinct("session").alias("cold_sessions"))
    return unknown.crossJoin(test.agg(F.count_distinct("session").alias("sessions"))).withColumn("cold_pct", F.when(F.col("sessions") > 0, 100.0 * F.col("cold_sessions") / F.col("sessions")).otherwise(0.0))


def coverage(test: DataFrame, train: DataFrame) -> DataFrame:
    """Per cent of test items that training knows."""
    items = test.select("aid").distinct()
    return items.agg(F.count(F.lit(1)).alias("test_items")).crossJoin(items.join(train.select("aid").distinct(), "aid", "left_semi").agg(F.count(F.lit(1)).alias("known_items"))).withColumn("coverage_pct", F.when(F.col("test_items") > 0, 100.0 * F.col("known_items") / F.col("test_items")).otherwise(0.0))


def sampling_distribution(events: DataFrame, alpha: float = 0.75) -> DataFrame:
    """Cumulative probability of each item for popularity ** alpha sampling, in item order."""
    counts = events.filter("aid is not null").groupBy("aid").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha)).alias("weight"))
    total = counts.agg(F.sum("weight").alias("total"))
    sums = running(counts, "aid", "weight").crossJoin(F.broadcast(total))  # one row
    return sums.select("aid", "weight", ((F.col("before") + F.col("weight")) / F.col("total")).alias("cumulative"))


def dataset_stats(events: DataFrame) -> DataFrame:
    """Sessions, items, events, events by type, density in per cent, first and last time."""
    sums = events.agg(F.count_distinct("session").alias("sessions"), F.count_distinct("aid").alias("items"), F.count(F.lit(1)).alias("events"), *(count_type(t).alias(f"n_{t}") for t in C.EVENT_TYPES), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return sums.withColumn("density_pct", F.when(F.col("sessions") > 0, 100.0 * F.col("events") / F.col("sessions") / F.col("items")).otherwise(0.0))


def type_shares(events: DataFrame) -> DataFrame:
    counts = events.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def click_to_order_pct(events: DataFrame) -> DataFrame:
    return events.agg((100.0 * rate(F.count_if(is_type(C.ORDER)).cast("double"), F.count_if(is_type(C.CLICK)))).alias("click_to_order_pct"))


def hourly_types(events: DataFrame) -> DataFrame:
    """Events by hour of the day (UTC) and type."""
    return events.groupBy(F.expr("(ts div 3600000) % 24").alias("hour"), "type").agg(F.count(F.lit(1)).alias("count"))


def weekday_types(events: DataFrame) -> DataFrame:
    """Events by day of the week, Monday 1 to Sunday 7 (UTC), and type."""
    return events.groupBy(F.expr("(ts div 86400000 + 3) % 7 + 1").alias("weekday"), "type").agg(F.count(F.lit(1)).alias("count"))


def weekly_events(events: DataFrame) -> DataFrame:
    """Events by week since the first event."""
    first = events.agg(F.min("ts").alias("t0"))
    week = F.floor((F.col("ts") - F.col("t0")) / (7 * C.DAY_MS)) + 1
    return events.crossJoin(F.broadcast(first)).groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("count"))


def traffic(events: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """Per tumbling window: events by type, distinct sessions and items (exact), and rates; ``total_sessions`` repeats ``unique_sessions``."""
    start = F.expr(f"ts div {width_ms} * {width_ms}")
    sums = events.groupBy(start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("total_events"), *(count_type(t).alias(f"total_{t}") for t in C.EVENT_TYPES), F.count_distinct("session").alias("unique_sessions"), F.count_distinct("aid").alias("unique_items")
    )
    clicks, carts, orders = (F.col(f"total_{t}") for t in C.EVENT_TYPES)
    return sums.withColumns({"window_end": F.col("window_start") + width_ms, "total_sessions": F.col("unique_sessions"), "click_to_cart_rate": rate(carts, clicks), "cart_to_order_rate": rate(orders, carts)})
