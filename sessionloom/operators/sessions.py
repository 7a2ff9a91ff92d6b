"""Aggregations over sessions: funnels, segments, features, lengths, filters, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.functions.normalize import rate
from sessionloom.operators.ordered import quantiles, running


def is_type(kind: str) -> Column:
    return F.col("type") == kind


def count_type(kind: str) -> Column:
    return F.count_if(is_type(kind)).cast("long")


def session_flags(events: DataFrame, *keys: str) -> DataFrame:
    """Per session: length, and 0/1 for each event type."""
    flags = [F.max(is_type(t).cast("int")).alias(f"has_{t}") for t in C.EVENT_TYPES]
    return events.groupBy("session", *keys).agg(F.count(F.lit(1)).alias("length"), *flags)


def funnel(events: DataFrame, label: str | None = None) -> DataFrame:
    """Sessions that reach each step, and the rates between steps, 0 where there is no base."""
    sums = session_flags(events).agg(F.count(F.lit(1)).alias("total_sessions"), *(F.coalesce(F.sum(f"has_{t}"), F.lit(0)).cast("long").alias(f"sessions_with_{t}") for t in C.EVENT_TYPES))
    clicks, carts, orders = (F.col(f"sessions_with_{t}") for t in C.EVENT_TYPES)
    rated = sums.withColumns({"click_to_cart_rate": rate(carts, clicks), "cart_to_order_rate": rate(orders, carts), "click_to_order_rate": rate(orders, clicks)})
    return rated if label is None else rated.withColumn("model_used", F.lit(label))


def segment(has_order: Column, has_cart: Column) -> Column:
    """A buyer has an order; else who has a cart abandoned it; else only browsed."""
    return F.when(has_order > 0, "buyer").when(has_cart > 0, "cart_abandoner").otherwise("browse_only")


def segments(events: DataFrame) -> DataFrame:
    """Per segment: sessions, mean length, share of all sessions in per cent."""
    named = session_flags(events).withColumn("session_type", segment(F.col("has_orders"), F.col("has_carts")))
    sums = named.groupBy("session_type").agg(F.count(F.lit(1)).alias("count"), F.avg("length").alias("avg_length"))
    return sums.withColumn("pct_of_total", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def segment_durations(events: DataFrame) -> DataFrame:
    """As segments, with the mean duration in seconds."""
    each = events.groupBy("session").agg(F.count(F.lit(1)).alias("length"), F.max(is_type(C.ORDER).cast("int")).alias("o"), F.max(is_type(C.CART).cast("int")).alias("c"), ((F.max("ts") - F.min("ts")) / 1000.0).alias("seconds"))
    sums = each.withColumn("session_type", segment(F.col("o"), F.col("c"))).groupBy("session_type").agg(F.count(F.lit(1)).alias("count"), F.avg("length").alias("avg_length"), F.avg("seconds").alias("avg_duration_sec"))
    return sums.withColumn("pct_of_total", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def model_funnel(events: DataFrame, exact: bool = True) -> DataFrame:
    """Sessions by step for each model_used; ``exact=False`` counts with a sketch, for streams."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    steps = [distinct(F.when(is_type(t), F.col("session"))).alias(f"sessions_with_{t}") for t in C.EVENT_TYPES]
    sums = events.groupBy("model_used").agg(distinct("session").alias("total_sessions"), *steps)
    return sums.withColumn("click_to_order_rate", rate(F.col("sessions_with_orders"), F.col("sessions_with_clicks")))


def session_features(events: DataFrame) -> DataFrame:
    """Length, distinct items, end, duration in seconds, counts by type, and cart and order shares of length + 1."""
    sums = events.groupBy("session").agg(
        F.count(F.lit(1)).alias("session_length"), F.count_distinct("aid").alias("unique_aids"), F.max("ts").alias("session_end_ts"), F.expr("(max(ts) - min(ts)) div 1000").alias("duration_sec"),
        *(count_type(t).alias(f"n_{t}") for t in C.EVENT_TYPES),
    )
    return sums.withColumns({f"{t[:-1]}_ratio": F.col(f"n_{t}") / (F.col("session_length") + 1) for t in (C.CART, C.ORDER)})


def interaction_features(events: DataFrame) -> DataFrame:
    """Per session and item: repetitions, first and last time."""
    return events.groupBy("session", "aid").agg(F.count(F.lit(1)).alias("repetitions"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"))


def last_items(events: DataFrame) -> DataFrame:
    """Each session's last item by time; of equal times the greatest item."""
    return events.groupBy("session").agg(F.max_by("aid", F.struct("ts", "aid")).alias("last_aid"), F.max("ts").alias("last_ts"))


def interarrival(events: DataFrame) -> DataFrame:
    """Seconds since the event before in the session, null for the first."""
    order = Window.partitionBy("session").orderBy("ts", "aid", "type")
    return events.withColumn("gap_sec", (F.col("ts") - F.lag("ts").over(order)) / 1000.0)


def human_sessions(events: DataFrame) -> DataFrame:
    """Events of sessions whose rate, duration and number of actions look human."""
    low, high = C.HUMAN_SECONDS
    least, most = C.HUMAN_ACTIONS
    sums = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts") - F.min("ts")) / 1000.0).alias("seconds"))
    good = sums.filter((F.col("n") / (F.col("seconds") + C.HUMAN_DURATION_SHIFT) <= C.HUMAN_MAX_RATE) & F.col("seconds").between(low, high) & F.col("n").between(least, most))
    return events.join(good.select("session"), "session", "left_semi")


def long_sessions(events: DataFrame, above: int = 5) -> DataFrame:
    """Events of sessions longer than ``above``, or of any length with an order."""
    good = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.bool_or(is_type(C.ORDER)).alias("bought")).filter((F.col("n") > above) | F.col("bought"))
    return events.join(good.select("session"), "session", "left_semi")


def least_length(events: DataFrame, least: int = 2) -> DataFrame:
    """Events of sessions of ``least`` events or more, by a counting window."""
    return events.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session"))).filter(F.col("n") >= least).drop("n")


def purchase_sessions(events: DataFrame, last_is_order: bool = False) -> DataFrame:
    """Sessions of more than one event that have an order, or end in one."""
    test = (F.max_by("type", F.struct("ts", "aid", "type")) == C.ORDER) if last_is_order else F.bool_or(is_type(C.ORDER))
    good = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), test.alias("good")).filter("n > 1 and good")
    return good.select("session", F.col("n").alias("length"))


def known_sessions(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events of sessions all of whose items are in ``items``."""
    unknown = events.join(items.select("aid").distinct(), "aid", "left_anti").select("session").distinct()
    return events.join(unknown, "session", "left_anti")


def lifespans(events: DataFrame, week_zero: Column) -> DataFrame:
    """Per session: first and last week from a start, whether it ordered, orders, and the last event's type."""
    week = F.floor((F.col("ts") - week_zero) / (7 * C.DAY_MS)) + 1
    return events.groupBy("session").agg(F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.bool_or(is_type(C.ORDER)).alias("ordered"), count_type(C.ORDER).alias("n_orders"), F.max_by("type", F.struct("ts", "aid", "type")).alias("last_type"))


def length_histogram(events: DataFrame) -> DataFrame:
    """Sessions by length: 1 to 5, 6-10, 11-20, 21+."""
    n = F.col("n")
    label = F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")
    sized = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return sized.groupBy(label.alias("length")).agg(F.count(F.lit(1)).alias("sessions"))


def length_stats(events: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and quantiles of events a session."""
    sized = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    quantiles = [F.expr(f"percentile(n, {q})").alias(f"p{int(100 * q)}") for q in (0.5, 0.75, 0.9, 0.95)]
    return sized.agg(F.count(F.lit(1)).alias("sessions"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), *quantiles)


def duration_buckets(events: DataFrame) -> DataFrame:
    """Sessions by duration: below a minute, an hour, a day, a week, or more; with length statistics, ordered by a number."""
    edges = ((60, "under_minute"), (3600, "under_hour"), (86400, "under_day"), (604800, "under_week"))
    each = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts") - F.min("ts")) / 1000.0).alias("seconds"))
    place, name = F.lit(len(edges)), F.lit("week_or_more")
    for k, (top, label) in reversed(list(enumerate(edges))):
        place, name = F.when(F.col("seconds") < top, k).otherwise(place), F.when(F.col("seconds") < top, label).otherwise(name)
    sums = each.groupBy(place.alias("place"), name.alias("bucket")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.avg("n").alias("mean_length"), F.expr("percentile(n, 0.5)").alias("median_length")
    )
    return sums


def minutes_stats(events: DataFrame) -> DataFrame:
    """Extremes, mean and median of session length and duration in minutes."""
    each = events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts") - F.min("ts")) / 60000.0).alias("m"))
    columns = [f(c).alias(f"{f.__name__}_{name}") for c, name in (("n", "length"), ("m", "minutes")) for f in (F.max, F.min, F.avg)]
    # lengths have few distinct values, minutes as many as sessions
    sums = each.agg(*columns, F.expr("percentile(n, 0.5)").alias("median_length"))
    return sums.withColumn("median_minutes", F.lit(quantiles(each, "m", (0.5,))[0]).cast("double"))


def short_sessions(events: DataFrame, below: int = 5) -> DataFrame:
    """Share of sessions below a length in per cent, and how many of them have orders or carts."""
    flags = session_flags(events)
    short = F.col("length") < below
    return flags.agg((100.0 * F.avg(short.cast("double"))).alias("short_pct"), F.count_if(short).alias("short_sessions"), F.count_if(short & (F.col("has_orders") > 0)).alias("short_with_orders"), F.count_if(short & (F.col("has_carts") > 0)).alias("short_with_carts"))


def bot_sessions(events: DataFrame, minute: Column | None = None) -> DataFrame:
    """Sessions with a minute whose number of events is over mean + 3 deviations of all session-minutes: one row each, for its fullest (then earliest) minute.

    Under ten session-minutes, or without deviation, there are none. ``details`` is JSON, its numbers of two decimals.
    """
    minute = F.floor(F.col("ts") / 60000) * 60000 if minute is None else minute
    counts = events.groupBy(minute.alias("minute"), "session").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.count(F.lit(1)).alias("groups"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))
    # one row of statistics, whatever the input
    over = counts.crossJoin(F.broadcast(stats)).filter((F.col("groups") >= C.BOT_LEAST_GROUPS) & (F.col("std") > 0) & (F.col("n") > F.col("mean") + C.BOT_Z * F.col("std")))
    most = over.groupBy("session").agg(F.max_by(F.struct("minute", "n", "mean", "std"), F.struct(F.col("n"), -F.col("minute"))).alias("m")).select("session", "m.*")
    details = F.to_json(F.struct(F.col("n").alias("event_count_per_min"), F.round("mean", 2).alias("batch_mean"), F.round("std", 2).alias("batch_std"), F.lit(C.BOT_Z).alias("z_threshold")))
    return most.select(F.col("session").alias("session_id"), F.lit("bot_like").alias("anomaly_type"), F.col("minute"), F.col("n").alias("event_count"), F.round("mean", 2).alias("batch_mean"), F.round("std", 2).alias("batch_std"), details.alias("details"))


def session_offsets(events: DataFrame) -> DataFrame:
    """Where each session's events begin if all are laid out in session order: (session, length, offset)."""
    sizes = events.filter("session is not null").groupBy("session").agg(F.count(F.lit(1)).alias("length"))
    return running(sizes, "session", "length", "offset")


def sessions_by_start(events: DataFrame) -> DataFrame:
    """Sessions with their place, from 0, in order of their first event, ties to the smaller session: (session, start_ts, place)."""
    starts = events.filter("session is not null").groupBy("session").agg(F.min("ts").alias("start_ts")).withColumn("one", F.lit(1).cast("long"))
    before = running(starts.groupBy("start_ts").agg(F.sum("one").alias("n")), "start_ts", "n").select("start_ts", "before")
    inside = running(starts, "session", "one", "nth", ("start_ts",))
    return inside.join(before, "start_ts").select("session", "start_ts", (F.col("before") + F.col("nth")).alias("place"))


def joined_parts(*parts: DataFrame) -> DataFrame:
    """Events of several parts as one table, sorted by session, item and time, named for sequence toolkits; the time is a float of seconds * 1e9 if seconds came in."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    named = union.select(F.col("session").alias("session:token"), F.col("aid").alias("aid:token"), (F.col("ts").cast("double") * 1e9).alias("ts:float"))
    return named.orderBy("session:token", "aid:token", "ts:float")


# ---- sequences


def sequences(events: DataFrame, shift: int = 1) -> DataFrame:
    """Per session the items (moved by ``shift``), types and times, in time order."""
    listed = events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("ts", "aid", "type"))).alias("e"))
    return listed.select("session", F.transform("e", lambda x: x["aid"] + shift).alias("items"), F.transform("e", lambda x: x["type"]).alias("types"), F.transform("e", lambda x: x["ts"]).alias("timestamps"))


def leave_one_out(seq: DataFrame) -> DataFrame:
    """Context and target of sessions of two events or more: the last item is the target."""
    head = lambda c: F.slice(c, 1, F.size(c) - 1)
    return seq.filter(F.size("items") >= 2).select("session", head("items").alias("context"), head("types").alias("context_types"), head("timestamps").alias("context_ts"), F.element_at("items", -1).alias("target"))


def padded(seq: DataFrame, length: int, column: str = "items") -> DataFrame:
    """The last ``length`` items, padded with 0 on the left, and a mask of what is real."""
    tail = F.slice(column, F.greatest(F.size(column) - length + 1, F.lit(1)), length)
    blank = F.array_repeat(F.lit(0).cast("long"), length - F.size("tail"))
    mask = F.concat(F.array_repeat(F.lit(0), length - F.size("tail")), F.array_repeat(F.lit(1), F.size("tail")))
    return seq.withColumn("tail", tail).withColumn("padded", F.concat(blank, "tail")).withColumn("mask", mask).drop("tail")


def shifted_labels(seq: DataFrame) -> DataFrame:
    """Inputs without the last item, labels without the first."""
    many = seq.filter(F.size("items") >= 2)
    return many.select("session", F.slice("items", 1, F.size("items") - 1).alias("inputs"), F.slice("items", 2, F.size("items") - 1).alias("labels"))


def last_out_split(seq: DataFrame) -> DataFrame:
    """Train, validation and test item of each sequence: from three items on the last two are held out, of two the last, of one none."""
    n = F.size("items")
    train = F.when(n >= 3, F.slice("items", 1, n - 2)).when(n == 2, F.slice("items", 1, 1)).otherwise(F.col("items"))
    return seq.select("session", train.alias("train"), F.when(n >= 3, F.try_element_at("items", F.lit(-2))).alias("valid"), F.when(n >= 2, F.try_element_at("items", F.lit(-1))).alias("test"))
