"""Train and validation splits by time, and labels from what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.operators.sessions import is_type


def _with_top(events: DataFrame, *aggregates: Column) -> DataFrame:
    """Each event with one row of statistics of all."""
    return events.crossJoin(F.broadcast(events.agg(*aggregates)))


def future_ranges(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, lists): what follows each event, as ranges into one list a session and type.

    lists: (session, carts, orders), each type's distinct items by their last occurrence. marks: every event but a session's last, with place, next_click,
    carts_from and orders_from. An item comes after an event if its last occurrence does, so the later carts of an event are the session's
    carts from place carts_from (counted from 0) to the end. A session's state grows with its events, not with their square.
    """
    placed = events.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("ts", "aid", "type")))
    session, same = Window.partitionBy("session"), Window.partitionBy("session", "type", "aid").orderBy("place")
    before = session.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the nearest click that follows is the last one before, counted from the end
    after = session.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("ends", F.lead("place").over(same).isNull())
    ended = lambda t: F.sum((F.col("ends") & is_type(t)).cast("int")).over(before)
    rows = rows.withColumns({"carts_from": ended(C.CART), "orders_from": ended(C.ORDER), "next_click": F.last(F.when(is_type(C.CLICK), F.col("aid")), ignorenulls=True).over(after)})
    marks = rows.withColumn("follows", F.lead("place").over(session.orderBy("place"))).filter("follows is not null").drop("ends", "follows")
    listed = lambda t: F.transform(F.array_sort(F.collect_list(F.when(is_type(t), F.struct("place", "aid")))), lambda x: x["aid"])
    last = rows.filter(F.col("ends") & F.col("type").isin(C.CART, C.ORDER))
    return marks, last.groupBy("session").agg(listed(C.CART).alias("carts"), listed(C.ORDER).alias("orders"))


def future_labels(events: DataFrame) -> DataFrame:
    """For every event but a session's last: the next click, and the sets of later carts and orders (ascending); the ranges of ``future_ranges`` written out."""
    marks, lists = future_ranges(events)

    def later(items: str, begin: str) -> Column:
        return F.array_sort(F.slice(items, F.col(begin) + 1, F.greatest(F.size(items) - F.col(begin), F.lit(0))))

    sets = {"later_carts": later("carts", "carts_from"), "later_orders": later("orders", "orders_from")}
    nothing = F.array().cast("array<long>")
    both = marks.join(lists, "session", "left").withColumns({c: F.coalesce(c, nothing) for c in ("carts", "orders")})
    return both.withColumns(sets).select(*events.columns, "next_click", *sets)


def history_split(events: DataFrame, label_ms: int = C.DAY_MS, history_days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(history, future): a session's last day is the future; history begins at most so many days before the latest event of all."""
    cut = events.withColumn("cutoff", F.max("ts").over(Window.partitionBy("session")) - label_ms)
    top = _with_top(cut, F.max("ts").alias("top"))
    history = top.filter((F.col("ts") <= F.col("cutoff")) & (F.col("ts") >= F.col("top") - history_days * C.DAY_MS)).drop("cutoff", "top")
    return history, cut.filter(F.col("ts") > F.col("cutoff")).drop("cutoff")


def ground_truth(future: DataFrame) -> DataFrame:
    """Per session and type, the distinct items that come."""
    return future.groupBy("session", "type").agg(F.array_sort(F.collect_set("aid")).alias("ground_truth"))


def temporal_split(events: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test): sessions that begin by the split (``days`` before the last event) keep their events before it; later sessions keep the items that train knows. Both need two events.

    A session may begin at the split itself and is then a training session without events, so it goes.
    """
    marked = _with_top(events.withColumn("first_ts", F.min("ts").over(Window.partitionBy("session"))), F.max("ts").alias("top")).withColumn("split", F.col("top") - days * C.DAY_MS)
    train = _two_or_more(marked.filter((F.col("first_ts") <= F.col("split")) & (F.col("ts") < F.col("split"))).select(*events.columns))
    late = marked.filter(F.col("first_ts") > F.col("split")).select(*events.columns)
    test = _two_or_more(late.join(train.select("aid").distinct(), "aid", "left_semi").select(*events.columns))
    return train, test


def _two_or_more(events: DataFrame) -> DataFrame:
    good = events.groupBy("session").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("session")
    return events.join(good, "session", "left_semi")


def truncated(events: DataFrame, seed: int | None = 42) -> DataFrame:
    """Each session's prefix and the labels after it; the prefix length is a hash of the session (or, without a seed, session modulo events) plus one, below the session's length.

    Sessions whose labels are all empty go.
    """
    order = Window.partitionBy("session").orderBy("ts", "aid", "type")
    whole = Window.partitionBy("session")
    rows = events.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    base = F.col("session") if seed is None else F.xxhash64("session", F.lit(seed))
    rows = rows.withColumn("prefix", F.pmod(base, F.col("n") - 1) + 1 if seed is None else F.pmod(base, F.greatest(F.col("n") - 1, F.lit(1))) + 1)
    rows = rows.filter("n >= 2") if seed is not None else rows.filter("n >= 2")
    ahead = rows.filter("place > prefix")
    labels = ahead.groupBy("session").agg(
        F.min_by("aid", F.when(is_type(C.CLICK), F.col("place"))).alias("next_click"),
        F.array_sort(F.collect_set(F.when(is_type(C.CART), F.col("aid")))).alias("carts"), F.array_sort(F.collect_set(F.when(is_type(C.ORDER), F.col("aid")))).alias("orders"),
    )
    heads = rows.filter("place <= prefix").groupBy("session").agg(F.count(F.lit(1)).alias("prefix_length"))
    return heads.join(labels, "session").filter("next_click is not null or size(carts) > 0 or size(orders) > 0")


def week_scenarios(events: DataFrame, split_day: int = 21) -> DataFrame:
    """Per session: scenario 1 wholly before the split day (counted from the first event), 2 on both sides, 3 wholly from it on; events and orders on each side, and whether it ends in an order."""
    marked = _with_top(events, F.min("ts").alias("t0")).withColumn("late", F.col("ts") >= F.col("t0") + split_day * C.DAY_MS)
    sums = marked.groupBy("session").agg(
        F.bool_or("late").alias("any_late"), F.bool_and("late").alias("all_late"), F.count_if(~F.col("late")).alias("events_before"), F.count_if("late").alias("events_after"),
        F.count_if(~F.col("late") & is_type(C.ORDER)).alias("orders_before"), F.count_if(F.col("late") & is_type(C.ORDER)).alias("orders_after"), F.max_by("type", F.struct("ts", "aid", "type")).alias("last_type"),
    )
    return sums.withColumn("scenario", F.when(F.col("all_late"), 3).when(F.col("any_late"), 2).otherwise(1)).drop("any_late", "all_late")


def scenario_summary(sessions: DataFrame) -> DataFrame:
    """Per scenario: sessions, per cent, with orders before and after, with more events before than after, ending in an order."""
    sums = sessions.groupBy("scenario").agg(F.count(F.lit(1)).alias("sessions"), F.count_if((F.col("orders_before") > 0) & (F.col("orders_after") > 0)).alias("orders_both"), F.count_if(F.col("events_before") > F.col("events_after")).alias("mostly_before"), F.count_if(F.col("last_type") == C.ORDER).alias("end_in_order"))
    return sums.withColumn("pct", 100.0 * F.col("sessions") / F.sum("sessions").over(Window.partitionBy()))


def week_split(events: DataFrame, split_day: int = 21) -> tuple[DataFrame, DataFrame]:
    """(train, validation): events before the split day of sessions that begin before it; sessions wholly after it."""
    named = week_scenarios(events, split_day).select("session", "scenario")
    marked = _with_top(events, F.min("ts").alias("t0")).join(named, "session")
    train = marked.filter((F.col("scenario") < 3) & (F.col("ts") < F.col("t0") + split_day * C.DAY_MS))
    return train.select(*events.columns), marked.filter("scenario = 3").select(*events.columns)


def within_session_split(events: DataFrame, share: float = 0.8) -> DataFrame:
    """Events with ``is_train``: up to so large a part of the session's time."""
    w = Window.partitionBy("session")
    low, high = F.min("ts").over(w), F.max("ts").over(w)
    return events.withColumn("is_train", F.col("ts") <= low + share * (high - low))


def split_checks(train: DataFrame, test: DataFrame) -> DataFrame:
    """Six invariants of a temporal split as rows (check, passed)."""
    shared = train.select("session").intersect(test.select("session")).agg(F.count(F.lit(1)).alias("n"))
    strange = test.select("aid").distinct().join(train.select("aid").distinct(), "aid", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    short = lambda d: d.groupBy("session").agg(F.count(F.lit(1)).alias("c")).filter("c < 2").agg(F.count(F.lit(1)).alias("n"))
    nulls = train.unionByName(test).filter("session is null or aid is null or ts is null or type is null").agg(F.count(F.lit(1)).alias("n"))
    order = train.agg(F.max("ts").alias("a")).crossJoin(test.agg(F.min("ts").alias("b"))).select(F.coalesce((F.col("a") > F.col("b")).cast("long"), F.lit(0)).alias("n"))
    checks = (("no shared sessions", shared), ("test items known", strange), ("train sessions have two events", short(train)), ("test sessions have two events", short(test)), ("no nulls", nulls), ("train ends before test", order))
    out = None
    for name, counted in checks:
        row = counted.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out
