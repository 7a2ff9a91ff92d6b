"""Item-to-item co-visitation graphs.

The unified graph pairs neighbours at most five places apart by slicing each session's sorted tail, which needs no self-join; typed graphs
pair all events of a session's tail within a time distance; the exploratory graph has no tail and pairs whole sessions.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.functions.normalize import gap_bucket
from sessionloom.operators.items import top_by
from sessionloom.operators.ordered import running


def pair_bonus(a: Column, b: Column) -> Column:
    """Bonus of an unordered pair of event types."""
    out = F.lit(1)
    for (x, y), bonus in C.PAIR_BONUS.items():
        out = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), bonus).otherwise(out)
    return out


def tails(events: DataFrame, size: int = C.TAIL_SIZE) -> DataFrame:
    """Per session the last ``size`` events by (ts, aid, type), in time order, as one array.

    Spark limits each session's rows before the shuffle, so the longest session is no more than a short array.
    """
    latest = top_by(events.select("session", "ts", "aid", "type"), ["session"], [F.desc("ts"), F.desc("aid"), F.desc("type")], size, "_place")
    return latest.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("ts", "aid", "type"))).alias("e"))


def unified_pairs(events: DataFrame, gap_ms: int = C.DAY_MS, window: int = C.WINDOW_SIZE, tail: int = C.TAIL_SIZE) -> DataFrame:
    """Distinct (session, aid1 < aid2, type1, type2) of neighbours in the tail: other items, less than the gap apart. A type follows its item."""
    each = tails(events, tail).select("session", "e", F.posexplode("e").alias("at", "x"))
    near = each.select("session", "x", F.explode(F.slice("e", F.col("at") + 2, window)).alias("y"))
    near = near.filter((F.col("x.aid") != F.col("y.aid")) & (F.abs(F.col("x.ts") - F.col("y.ts")) < gap_ms))
    low, high = F.when(F.col("x.aid") < F.col("y.aid"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.aid") < F.col("y.aid"), F.col("y")).otherwise(F.col("x"))
    ordered = near.select("session", low.alias("l"), high.alias("h")).select("session", F.col("l.aid").alias("aid1"), F.col("h.aid").alias("aid2"), F.col("l.type").alias("type1"), F.col("h.type").alias("type2"))
    return ordered.distinct()


def unified_edges(events: DataFrame, k: int = C.TOP_K, gap_ms: int = C.DAY_MS, parts: int | None = None, **options) -> DataFrame:
    """(aid1, aid2, wgt, rank): the k strongest neighbours of each item, ties to the greater id.

    With ``parts`` pairs go both ways to so many parts by their first item, and are summed and ranked there.
    """
    pairs = unified_pairs(events, gap_ms, **options)
    if parts is not None:
        bonus = pair_bonus(F.col("type1"), F.col("type2")).alias("bonus")
        ways = F.explode(F.array(F.struct(F.col("aid1").alias("aid1"), F.col("aid2").alias("aid2")), F.struct(F.col("aid2").alias("aid1"), F.col("aid1").alias("aid2"))))
        dealt = pairs.select(ways.alias("x"), bonus).select("x.*", "bonus").repartition(parts, "aid1")
        return top_by(dealt.groupBy("aid1", "aid2").agg(F.sum("bonus").cast("long").alias("wgt")), ["aid1"], [F.desc("wgt"), F.desc("aid2")], k)
    sums = pairs.groupBy("aid1", "aid2").agg(F.sum(pair_bonus(F.col("type1"), F.col("type2"))).cast("long").alias("wgt"))
    both = sums.unionByName(sums.select(F.col("aid2").alias("aid1"), F.col("aid1").alias("aid2"), "wgt"))
    return top_by(both, ["aid1"], [F.desc("wgt"), F.desc("aid2")], k)


def adjacency(edges: DataFrame) -> DataFrame:
    """(aid, candidates): neighbours as an array of (aid2, wgt), strongest first."""
    listed = edges.groupBy(F.col("aid1").alias("aid")).agg(F.sort_array(F.collect_list(F.struct("wgt", "aid2")), asc=False).alias("c"))
    return listed.select("aid", F.transform("c", lambda x: F.struct(x["aid2"].alias("aid2"), x["wgt"].cast("double").alias("wgt"))).alias("candidates"))


def tail_pairs(events: DataFrame, gap_ms: int, tail: int = C.TAIL_SIZE) -> DataFrame:
    """Ordered pairs (x, y) of other items in a session's tail less than the gap apart; of repeats the pair of greatest (ts, ts_y, type_y)."""
    last = tails(events, tail)
    x = last.select("session", "e", F.explode("e").alias("x"))
    pairs = x.select("session", "x", F.explode("e").alias("y")).filter((F.col("x.aid") != F.col("y.aid")) & (F.abs(F.col("x.ts") - F.col("y.ts")) < gap_ms))
    flat = pairs.select("session", F.col("x.aid").alias("aid"), F.col("y.aid").alias("candidate_aid"), F.struct(F.col("x.ts").alias("ts"), F.col("y.ts").alias("ts_y"), F.col("y.type").alias("type_y")).alias("p"))
    return flat.groupBy("session", "aid", "candidate_aid").agg(F.max("p").alias("p")).select("session", "aid", "candidate_aid", "p.*")


def typed_edges(events: DataFrame, kind: str, k: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """(aid, candidate_aid, wgt, rank from 0) of one of the three graphs: ``clicks``, ``cart_order``, ``buy2buy``.

    Clicks weigh 1 to 4 by how late in the data they are; cart_order weighs by the type of the candidate; buy2buy counts carts and orders.
    """
    options = C.TYPED[kind]
    rows = events.filter(F.col("type").isin(C.CART, C.ORDER)) if kind == "buy2buy" else events
    pairs = tail_pairs(rows, options["gap_ms"] if gap_ms is None else gap_ms)
    if kind == "clicks":
        span = pairs.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
        pairs = pairs.crossJoin(F.broadcast(span)).withColumn("w", 1.0 + 3.0 * (F.col("ts") - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)))
    elif kind == "cart_order":
        weight = F.lit(0.0)
        for t, w in C.CART_ORDER_WEIGHT.items():
            weight = F.when(F.col("type_y") == t, float(w)).otherwise(weight)
        pairs = pairs.withColumn("w", weight)
    else:
        pairs = pairs.withColumn("w", F.lit(1.0))
    # sums of whole billionths do not depend on the order of addition, so ranks agree between runs
    sums = pairs.groupBy("aid", "candidate_aid").agg((F.sum(F.round(F.col("w") * 1e9).cast("long")) / F.lit(1e9)).alias("wgt"))
    ranked = top_by(sums, ["aid"], [F.desc("wgt"), F.asc("candidate_aid")], options["k"] if k is None else k)
    return ranked.withColumn("rank", F.col("rank") - 1)


def explore_edges(events: DataFrame, gap_ms: int = C.DAY_MS, above: float = 1.0, limit: int = 1024) -> DataFrame:
    """(aid1, aid2, score): sums over whole sessions of the later item's type weight, those above a score.

    Events meet by session and stretch of time as long as the gap, with the stretches before and after: a long session is many keys.
    Sessions with a stretch of more than ``limit`` events take another way to the same sums (``_crowded_sums``), whose keys stay small.
    Events without a session, item or time are in no pair; an unknown type weighs nothing.
    """
    weight = F.lit(0)
    for t, w in C.EXPLORE_WEIGHT.items():
        weight = F.when(F.col("type") == t, w).otherwise(weight)
    offset = F.pmod(F.col("ts"), F.lit(gap_ms)).cast("long")
    rows = events.filter(F.col("session").isNotNull() & F.col("aid").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("session", "aid", (F.col("ts") - offset).alias("at"), offset.alias("offset"), weight.alias("weight"))
    crowded = rows.groupBy("session", "at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("session").distinct()
    few, many = _told_apart(rows, crowded)
    sums = _near_sums(few, gap_ms).unionByName(_crowded_sums(many, gap_ms, limit))
    return sums.groupBy("aid1", "aid2").agg(F.sum("score").cast("long").alias("score")).filter(F.col("score") > above)


def _told_apart(rows: DataFrame, crowded: DataFrame, deals: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows of other sessions, and of crowded ones. Where the crowded are too many for Spark to broadcast, rows of one are dealt to tasks."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("aid", "at", "offset"), F.lit(deals)).cast("int"))
    keys = crowded.withColumn("deal", F.explode(F.array(*[F.lit(k) for k in range(deals)])))
    return tuple(dealt.join(keys, ["session", "deal"], how).drop("deal") for how in ("left_anti", "left_semi"))


def _near_sums(rows: DataFrame, gap_ms: int) -> DataFrame:
    """(aid1, aid2, score) of pairs of events less than the gap apart, one by one."""
    near = F.explode(F.array(F.col("at") - gap_ms, F.col("at"), F.col("at") + gap_ms))
    a = rows.select("session", F.col("aid").alias("aid1"), (F.col("at") + F.col("offset")).alias("ts1"), near.alias("at"))
    b = rows.select("session", "at", F.col("aid").alias("aid2"), (F.col("at") + F.col("offset")).alias("ts2"), "weight")
    pairs = a.join(b, ["session", "at"]).filter((F.col("aid1") != F.col("aid2")) & (F.abs(F.col("ts1") - F.col("ts2")) < gap_ms))
    return pairs.groupBy("aid1", "aid2").agg(F.sum("weight").alias("score"))


def _crowded_sums(rows: DataFrame, gap_ms: int, limit: int) -> DataFrame:
    """The same sums by items of cells, whose events need not be compared.

    Two events of one stretch are always near. Of two stretches in a row, an event of the second is near those of the first with a greater
    offset: for each such pair there is one level at which their offsets begin with the same bits and go on with 0 in the second, 1 in the
    first. So each event is in one cell a level (27 for a day), as an earlier or a later one, and every earlier event of a cell is near
    every later one. Cells keep a count and a weight of each item; cells of many items are dealt as pairs of slices of about ``limit`` items.
    """
    cell = ["session", "at", "level", "prefix"]
    # events of an item at one time are in the same cells: they go there as one row
    rows = rows.groupBy("session", "at", "offset", "aid").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    # level -1 is the stretch itself, where each event is on both sides
    entries = rows.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(-2, (gap_ms - 1).bit_length())])))
    early = F.when(F.col("step") < 0, F.col("step") == -1).otherwise(F.expr("shiftright(offset, step) & 1 = 1"))
    entries = entries.withColumn("early", early).withColumn("level", F.greatest("step", F.lit(-1)))
    entries = entries.withColumn("prefix", F.when(F.col("step") < 0, 0).otherwise(F.expr("shiftright(offset, step + 1)")))
    entries = entries.withColumn("at", F.when((F.col("step") >= 0) & ~F.col("early"), F.col("at") - gap_ms).otherwise(F.col("at")))
    items = entries.groupBy(*cell, "early", "aid").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    slices = lambda side: F.ceil(F.count_if(side) / limit).cast("int")
    cells = items.groupBy(*cell).agg(slices(F.col("early")).alias("early_slices"), slices(~F.col("early")).alias("late_slices"))
    dealt = items.join(cells.filter("early_slices > 0 AND late_slices > 0"), cell)

    def side(early: bool, x: str, own: str, other: str) -> DataFrame:
        own_slices, other_slices = F.col(f"{own}_slices"), F.col(f"{other}_slices")
        named = dealt.filter(F.col("early") == early).select(
            *cell, F.pmod(F.xxhash64("aid"), own_slices).alias(f"{own}_slice"), F.explode(F.sequence(F.lit(0), other_slices - 1)).alias(f"{other}_slice"),
            F.col("aid").alias(f"aid_{x}"), F.col("n").alias(f"n_{x}"), F.col("weight").alias(f"weight_{x}"))
        return named.withColumn("early_slice", F.col("early_slice").cast("int")).withColumn("late_slice", F.col("late_slice").cast("int"))

    met = side(True, "e", "early", "late").join(side(False, "l", "late", "early").hint("shuffle_merge"), [*cell, "early_slice", "late_slice"])
    met = met.filter(F.when(F.col("level") < 0, F.col("aid_e") < F.col("aid_l")).otherwise(F.col("aid_e") != F.col("aid_l")))
    one_way = lambda x, y: F.struct(F.col(f"aid_{x}").alias("aid1"), F.col(f"aid_{y}").alias("aid2"), (F.col(f"n_{x}") * F.col(f"weight_{y}")).alias("score"))
    both = met.select(F.explode(F.array(one_way("e", "l"), one_way("l", "e"))).alias("p")).select("p.*")
    return both.groupBy("aid1", "aid2").agg(F.sum("score").alias("score"))


def gap_pairs(events: DataFrame, tail: int = C.TAIL_SIZE) -> DataFrame:
    """Ordered pairs of tail events by both types and the bucket of the time between them."""
    x = tails(events, tail).select("e", F.posexplode("e").alias("at", "x"))
    pairs = x.select("x", F.explode(F.slice("e", F.col("at") + 2, tail)).alias("y"))
    seconds = (F.col("y.ts") - F.col("x.ts")) / 1000.0
    return pairs.groupBy(F.col("x.type").alias("type1"), F.col("y.type").alias("type2"), gap_bucket(seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))


def bipartite_edges(events: DataFrame) -> DataFrame:
    """(src, dst, weight) both ways between dense session and item numbers, items after sessions; weight is the strongest type's.

    Numbers follow id order. They come from sorted distinct ids by ranges, so no table is sorted in one task. Edges are made once; all ids come from them.
    """
    weight = F.lit(0)
    for t, w in C.GRAPH_WEIGHT.items():
        weight = F.when(F.col("type") == t, w).otherwise(weight)
    edges = events.groupBy("session", "aid").agg(F.max(weight).alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    sessions, items = dense_ids(edges, "session"), dense_ids(edges, "aid")
    n = sessions.agg(F.count(F.lit(1)).alias("n_sessions"))
    joined = edges.join(sessions.withColumnRenamed("dense", "s"), "session").join(items.withColumnRenamed("dense", "i"), "aid").crossJoin(F.broadcast(n)).withColumn("i", F.col("i") + F.col("n_sessions"))
    return joined.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("i").alias("dst"), "weight"), F.struct(F.col("i").alias("src"), F.col("s").alias("dst"), "weight"))).alias("x")).select("x.*")


def dense_ids(rows: DataFrame, column: str) -> DataFrame:
    """Distinct ids with their place in id order, from 0."""
    ids = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("one", F.lit(1).cast("long"))
    return running(ids, column, "one", "dense").select(column, F.col("dense").cast("long").alias("dense"))
