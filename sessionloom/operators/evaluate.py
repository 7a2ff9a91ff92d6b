"""Ranking quality. predictions: (session, rank from 1, aid); truth: (session, aid), repeats allowed where said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import constants as C


def discount(rank: Column) -> Column:
    return F.log(F.lit(2.0)) / F.log(rank.cast("double") + 1)


def ideal(n: Column) -> Column:
    """Discounted gain of n hits at the top."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + F.when(k <= n, discount(k)).otherwise(F.lit(0.0)))


def ranking_metrics(predictions: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """recall, mrr, ndcg at k for each session that has truth; 0 without hits. The ideal of ndcg counts repeats in the truth, recall does not."""
    sizes = truth.groupBy("session").agg(F.count(F.lit(1)).alias("n_all"), F.count_distinct("aid").alias("n_distinct"))
    hits = predictions.filter(F.col("rank") <= k).join(truth.select("session", "aid").distinct(), ["session", "aid"], "left_semi")
    sums = hits.groupBy("session").agg(F.count_distinct("aid").alias("hits"), F.min("rank").alias("first"), F.sum(discount(F.col("rank"))).alias("dcg"))
    joined = sizes.join(sums, "session", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("session", zero(F.col("hits") / F.col("n_distinct")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal(F.least(F.col("n_all"), F.lit(k)))).alias("ndcg"))


def mean_metrics(each: DataFrame) -> DataFrame:
    return each.agg(F.count(F.lit(1)).alias("sessions"), *(F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")))


def competition_recall(predictions: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """Per type: sum of hits over sum of min(size of the truth, k). predictions and truth also have ``type``."""
    distinct = truth.select("session", "type", "aid").distinct()
    sizes = distinct.groupBy("session", "type").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("most"))
    hits = predictions.filter(F.col("rank") <= k).select("session", "type", "aid").distinct().join(distinct, ["session", "type", "aid"], "left_semi").groupBy("session", "type").agg(F.count(F.lit(1)).alias("hits"))
    joined = sizes.join(hits, ["session", "type"], "left").na.fill(0, ["hits"])
    return joined.groupBy("type").agg(F.sum("hits").alias("hits"), F.sum("most").alias("possible"), (F.sum("hits") / F.sum("most")).alias("recall"))


def weighted_recall(by_type: DataFrame) -> DataFrame:
    weight = F.lit(0.0)
    for t, w in C.OBJECTIVE_WEIGHT.items():
        weight = F.when(F.col("type") == t, w).otherwise(weight)
    return by_type.agg(F.sum(weight * F.col("recall")).alias("weighted_recall"))


def hit_rate(predictions: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """Share of sessions with a hit among the first k, and mean ndcg with gain 2 ** relevance - 1. truth: (session, aid, relevance)."""
    hits = predictions.filter(F.col("rank") <= k).join(truth, ["session", "aid"]).groupBy("session").agg(F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) * discount(F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("session").orderBy(F.desc("relevance"), "aid")
    best = truth.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).groupBy("session").agg(F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) * discount(F.col("place"))).alias("idcg"))
    joined = best.join(hits, "session", "left")
    return joined.agg(F.count(F.lit(1)).alias("sessions"), F.avg(F.col("dcg").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)).alias("ndcg"))


def sampled_rank(scores: DataFrame, k: int = 10, ties: str = "standard") -> DataFrame:
    """Hit rate and ndcg by the target's rank among its negatives. scores: (session, score, is_target).

    standard counts greater scores only, conservative also equal ones, median half of the equal ones.
    """
    target = scores.filter("is_target = 1").groupBy("session").agg(F.max("score").alias("target_score"))
    others = scores.filter("is_target = 0").join(target, "session")
    counts = others.groupBy("session").agg(F.count_if(F.col("score") > F.col("target_score")).alias("above"), F.count_if(F.col("score") == F.col("target_score")).alias("equal"))
    place = {"standard": F.col("above"), "conservative": F.col("above") + F.col("equal"), "median": F.col("above") + F.col("equal") / 2}[ties]
    ranked = target.join(counts, "session", "left").na.fill(0, ["above", "equal"]).withColumn("rank", place + 1)
    hit = F.col("rank") <= k
    return ranked.agg(F.count(F.lit(1)).alias("sessions"), F.avg(hit.cast("double")).alias("hit_rate"), F.avg(F.when(hit, discount(F.col("rank"))).otherwise(0.0)).alias("ndcg"))


def online_hits(lists: DataFrame, events: DataFrame, k: int = 20) -> DataFrame:
    """Carts and orders held against the served lists: a hit is anywhere in clicks + carts + orders joined, recall and mrr look at the first k of that.

    lists: (session, clicks, carts, orders), arrays; the result has a row an event: session, aid, event_type, is_hit, recall, mrr, ndcg.
    """
    joined = lists.select("session", F.concat("clicks", "carts", "orders").alias("served"))
    return hits(events.filter(F.col("type").isin(C.CART, C.ORDER)).join(joined, "session"), k)


def hits(rows: DataFrame, k: int, *more: str) -> DataFrame:
    """Of events with the list ``served`` to their session: what ``online_hits`` gives, and the columns ``more``."""
    place = F.array_position(F.slice("served", 1, k), F.col("aid"))
    found = place > 0
    return rows.select(
        "session", "aid", F.col("type").alias("event_type"), *more, F.array_contains("served", F.col("aid")).alias("is_hit"),
        found.cast("double").alias("recall"), F.when(found, 1 / place).otherwise(0.0).alias("mrr"), F.when(found, discount(place)).otherwise(0.0).alias("ndcg"),
    )
