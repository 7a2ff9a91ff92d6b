"""LambdaRank: a linear ranker fitted to pairs of a session's candidates, each weighted by what swapping the two would change of NDCG@k.

A pair is a hit and a miss of one session of which one at least stands among the session's first k under the present weights; any other swap
leaves NDCG@k as it is. So a session of n candidates has at most 2 k n pairs, however many of them are hits. Sessions are packed once: a
row holds up to ``PIECE`` candidates. In each round tasks sum gradients and curvatures of the pairs in their rows, Spark adds the sums, and the
driver, which holds nothing but the weights, takes a Newton step. A session of more rows has them spread over tasks: its first k are found over all of
them, and every piece meets these k alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.sources.folders import shared_folder

#: Candidates of a session that one task takes together.
PIECE = 8192
#: Pairs worked on at once.
MOST_PAIRS = 1 << 17
PACKED = "session, piece, pieces, hits, rows"


@dataclass
class Sums:
    """Over pairs: gradient and curvature of the log likelihood that hits go before misses; over sessions: NDCG@k and their number."""

    gradient: np.ndarray
    curvature: np.ndarray
    ndcg: float = 0.0
    sessions: int = 0

    @classmethod
    def none(cls, width: int) -> Sums:
        return cls(np.zeros(width), np.zeros((width, width)))

    def add_pairs(self, x: np.ndarray, s: np.ndarray, hit: np.ndarray, miss: np.ndarray, weight: np.ndarray) -> None:
        """Pairs of rows of x, whose scores are s."""
        wrong = 1 / (1 + np.exp(np.clip(s[hit] - s[miss], -500, 500)))
        pull, bend = weight * wrong, weight * wrong * (1 - wrong)
        n = len(x)
        self.gradient += (np.bincount(hit, pull, n) - np.bincount(miss, pull, n)) @ x
        cross = x[hit].T @ (bend[:, None] * x[miss])
        self.curvature += (x.T * (np.bincount(hit, bend, n) + np.bincount(miss, bend, n))) @ x - cross - cross.T

    def rows(self) -> pa.RecordBatch:
        values = np.concatenate([[self.ndcg, self.sessions], self.gradient, self.curvature.ravel()])
        return pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(values)), pa.int32()), "value": pa.array(values)})


def discounts(k: int) -> np.ndarray:
    return 1 / np.log2(np.arange(k) + 2)


def ideal(hits: np.ndarray, k: int) -> np.ndarray:
    """DCG@k of as many hits, all in front."""
    return np.concatenate([[0.0], np.cumsum(discounts(k))])[np.minimum(hits, k)]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then begin[1], ..."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def add_sessions(sums: Sums, session: np.ndarray, item: np.ndarray, label: np.ndarray, x: np.ndarray, weights: np.ndarray, k: int) -> None:
    """Whole sessions, numbered 0, 1, ..., to the sums."""
    s = x @ weights
    order = np.lexsort((item, -s, session))
    session, label, x, s = session[order], label[order].astype(bool), x[order], s[order]
    n = int(session[-1]) + 1 if len(session) else 0
    count = np.bincount(session, minlength=n)
    rank = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    discount = np.where(rank < k, 1 / np.log2(rank + 2), 0.0)
    best = ideal(np.bincount(session[label], minlength=n), k)
    sums.ndcg += float((np.bincount(session[label], discount[label], n) / np.where(best > 0, best, 1)).sum())
    sums.sessions += int((best > 0).sum())
    hit, miss = np.flatnonzero(label), np.flatnonzero(~label)
    misses = np.bincount(session[miss], minlength=n)
    in_front = np.bincount(session[miss], rank[miss] < k, n).astype(np.int64)
    begin = np.cumsum(misses) - misses
    # a hit among the first k meets all misses, another one those among the first k: misses stand in order of rank
    size = np.where(rank[hit] < k, misses[session[hit]], in_front[session[hit]])
    at = 0
    ends = np.cumsum(size)
    while at < len(hit):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right")))
        a = np.repeat(hit[at:to], size[at:to])
        b = miss[_ranges(begin[session[hit[at:to]]], size[at:to])]
        sums.add_pairs(x, s, a, b, np.abs(discount[a] - discount[b]) / best[session[a]])
        at = to


def _unpacked(rows: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the packed row, item, label and features of each candidate."""
    flat = rows.flatten()
    of = np.repeat(np.arange(len(rows)), np.diff(np.asarray(rows.offsets)))
    item, label, x = (flat.field(c) for c in ("item", "label", "x"))
    return of, np.asarray(item), np.asarray(label), np.asarray(x.flatten()).reshape(len(flat), width)


def _whole_sums(weights: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums.none(len(weights))
        for batch in batches:
            add_sessions(sums, *_unpacked(batch["rows"], len(weights)), weights, k)
        yield sums.rows()

    return run


def _fronts(weights: np.ndarray, k: int):
    """Of each piece the first k: session, score, item, label, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, item, label, x = _unpacked(batch["rows"], len(weights))
            s = x @ weights
            order = np.lexsort((item, -s, of))
            count = np.bincount(of, minlength=batch.num_rows)
            keep = order[np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count) < k]
            features = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * len(weights), pa.int32()), pa.array(x[keep].ravel()))
            yield pa.RecordBatch.from_pydict({"session": batch["session"].take(pa.array(of[keep])), "score": pa.array(s[keep]), "item": pa.array(item[keep]), "label": pa.array(label[keep]), "x": features})

    return run


def add_piece(sums: Sums, front: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], hits: int, first: bool, weights: np.ndarray, k: int) -> None:
    """A piece of a session, given the session's first k, both as (item, label, x); pairs among these, and NDCG, are counted with the first piece."""
    item, label, x = front
    own = ~np.isin(rows[0], item)
    label, x = np.concatenate([label, rows[1][own]]).astype(bool), np.concatenate([x, rows[2][own]])
    s, n, best = x @ weights, len(item), float(ideal(np.array([hits]), k)[0])
    discount = np.zeros(len(x))
    discount[:n] = discounts(k)[:n]
    index = np.arange(len(x))
    pairs = [(np.flatnonzero(label[:n]), index[n:][~label[n:]]), (index[n:][label[n:]], np.flatnonzero(~label[:n]))]
    if first:
        pairs.append((np.flatnonzero(label[:n]), np.flatnonzero(~label[:n])))
        sums.ndcg += float(discount[label].sum()) / best
        sums.sessions += 1
    for a, b in pairs:
        hit, miss = np.repeat(a, len(b)), np.tile(b, len(a))
        for at in range(0, len(hit), MOST_PAIRS):
            i, j = hit[at : at + MOST_PAIRS], miss[at : at + MOST_PAIRS]
            sums.add_pairs(x, s, i, j, np.abs(discount[i] - discount[j]) / best)


def _piece_sums(weights: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums.none(len(weights))
        for batch in batches:
            for r in range(batch.num_rows):
                front, rows = (_unpacked(batch[c].slice(r, 1), len(weights))[1:] for c in ("front", "rows"))
                s = front[2] @ weights
                order = np.lexsort((front[0], -s))
                add_piece(sums, tuple(v[order] for v in front), rows, batch["hits"][r].as_py(), batch["piece"][r].as_py() == 0, weights, k)
        yield sums.rows()

    return run


def packed(rows: DataFrame, features: list[str], scale: dict[str, float], labels: int = 1) -> DataFrame:
    """(session, piece, pieces, hits, rows): the candidates of sessions that have both hits and misses; rows: item, label and x, features by their scale.

    rows: session, candidate_aid, label (0 or 1) and the features; null and NaN features count 0. With more ``labels`` each is a bit of the label, ``hits``
    an array, and ``n`` the session's candidates; sessions that have both of any of them are packed.
    """
    x = F.array(*(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) / scale[c] for c in features))
    given = rows.select("session", F.col("candidate_aid").cast("long").alias("item"), F.col("label").cast("long").alias("label"), x.alias("x"))
    each = [F.sum(F.shiftright("label", b).bitwiseAND(1)) for b in range(labels)]
    counts = given.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("hits"))
    counts = counts.filter(F.exists("hits", lambda h: (h > 0) & (h < F.col("n"))))
    counts = counts.select(F.col("session").alias("of"), (F.col("hits") if labels > 1 else F.col("hits")[0]).alias("hits"), F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"), *(["n"] if labels > 1 else []))
    dealt = given.join(counts, F.col("session") == F.col("of")).withColumn("piece", F.pmod(F.xxhash64("item"), F.col("pieces")).cast("int"))
    keys = ["session", "piece", "pieces", "hits", *(["n"] if labels > 1 else [])]
    return dealt.groupBy(*keys).agg(F.collect_list(F.struct("item", "label", "x")).alias("rows"))


def sum_rows(whole: DataFrame, wide: DataFrame | None, weights: np.ndarray, k: int) -> DataFrame:
    """Sums of one round as (place, value): NDCG, sessions, gradient, curvature. whole: packed sessions of one piece; wide: pieces of others (None: there are none)."""
    kind = "place int, value double"
    found = whole.select("rows").mapInArrow(_whole_sums(weights, k), kind)
    if wide is not None:
        front = wide.select("session", "rows").mapInArrow(_fronts(weights, k), "session long, score double, item long, label long, x array<double>")
        rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "item"))
        front = front.withColumn("r", rank).filter(F.col("r") <= k).groupBy(F.col("session").alias("of")).agg(F.collect_list(F.struct("item", "label", "x")).alias("front"))
        met = wide.join(front, F.col("session") == F.col("of")).select("front", "rows", "hits", "piece")
        found = found.unionByName(met.mapInArrow(_piece_sums(weights, k), kind))
    return found.groupBy("place").agg(F.sum("value").alias("value"))


def pair_sums(whole: DataFrame, wide: DataFrame | None, weights: np.ndarray, k: int) -> Sums:
    f = len(weights)
    values = np.zeros(2 + f + f * f)
    for place, value in sum_rows(whole, wide, weights, k).collect():
        values[place] = value
    return Sums(values[2 : 2 + f], values[2 + f :].reshape(f, f), float(values[0]), int(values[1]))


@dataclass
class Ranker:
    """Weights of the features as they come, and NDCG@k over the training sessions by round."""

    weights: dict[str, float]
    ndcg: list[float] = field(default_factory=list)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``, a column expression."""
        terms = (F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * float(w) for c, w in self.weights.items())
        return rows.withColumn("score", sum(terms, F.lit(0.0)))


def fit(rows: DataFrame, features: list[str], k: int = 20, rounds: int = 12, ridge: float = 0.01) -> Ranker:
    """Weights by Newton steps that raise NDCG@k over the training sessions; a step that doesn't is halved. ``ridge`` is a share of the mean curvature.

    rows: session, candidate_aid, label and the features. Sessions without a hit or without a miss teach nothing; if none teaches, all weights are 0.
    """
    return fit_targets(rows, features, {"label": "label"}, k, rounds, ridge)["label"]


def fit_targets(rows: DataFrame, features: list[str], labels: dict[str, str], k: int = 20, rounds: int = 12, ridge: float = 0.01) -> dict[str, Ranker]:
    """As ``fit`` for each of several labels (name: column) of the same rows, which are packed and written once."""
    spark = rows.sparkSession
    spread = rows.agg(*(F.stddev(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(c) for c in features)).first()
    scale = {c: float(spread[c]) if spread[c] else 1.0 for c in features}
    names = list(labels)
    # a label is a bit
    bits = sum((F.col(c).cast("long") * (1 << b) for b, c in enumerate(labels.values())), F.lit(0).cast("long"))
    path = shared_folder(spark, "pairs") + "/packed"
    packed(rows.select(*(c for c in rows.columns if c != "label"), bits.alias("label")), features, scale, len(names)).write.parquet(path)
    table = spark.read.parquet(path)
    return {name: _fitted(_of_label(table, b, len(names)), features, scale, k, rounds, ridge) for b, name in enumerate(names)}


def _of_label(table: DataFrame, bit: int, many: int) -> DataFrame:
    """The packed sessions that teach one label."""
    if many == 1:
        return table
    own = F.transform("rows", lambda r: F.struct(r["item"].alias("item"), F.shiftright(r["label"], bit).bitwiseAND(1).alias("label"), r["x"].alias("x")))
    hits = F.col("hits")[bit]
    return table.filter((hits > 0) & (hits < F.col("n"))).select("session", "piece", "pieces", hits.alias("hits"), own.alias("rows"))


def _fitted(table: DataFrame, features: list[str], scale: dict[str, float], k: int, rounds: int, ridge: float) -> Ranker:
    whole, wide = table.filter("pieces = 1"), table.filter("pieces > 1")
    wide = None if wide.isEmpty() else wide
    best = tried = step = np.zeros(len(features))
    seen: list[float] = []
    for _ in range(rounds + 1):
        sums = pair_sums(whole, wide, tried, k)
        if not sums.sessions:
            break
        seen.append(sums.ndcg / sums.sessions)
        if seen[-1] == max(seen):
            best = tried
            # added to the diagonal; the mean is 0 only where no feature tells a hit from a miss
            more = ridge * (np.trace(sums.curvature) / len(features) or 1.0)
            step = np.linalg.solve(sums.curvature + more * np.eye(len(features)), sums.gradient - more * best)
        else:
            step = step / 2
        tried = best + step
    return Ranker({c: float(w) / scale[c] for c, w in zip(features, best, strict=True)}, seen)
