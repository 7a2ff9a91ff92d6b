"""User and item pairs of two behaviours (views and purchases), dense matrices of them, and samples of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.operators.covisit import dense_ids
from sessionloom.operators.ordered import first_rows


def interactions(events: DataFrame, kind: str) -> DataFrame:
    """(user, item) of every event of a type; sessions are users, repeats stay."""
    return events.filter(F.col("type") == kind).select(F.col("session").alias("user"), F.col("aid").alias("item"))


def draw(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) by a hash of the key: the same in every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def session_sample(events: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """All events of about so large a share of the sessions. No shuffle: the session alone decides. Events without a session are left out."""
    return events.filter(draw(F.col("session"), seed) < share)


def event_sample(events: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """About so large a share of the events, each drawn by its own values; repeats of an event go together."""
    return events.filter(draw(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session", "aid", "ts", "type"))), seed) < share)


def sessions_by_draw(events: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All events of n sessions (all, if fewer): those of the least draws, ties to the smaller session."""
    chosen = events.select("session").filter("session is not null").distinct().orderBy(draw(F.col("session"), seed), "session").limit(n)
    return events.join(chosen, "session", "left_semi")


def row_sample(events: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct (session, aid) pairs (all, if fewer) of the least draws, ties to the smaller session and item."""
    pairs = events.select("session", "aid").filter("session is not null and aid is not null").distinct()
    drawn = pairs.withColumn("draw", draw(F.concat_ws(":", "session", "aid"), seed)).persist(StorageLevel.MEMORY_AND_DISK)
    return first_rows(drawn, [("draw", False), ("session", False), ("aid", False)], n).drop("draw")


def common_users(views: DataFrame, purchases: DataFrame) -> DataFrame:
    """Users who have both."""
    return views.select("user").intersect(purchases.select("user"))


def interaction_matrices(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, held_out) of flat events, over users with views (in either part) and purchases in training.

    Users and items get dense numbers from 0 in id order; items count that these users view in either part or buy in
    training. ``matrix`` has the distinct (behaviour, user, item) with ``pv`` of both parts and ``buy`` of training: the non-zero
    cells. ``held_out`` has the purchases of the test whose user and item are numbered, repeats included.
    """
    views = interactions(train, C.CLICK).unionByName(interactions(test, C.CLICK)).distinct()
    purchases = interactions(train, C.ORDER)
    both = common_users(views, purchases)
    seen = views.select(F.lit("pv").alias("behaviour"), "user", "item").unionByName(purchases.distinct().select(F.lit("buy").alias("behaviour"), "user", "item"))
    seen = seen.filter("item is not null").join(both, "user", "left_semi")
    users = dense_ids(both, "user").withColumnRenamed("dense", "user_number")
    items = dense_ids(seen, "item").withColumnRenamed("dense", "item_number")

    def numbered(pairs: DataFrame) -> DataFrame:
        rest = [c for c in pairs.columns if c not in ("user", "item")]
        return pairs.join(users, "user").join(items, "item").select(*rest, F.col("user_number").alias("user"), F.col("item_number").alias("item"))

    return numbered(seen), numbered(interactions(test, C.ORDER))


def _row_block(rows: int):
    def run(table: pa.Table) -> pa.Table:
        block, row, column = (table[c].to_numpy() for c in ("block", "row", "col"))
        order = np.lexsort((column, row))
        starts = np.searchsorted(row[order] - block[0] * rows, np.arange(rows + 1))
        values = table["value"].to_numpy()[order]
        out = {"indptr": (starts, pa.int32()), "indices": (column[order], pa.int64()), "values": (values, pa.float64())}
        return pa.table({"block": table["block"][:1], "piece": table["piece"][:1], **{k: pa.array([v], pa.list_(t)) for k, (v, t) in out.items()}})

    return run


def row_blocks(cells: DataFrame, rows: int = 1024, most: int = 1 << 18) -> DataFrame:
    """The sparse matrix of (row, col, value) in compressed blocks of ``rows`` rows: block, piece, indptr (rows + 1), indices and values.

    Row r is in block r div rows, its cells at indptr[r % rows] up to the next, in order of columns. A block of more than ``most`` cells is cut into pieces
    by a hash of the column, each of all its rows, so a block or row of any size stays in pieces of about that many cells. Cells with a null are left
    out, repeats stay; blocks without cells are absent. Columns other than these three are ignored.
    """
    placed = cells.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double")).dropna().withColumn("block", F.floor(F.col("row") / rows))
    pieces = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces"))
    cut = placed.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("col"), F.col("pieces"))).drop("pieces")
    return cut.groupBy("block", "piece").applyInArrow(_row_block(rows), "block long, piece long, indptr array<int>, indices array<long>, `values` array<double>")


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            starts, indices, values = (batch[c][k].values.to_numpy() for c in ("indptr", "indices", "values"))
            factors = np.zeros(len(starts) - 1)
            at, x = (batch[c][k].values.to_numpy() for c in ("places", "factors"))
            factors[at] = x
            columns, place = np.unique(indices, return_inverse=True)
            sums = np.bincount(place, values * np.repeat(factors, np.diff(starts)), len(columns))
            yield pa.RecordBatch.from_pydict({"col": pa.array(columns, pa.int64()), "part": pa.array(sums, pa.float64())})


def transposed_product(blocks: DataFrame, vector: DataFrame, rows: int = 1024) -> DataFrame:
    """(col, value): for each column of the blocks the sum of its cells times the vector (row, factor) at their rows; absent and null entries are 0.

    The vector is cut as the blocks are and meets them block by block; a block hands on one sum a column. Rows of the vector are distinct.
    """
    kept = vector.select(F.col("row").cast("long"), F.col("factor").cast("double")).dropna().withColumn("of", F.floor(F.col("row") / rows))
    entry = F.collect_list(F.struct((F.col("row") - F.col("of") * rows).cast("int").alias("place"), "factor"))
    cut = kept.groupBy("of").agg(entry.alias("entries")).select("of", F.col("entries.place").alias("places"), F.col("entries.factor").alias("factors"))
    met = blocks.join(cut, F.col("block") == F.col("of"), "left").select("indptr", "indices", "values", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("places", "array<int>"), ("factors", "array<double>"))))
    return met.mapInArrow(_multiplied, "col long, part double").groupBy("col").agg(F.sum("part").alias("value"))
