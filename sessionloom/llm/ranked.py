"""Ranked lexical search over a two-level quantised index.

The lower level has, for each document, the exact counts of its terms and its length measure m; the upper level has one byte a posting: the term's
part of a score, divided by a step and rounded up. Weighted sums of bytes bound every score from above at the price of small integers. In each task
the documents of best bound are scored first, in 64-bit integers; the k-th of those scores is a lower bound of what a list holds, and every further
document whose bound reaches it is scored exactly. So no document that could rank is left out, and few are scored in full.

Items are searched in blocks of bounded size: a block's terms are the vocabulary of its index, so postings that no item asks for are never written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.bytetext import Words, chunks, runs, tidy
from sessionloom.llm.shared import written

#: Bytes that part terms: ASCII other than letters and digits.
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A term's part of a score before its weight is below this; the byte counts such steps.
WHOLE = 10**6
STEP = -(-WHOLE // 255)
#: Terms of the items of a block, each item's counted once.
BLOCK_TERMS = 1 << 20
#: Postings times items, and documents times items, that are worked on at once.
MOST_PAIRS, MOST_CELLS = 1 << 22, 1 << 21
INDEX = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        words = Words(batch["text"], lower=True, blank=BREAK)
        h = words.hashes().view(np.int64)
        order = np.lexsort((h, words.doc))
        h, doc = h[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        starts = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=batch.num_rows))])
        yield pa.RecordBatch.from_pydict({"item_id": batch["item_id"], "item_key": batch["item_key"], "terms": _lists(starts, h[new], pa.int64())})


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, item_key, terms): hashes of each item's distinct terms; rows equal in item_id and text are one item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = items.select("item_id", F.xxhash64("item_id", text).alias("item_key"), text.alias("text"))
    keyed = keyed.mapInArrow(tidy(_item_terms), f"item_id {items.schema['item_id'].dataType.simpleString()}, item_key long, terms array<long>")
    return keyed.dropDuplicates(["item_id", "item_key"])


def _counted(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch["text"], lower=True, blank=BREAK)
            h = words.hashes().view(np.int64)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            key, tf = np.unique(words.doc[hit] * len(vocabulary) + at[hit], return_counts=True)
            some = np.flatnonzero(words.count)
            # documents without a term have no postings, so the others keep theirs in order
            starts = np.concatenate([[0], np.cumsum(np.bincount(key // len(vocabulary), minlength=batch.num_rows)[some])])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"].take(pa.array(some)), "n": pa.array(words.count[some]),
                "terms": _lists(starts, key % len(vocabulary), pa.int32()), "counts": _lists(starts, tf, pa.int32()),
            })

    return run


def counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Lower level: documents with a term at least, their length in terms, and the terms among ``vocabulary`` (ascending hashes) with their counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_counted(vocabulary)), INDEX)


def length_measure(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """10 plus 90 times the document's length over the mean length, rounded down."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // length for x in n], np.int64)
    return 10 + 90 * n.astype(np.int64) * documents // length


def term_parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score, before its weight."""
    tf = tf.astype(np.int64)
    return (1000 * WHOLE * tf) // (1000 * tf + 8 * m)


def _quantised(documents: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch["terms"].offsets))
            m = length_measure(np.asarray(batch["n"]), documents, length)
            parts = term_parts(np.asarray(batch["counts"].flatten()), np.repeat(m, sizes))
            impacts = -(-parts // STEP)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(impacts.astype(np.uint8))])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "m": pa.array(m), "terms": batch["terms"], "counts": batch["counts"], "impacts": packed})

    return run


def with_impacts(lower: DataFrame, documents: int, length: int) -> DataFrame:
    """Both levels: doc_id, m, terms, counts, and impacts, a byte for each of the terms."""
    return lower.mapInArrow(tidy(_quantised(documents, length)), "doc_id long, m long, terms array<int>, counts array<int>, impacts binary")


@dataclass
class Block:
    """Items by the term that asks for them: those of term t, with its weight, are places starts[t] to starts[t + 1]."""

    items: int
    starts: np.ndarray
    item: np.ndarray
    weight: np.ndarray


class Best:
    """The k best of each item so far: highest score, then least id, null last."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.item, self.score, self.id, self.null = (np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, bool))
        self.floor = np.zeros(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(item):
            return
        item, score, ids, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        at = runs(item)
        rank = np.arange(len(item)) - np.repeat(at, np.diff(np.append(at, len(item))))
        keep = rank < self.k
        order = order[keep]
        self.item, self.score, self.id, self.null = item[keep], score[order], ids[order], null[order]
        last = rank[keep] == self.k - 1
        self.floor[self.item[last]] = self.score[last]


def _scored(block: Block, best: Best, ids: np.ndarray, null: np.ndarray, m: np.ndarray, doc: np.ndarray, terms: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> None:
    """Brings ``best`` up to date with some documents."""
    size = block.starts[terms + 1] - block.starts[terms]
    posting = np.repeat(np.arange(len(terms)), size)
    if not len(posting):
        return
    place = np.arange(len(posting)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.starts[terms], size)
    weight, cell = block.weight[place], doc[posting] * block.items + block.item[place]
    # sums of integers far below 2 ** 53: exact
    bound = STEP * np.bincount(cell, weight * impact[posting], len(ids) * block.items).reshape(len(ids), block.items)

    def rescore(wanted: np.ndarray) -> None:
        of = np.flatnonzero(wanted.ravel()[cell])
        of = of[np.argsort(cell[of], kind="stable")]
        at = runs(cell[of])
        if len(at):
            total = np.add.reduceat(weight[of] * term_parts(tf[posting[of]], m[doc[posting[of]]]), at)
            pair = cell[of[at]]
            some = total > 0
            best.add(pair[some] % block.items, total[some], ids[pair[some] // block.items], null[pair[some] // block.items])

    first = (bound > 0) & (bound >= best.floor)
    if len(ids) > best.k:
        top = np.zeros_like(first)
        np.put_along_axis(top, np.argpartition(-bound, best.k - 1, axis=0)[: best.k], True, axis=0)
        rescore(first & top)
        rescore(first & ~top & (bound >= best.floor))
    else:
        rescore(first)


def _searched(block: Block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.items, k)
        for batch in batches:
            null = np.asarray(batch["doc_id"].is_null())
            ids = np.asarray(batch["doc_id"].fill_null(0))
            ends = np.asarray(batch["terms"].offsets).astype(np.int64)
            terms, tf = np.asarray(batch["terms"].flatten()), np.asarray(batch["counts"].flatten())
            ends = ends - ends[0]
            packed = batch["impacts"]
            at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(ids) + 1]
            impact = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]] if len(terms) else np.zeros(0, np.uint8)
            m = np.asarray(batch["m"])
            pairs = np.concatenate([[0], np.cumsum(block.starts[terms + 1] - block.starts[terms])])[ends]
            begin = 0
            while begin < len(ids):
                to = max(begin + 1, min(begin + MOST_CELLS // block.items, int(np.searchsorted(pairs, pairs[begin] + MOST_PAIRS, "right")) - 1))
                of = slice(ends[begin], ends[to])
                doc = np.repeat(np.arange(to - begin), np.diff(ends[begin : to + 1]))
                _scored(block, best, ids[begin:to], null[begin:to], m[begin:to], doc, terms[of], tf[of], impact[of])
                begin = to
        yield pa.RecordBatch.from_pydict({"item": pa.array(best.item, pa.int32()), "doc_id": pa.array(best.id, pa.int64(), mask=best.null), "score": pa.array(best.score)})

    return run


def _searched_block(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame | None:
    """item (its row number), rank, doc_id and score for the items in ``rows``; None if nothing can be found."""
    asked = rows["terms"].combine_chunks()
    hashes = np.asarray(asked.flatten())
    if not len(hashes):
        return None
    of_item = np.repeat(np.arange(len(asked)), np.diff(np.asarray(asked.offsets)))
    vocabulary, term = np.unique(hashes, return_inverse=True)
    lower = written(counts(docs, vocabulary), "counts")
    size = lower.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not size["documents"]:
        return None
    held = np.zeros(len(vocabulary), np.int64)
    # at most a row a term of the block
    for t, n in lower.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    order = np.argsort(term, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
    block = Block(len(asked), starts, of_item[order], weights[term[order]])
    index = written(with_impacts(lower, size["documents"], size["length"]), "impacts")
    best = index.mapInArrow(tidy(_searched(block, k)), FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k documents of highest score above 0, equal scores by ascending doc_id.

    Takes item_id and text of ``items``, doc_id and text of ``docs``; other columns are ignored. Terms are runs of ASCII letters, digits and
    characters beyond ASCII, A-Z lower-cased; null and empty texts have none. A score sums, over the item's distinct terms, the weight
    floor(1000 * ln((2 N + 2) / (2 df + 1))) times (10 ** 9 tf) div (1000 tf + 8 m), where m is 10 + (90 n N) div L. Each row of ``docs`` is a
    document, also where rows repeat; those without doc_id count and rank last among equal scores. Items equal in item_id and text are one; an
    item_id with two texts has two lists. Items without terms, or whose terms no document holds, have no rows.

    Terms are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items), "items")
    terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-terms // BLOCK_TERMS)
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.col("item_key"), F.lit(blocks)) == b).toArrow()
        part = _searched_block(docs, rows, k)
        if part is not None:
            names = spark.createDataFrame(rows.select(["item_id"]).append_column("of_item", pa.array(range(rows.num_rows), pa.int32())))
            named = part.join(names, F.col("item") == F.col("of_item")).select("item_id", "rank", "doc_id", "score")
            found = named if b == 0 else found.unionByName(named)
    return found
