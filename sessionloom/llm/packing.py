"""Best-fit packing of tokenized documents into sequences of fixed capacity, in bulk-synchronous sweeps.

Sizes are whole numbers up to the capacity, so sorting documents and gaps by size gives at most ``capacity`` classes of each,
however many rows there are. Spark counts the rows of each class and ranks every row in its class; a sweep goes through the document
classes from the largest down, and matches a whole class at once with the gap classes that are its successors (the smallest gaps that
fit), rank by rank: rank decides which document gets which gap. The gaps left are classes again, for the next sweep. This is
best-fit decreasing. The sweeps hold class counts only (a table bounded by the capacity, not by the data); every row then finds
its own place from its class and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.bytetext import chunks, tidy
from sessionloom.llm.shared import written
from sessionloom.llm.tokens import word_tokenizer

PIECES = "piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in chunks(batches, "text", 512 << 10):
            ids, offsets = tokenizer.encode(batch["text"])
            docs = batch.num_rows
            ends = offsets[1:] + np.arange(1, docs + 1)
            full = np.empty(len(ids) + docs, np.uint32)
            last = np.zeros(len(full), bool)
            last[ends - 1] = True
            full[last], full[~last] = end_id, ids
            begins = np.concatenate([[0], ends[:-1]])
            number = -(-(ends - begins) // capacity)
            row = np.repeat(np.arange(docs), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, (ends - begins)[row] - start)
            raw = memoryview(full.astype("<u4").tobytes())
            at = 4 * (begins[row] + start)
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            # rank among this partition's pieces of the same length
            order = np.argsort(length, kind="stable")
            sized = length[order]
            head = np.flatnonzero(np.concatenate([[True], sized[1:] != sized[:-1]]))
            nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
            rank = np.empty(len(order), np.int64)
            rank[order] = nth + seen[sized]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(row), part), pa.int32()), "local_rank": pa.array(rank)})

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Each row's ids, then ``end_id``, in pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32, and a rank of the row among those of its length in its partition."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(PIECES).fields])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id)), schema)


def sweeps(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over class counts: rows (length, first rank, first bin, per bin, offset).

    Ranks from ``first rank`` on (up to the next row of that length) lie ``per bin`` to a bin, from ``first bin``
    on, the first in each at ``offset``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: bins (first, number); all of a gap are filled to capacity - gap
    open_gaps: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect_left(open_gaps, size)
            if k < len(open_gaps):
                gap = open_gaps[k]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
            else:
                gap, first, number = capacity, bins, -(-left // (capacity // size))
                bins += number
            each = gap // size
            whole, rest = min(number, left // each), left - min(number, left // each) * each
            out.append((size, rank, first, each, capacity - gap))
            leave(gap - each * size, first, whole)
            used = whole
            if whole < number and rest:  # the last bin of this class takes fewer
                leave(gap - rest * size, first + whole, 1)
                used += 1
            leave(gap, first + used, number - used)
            placed = min(left, whole * each + (rest if used > whole else 0))
            rank, left = rank + placed, left - placed
    return np.array(out, np.int64).reshape(-1, 5)


def _place(plan: np.ndarray):
    key = plan[:, 0] << 48 | plan[:, 1]
    order = np.argsort(key)
    key, plan = key[order], plan[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(key, length << 48 | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            nth = rank - row[:, 1]
            out = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out["sequence_id"] = pa.array(row[:, 2] + nth // np.maximum(row[:, 3], 1))
            out["offset"] = pa.array(row[:, 4] + nth % np.maximum(row[:, 3], 1) * length)
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack every row's tokens: per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Takes doc_id and text; a null or empty text is ``end_id`` alone. Rows that repeat a doc_id are packed each for itself.
    Only documents longer than ``capacity`` are cut. Sequence numbers run from 0 without holes; offsets in each are
    gapless. An empty table gives no rows.
    """
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    plan = sweeps({r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    named = bases.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), "base")
    ranked = pieces.join(named.hint("shuffle_merge"), (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").fields])
    return ranked.mapInArrow(_place(plan), schema)
