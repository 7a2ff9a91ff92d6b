"""Vector code compression: parts of vectors named by codebook entries, found in a vantage-point tree for each part position.

Components are integers, so that sums, means and distances are exact wherever they are worked out. A tree holds a codebook's entries by their
distance from vantage entries: a ball of near ones, a shell of far ones, each with the least and greatest distance, rounded outwards. A part visits
first the side on which it lies, and the other side unless the triangle inequality rules out that it holds an entry as near as the best so far
(equally near ones are visited too, as the lower index wins). Only integer distances decide.

Codebooks are refined in rounds: tasks sum the parts of each entry, Spark adds the sums, the driver holds the entries alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.bytetext import tidy
from sessionloom.llm.shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of this size and more would not leave room for exact sums in 64 bits.
MOST = 1 << 27
#: Outward rounding of distances, as a share: far above the error of a square root.
SLACK = 2.0**-40


@dataclass
class Node:
    """A vantage entry; the sides below it, each (node, least distance, greatest distance) of its entries from the vantage entry."""

    entry: int
    ball: tuple[Node, float, float] | None
    shell: tuple[Node, float, float] | None


def tree(entries: np.ndarray, among: np.ndarray | None = None) -> Node:
    """Of rows of integers; the vantage entry is the one whose distances to the others vary most."""
    among = np.arange(len(entries)) if among is None else among
    apart = np.sqrt(((entries[among][:, None] - entries[among][None]) ** 2).sum(2).astype(float))
    pick = int(np.argmax(apart.var(1)))
    rest, far = np.delete(among, pick), np.delete(apart[pick], pick)
    order = np.argsort(far, kind="stable")
    rest, far = rest[order], far[order]

    def side(of: slice) -> tuple[Node, float, float] | None:
        if not len(rest[of]):
            return None
        return tree(entries, rest[of]), far[of][0] * (1 - SLACK), far[of][-1] * (1 + SLACK)

    half = (len(rest) + 1) // 2
    return Node(int(among[pick]), side(slice(0, half)), side(slice(half, None)))


def nearest(root: Node, entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each part's nearest entry (equally near: the lower index), its squared distance, and how many distances were worked out."""
    best, at = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(entries))
    done = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal done
        done += len(rows)
        square = ((parts[rows] - entries[node.entry]) ** 2).sum(1)
        nearer = (square < best[rows]) | ((square == best[rows]) & (node.entry < at[rows]))
        best[rows[nearer]], at[rows[nearer]] = square[nearer], node.entry
        far = np.sqrt(square.astype(float))

        def reach(side: tuple[Node, float, float] | None, of: np.ndarray) -> None:
            if side is None or not len(of):
                return
            below, least, most = side
            within = np.sqrt(best[rows[of]].astype(float)) * (1 + SLACK)
            open_ = of[(far[of] * (1 - SLACK) - within <= most) & (least - far[of] * (1 + SLACK) <= within)]
            if len(open_):
                visit(below, rows[open_])

        inside = far <= node.ball[2] if node.ball else np.zeros(len(rows), bool)
        for of, first, then in ((np.flatnonzero(inside), node.ball, node.shell), (np.flatnonzero(~inside), node.shell, node.ball)):
            reach(first, of)
            reach(then, of)

    if len(parts):
        visit(root, np.arange(len(parts)))
    return at, best, done


def whole_rows(vectors: DataFrame, vector: str, parts: int, scale: int) -> DataFrame:
    """vec_id, label and the integer components v of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select("vec_id", "label", v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    if sizes and sizes["d"] % parts:
        raise ValueError(f"{sizes['d']} components cannot be cut into {parts} equal parts")
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


def _stacked(column: pa.Array) -> np.ndarray:
    found = np.asarray(column.flatten(), np.int64).reshape(len(column), -1)
    if found.size and int(np.abs(found).max()) >= MOST:
        raise ValueError(f"a component of {MOST} or more after scaling")
    return found


def _cut(found: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(found, parts, axis=1)


def _summed(books: np.ndarray):
    """books: part x entry x component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(book) for book in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for k, part in enumerate(_cut(_stacked(batch["v"]), parts)):
                at = nearest(trees[k], books[k], part)[0]
                count[k] += np.bincount(at, minlength=entries)
                for c in range(width):  # exact: far below 2 ** 53
                    total[k, :, c] += np.bincount(at, part[:, c], entries).astype(np.int64)
        k, e = np.nonzero(count)
        out = {"part": pa.array(k, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[k, e])}
        yield pa.RecordBatch.from_pydict(out | {f"s{c}": pa.array(total[k, e, c]) for c in range(width)})

    return run


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round over all rows."""
    sums = [f"s{c}" for c in range(books.shape[2])]
    found = rows.select("v").mapInArrow(tidy(_summed(books)), ", ".join(["part int", "entry int", "n long", *(f"{s} long" for s in sums)]))
    books = books.copy()
    # a row an entry at most
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).collect():
        books[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
    return books


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(book) for book in books]
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for k, part in enumerate(_cut(_stacked(batch["v"]), len(books))):
                at, square, _ = nearest(trees[k], books[k], part)
                codes[:, k], error = at, error + square
            hexed = codes.tobytes().hex()
            width = 2 * len(books)
            code = pa.array([hexed[k * width : k * width + width] for k in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"], "code": code, "error": pa.array(error)})

    return run


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per row vec_id, label, code, error, label_error, codebooks_sha256.

    Takes vec_id, label and the vector; other columns are ignored. Rows whose vector is null, empty, or holds a null or non-finite component take no
    part, nor do those of another dimension than the commonest (the larger of equals); a dimension that ``parts`` doesn't divide, or a component
    of ``MOST`` or more after scaling, is an error. Each component becomes floor(scale * x). The first codebooks are the parts of the rows of
    least vec_id (each id once, with its least vector; null ids come last); with fewer rows they have fewer entries. Rows that repeat count each.
    label_error sums the errors of a label's rows, rows without label together. ``entries`` is 256 at most: an index has two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    spark = vectors.sparkSession
    rows = written(whole_rows(vectors, vector, parts, scale), "whole")
    # an id's least row, so that rows that repeat an id give one entry; a bounded number comes to the driver
    start = rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not start:
        coded, digest = spark.createDataFrame([], schema), codebook_digest(np.zeros(0, np.int64))
    else:
        books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
        for _ in range(rounds):
            books = refined(rows, books)
        coded, digest = written(rows.mapInArrow(tidy(_coded(books)), schema), "coded"), codebook_digest(books)
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return both.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
