"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration.

Statistics are of the text alone. Every task maps its labelled rows to random Fourier features of a Gaussian kernel and adds up its part of the
normal equations; a fixed number of groups adds the parts, and the driver solves one small system. Calibration pools adjacent
violators over a score histogram of fixed size, so nothing on the driver grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.bytetext import Words, chunks, tidy
from sessionloom.llm.shared import written

#: Bytes of text that are measured at once.
BATCH_BYTES = 256 << 10
STATISTICS = ("log_words", "word_size", "word_size_spread", "upper", "digits", "symbols", "ends_in_letter", "distinct", "repeated_lines", "short_words", "lines", "beyond_ascii", "stops", "log_longest", "bars", "all_upper")
#: Random features, kernel width in standard deviations, ridge, bins of the calibration histogram, groups that add up parts.
FOURIER, WIDTH, RIDGE, BINS, GROUPS = 160, 3.0, 1e-3, 1024, 16
_ASCII = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 97) & (_ASCII <= 122), (_ASCII >= 48) & (_ASCII <= 57)
_SYMBOL = np.isin(_ASCII, [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~[]"])
_LETTER = _UPPER | _LOWER | (_ASCII >= 128)


def _per(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=docs)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS a text; an empty or null text has zeros throughout."""
    w = Words(column)
    docs, data = w.docs, w.data
    out = np.zeros((docs, len(STATISTICS)))
    if not len(w.starts):
        return out
    size = (w.ends - w.starts).astype(float)
    n = np.maximum(w.count, 1).astype(float)
    byte_doc = np.repeat(np.arange(docs), np.diff(w.offsets))
    n_bytes = np.maximum(np.diff(w.offsets), 1).astype(float)
    of_bytes = lambda table: _per(table[data], byte_doc, docs) / n_bytes
    mean = _per(size, w.doc, docs) / n
    hashes = w.hashes()
    order = np.lexsort((hashes, w.doc))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(_UPPER[data] | _LOWER[data])])
    shouted = (upper[w.ends] - upper[w.starts] >= 2) & (upper[w.ends] - upper[w.starts] == letters[w.ends] - letters[w.starts])
    # lines: a line's hash is the sum of its words' hashes by place
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[w.starts] + w.doc * 2
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))
    line_hash = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), head)
    line_doc = w.doc[head]
    lines = np.maximum(np.bincount(line_doc, minlength=docs), 1).astype(float)
    by = np.lexsort((line_hash, line_doc))
    again = np.concatenate([[False], (line_hash[by][1:] == line_hash[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])])
    longest = np.zeros(docs)
    np.maximum.at(longest, w.doc, size)
    columns = (
        np.log1p(w.count), mean, np.sqrt(np.maximum(_per(size**2, w.doc, docs) / n - mean**2, 0)), of_bytes(_UPPER), of_bytes(_DIGIT), of_bytes(_SYMBOL),
        _per(_LETTER[data[w.ends - 1]], w.doc, docs) / n, _per(new, w.doc[order], docs) / n, _per(again, line_doc[by], docs) / lines, _per(size <= 3, w.doc, docs) / n,
        lines / n, of_bytes(_ASCII >= 128), of_bytes(_ASCII == 46), np.log1p(longest), of_bytes(_ASCII == 124), _per(shouted, w.doc, docs) / n,
    )
    out = np.stack(columns, 1)
    out[w.count == 0] = 0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", BATCH_BYTES):
        s = statistics(batch["text"])
        flat = pa.array(s.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), flat)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "row_key": batch["row_key"], "statistics": lists})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of doc_id and text) and statistics of each row's whole text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_key", T.LongType()), T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("row_key"), text.alias("text")).mapInArrow(tidy(_measure), schema)


def held_out(doc_id: Column) -> Column:
    """Rows from which nothing is learnt: crc32 of the id as text leaves 0 modulo 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), len(STATISTICS))


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores at them, not descending

    def fourier(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    random = np.random.default_rng(90125)
    directions = random.normal(size=(len(STATISTICS), FOURIER)) / WIDTH
    phases = random.uniform(0, 2 * np.pi, FOURIER)
    return np.concatenate([np.cos(np.clip(z, -8, 8) @ directions + phases) * np.sqrt(2 / FOURIER), np.ones((len(z), 1))], 1)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum of ``part(statistics, labels)`` over all rows: tasks add up their own, GROUPS groups the tasks', the driver the groups'."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch["statistics"]), np.asarray(batch["quality"], float))
        yield pa.RecordBatch.from_pydict({"group": pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    def together(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in table["total"].to_pylist())
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(own, "group int, total binary").groupBy("group").applyInArrow(together, "total binary").collect()
    return sum((np.frombuffer(r["total"], float) for r in parts), np.zeros(width))


def isotonic(score: np.ndarray, right: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in score order: knots (mean scores of the pools) and their levels."""
    pools: list[list[float]] = []
    for s, r, n in zip(score, right, number, strict=True):
        pools.append([s * n, r, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(statistics_of: DataFrame, labels: DataFrame) -> Classifier:
    """Learn ``quality`` (0 or 1) from all labelled rows that are not held out; a doc_id labelled more than once counts by its mean label.

    Rows of ``statistics_of`` that repeat a doc_id all get its label. Without any labels every score is 0.5.
    """
    named = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.avg("quality").alias("quality"))
    rows = statistics_of.join(named, F.col("doc_id") == F.col("labelled")).filter(~held_out(F.col("doc_id"))).select("statistics", "quality")
    rows = written(rows, "labelled")
    k = len(STATISTICS)
    sums = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 2 * k + 1)
    n = sums[0]
    if not n:
        return Classifier(np.zeros(k), np.ones(k), np.zeros(FOURIER + 1), np.array([0.0]), np.array([0.5]))
    mean = sums[1 : k + 1] / n
    scale = np.sqrt(np.maximum(sums[k + 1 :] / n - mean**2, 1e-12))
    m = FOURIER + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        phi = fourier((x - mean) / scale)
        return np.concatenate([(phi.T @ phi).ravel(), phi.T @ y])

    sums = _summed(rows, equations, m * m + m)
    weights = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * n / m * np.eye(m), sums[m * m :])
    plain = Classifier(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = np.clip(plain.raw(x), -0.5, 1.5)
        at = np.clip(np.searchsorted(edges, s, "right") - 1, 0, BINS - 1)
        return np.concatenate([np.bincount(at, w, BINS) for w in (s, y, np.ones(len(y)))])

    s, y, c = _summed(rows, histogram, 3 * BINS).reshape(3, BINS)
    has = c > 0
    knots, levels = isotonic(s[has] / c[has], y[has], c[has])
    return Classifier(mean, scale, weights, knots, levels)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, row_key, held_out, score, predicted of each row, by a classifier fitted to the labelled rows that are not held out.

    The score is a function of the text alone. Null and empty texts have statistics of zero and a score like any other.
    """
    rows = written(measured(docs), "statistics")
    model = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "row_key": batch["row_key"], "score": pa.array(model.score(_matrix(batch["statistics"])) if batch.num_rows else [], pa.float64())})

    schema = T.StructType([rows.schema["doc_id"], rows.schema["row_key"], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", "row_key", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score is ``threshold`` or more; see ``scored``. No row moves: each task judges its own."""
    model = fit(written(measured(docs), "statistics"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH_BYTES):
            yield batch.filter(pa.array(model.score(statistics(batch["text"])) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
