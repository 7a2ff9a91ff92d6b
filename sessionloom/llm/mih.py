"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are signs of vectors under rotations learned to lose little by the rounding (iterated: codes from the rotation, rotation
from the codes). A code is cut into substrings of about log2(rows) bits; each substring is a table of its own, and an index entry (table,
substring value, row) is written once. A query probes every table within a substring radius: by the pigeonhole principle this retrieves every code
within ``tables * (substring radius + 1) - 1`` bits of the query's for certain, and further ones with a chance that the learned plan makes large
enough. Retrieved codes are compared whole; those near enough are reranked by inner products of the original vectors, in double precision.

Equal vectors are one node with its least ids, so copies cost nothing. Tables are cut by the leading bits of the substring, and a query goes to
those cells alone that its radius touches; cells that many rows or queries share are split. A query with too few rows in its
radius is probed again with a wider one; one that still has too few, or whose radius holds more rows than are worth listing, is compared
with all rows, in blocks. So no list is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.bytetext import tidy
from sessionloom.llm.shared import written

#: Vectors from which rotations are learned, and queries by which the plan is chosen: fixed numbers, picked by a hash of the vector.
LEARN_ROWS, PLAN_QUERIES = 16384, 256
#: Bits of a code, and substring tables at most.
CODE_BITS, MOST_TABLES = 384, 24
#: Share of the sampled queries' true neighbours that the whole-code radius and slack must each hold, and that the plan must find.
HELD, WITHIN = 0.995, 0.97
#: Rows and queries of a cell that meet in one task; larger cells are split.
CELL_ROWS, CELL_QUERIES = 32768, 32768
#: Rows in a query's radius, in one part of a cell, from which they are not listed but the query is compared with all rows.
WIDE = 4096
#: Vectors and queries that meet in one task where queries are compared with all rows.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Lookups done at once.
_AT_ONCE = 1 << 21
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector has no null or non-finite component and is not all zeros, of the commonest dimension (the larger of equals)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter("vec_id is not null and v is not null and size(v) > 0").filter(F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    # negative zeros become zeros, so that equal vectors have equal hashes
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


# ---- codes


def learn_rotations(sample: np.ndarray, bits: int = CODE_BITS, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Rotations side by side, dimension x code bits."""
    random, d = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(random.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(sample @ r > 0, 1.0, -1.0).T @ sample)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, 1)[:, :bits]


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rows of whole 64-bit words, filled up with zeros."""
    packed = np.packbits(x @ rotation > 0, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all pairs of codes."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None])
    return out


def substrings(code: np.ndarray, tables: int, width: int, first: int = 0) -> np.ndarray:
    """Values of the substrings ``first`` .. ``tables`` - 1 of ``width`` bits."""
    bits = np.unpackbits(code.view(np.uint8), axis=1)[:, first * width : tables * width].reshape(len(code), tables - first, width)
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def ball(width: int, radius: int) -> np.ndarray:
    """All values of that many bits with at most ``radius`` ones."""
    out = [0]
    for r in range(1, min(radius, width) + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    return np.array(out, np.int64)


@dataclass
class Plan:
    """What the sample taught: rotation; substring bits; tables; substring radius; whole-code radius; slack over the k-th nearest code; the shares found and fetched."""

    rotation: np.ndarray
    width: int
    tables: int
    near: int
    radius: int
    slack: int
    found: float
    fetched: float

    def wider(self) -> Plan:
        bits = self.rotation.shape[1]
        return Plan(self.rotation, self.width, self.tables, min(self.width, self.near + 1), min(bits, self.radius + bits // 12), bits, self.found, self.fetched)


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).view(np.uint64).reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


# ---- learning


def _sampled(rotation: np.ndarray, q: np.ndarray, k: int):
    """Of a task's rows, for each sampled query: the k of the best scores (kind 0) and the k nearest codes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_codes = codes(q, rotation)
        score, far = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        code = np.zeros((len(q), k, q_codes.shape[1]), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stacked(batch["v"])
            own, now = codes(x, rotation), q @ x.T
            now[(q[:, :1] == x[None, :, 0]) & (now >= (q * q).sum(1)[:, None] * (1 - 1e-12))] = -np.inf  # the query itself
            all_scores = np.concatenate([score, now], 1)
            top = np.argpartition(-all_scores, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(all_scores, top, 1)
            code = np.where((top < k)[..., None], np.take_along_axis(code, np.minimum(top, k - 1)[..., None], 1), own[np.maximum(top - k, 0)])
            apart = np.where(np.isneginf(now), np.iinfo(np.int64).max, distances(q_codes, own).astype(np.int64))
            far = np.sort(np.concatenate([far, apart], 1), axis=1)[:, :k]
        row = np.repeat(np.arange(len(q)), k)
        for kind, value in ((0, score), (1, -far.astype(float))):
            yield pa.RecordBatch.from_pydict({"query": pa.array(row, pa.int32()), "kind": pa.array(np.full(len(row), kind), pa.int32()), "value": pa.array(value.ravel()), "code": _lists(code.reshape(len(row), -1).view(np.int64), pa.int64())})

    return run


def learned(nodes: DataFrame, n: int, k: int) -> Plan:
    """The plan, from bounded samples: rotations from LEARN_ROWS vectors, all else from the true k nearest of PLAN_QUERIES queries among all rows."""
    by_hash = nodes.orderBy("key_b", "key_a")
    rotation = learn_rotations(np.array([r["v"] for r in by_hash.limit(LEARN_ROWS).select("v").collect()]))
    q = np.array([r["v"] for r in nodes.orderBy("key_a", "key_b").limit(PLAN_QUERIES).select("v").collect()])
    near = nodes.select("v").mapInArrow(tidy(_sampled(rotation, q, k)), "query int, kind int, value double, code array<long>")
    place = F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.desc("value")))
    rows = near.filter("abs(value) < 1e18").withColumn("place", place).filter(F.col("place") <= k).collect()
    bits = rotation.shape[1]
    width = int(np.clip(np.floor(np.log2(max(n, 2))), 4, 20))
    tables = max(1, min(MOST_TABLES, bits // width))
    true = [r for r in rows if r["kind"] == 0]
    if not true:
        return Plan(rotation, width, 1, width, bits, bits, 1.0, 1.0)
    kth = np.zeros(len(q))
    for r in rows:
        if r["kind"] == 1:
            kth[r["query"]] = max(kth[r["query"]], -r["value"])
    of = np.array([r["query"] for r in true])
    theirs, mine = np.array([r["code"] for r in true], np.int64).view(np.uint64), codes(q, rotation)[of]
    far = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
    radius = int(np.quantile(far, HELD, method="higher"))
    slack = max(0, int(np.quantile(far - kth[of], HELD, method="higher")))
    held = (far <= radius) & (far <= kth[of] + slack)
    apart = np.bitwise_count((substrings(theirs, tables, width) ^ substrings(mine, tables, width)).astype(np.uint64))
    plans = []
    for t in range(width + 1):
        found = (np.maximum.accumulate(apart <= t, axis=1) & held[:, None]).mean(0)
        enough = np.flatnonzero(found >= min(WITHIN, held.mean()))
        if len(enough):
            m = int(enough[0]) + 1
            # of random codes; what is fetched of the sample's own rows is not known here
            share = 1 - (1 - len(ball(width, t)) / 2.0**width) ** m if t <= 6 else 1.0
            plans.append((share, m, t, float(found[m - 1])))
        if t > 6 and plans:
            break
    share, m, t, found = min(plans)
    return Plan(rotation, width, m, t, radius, slack, found, share)


# ---- the index


def _cells(plan: Plan, lead: int, reach: int):
    """Adds ``cells``: of each row the cell (table, leading ``lead`` bits) of each substring, and those whose leading bits differ in up to ``reach``."""
    masks = ball(lead, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = substrings(_words(batch["code"]), plan.tables, plan.width) >> (plan.width - lead) if batch.num_rows else np.zeros((0, plan.tables), np.int64)
            at = (np.arange(plan.tables) << lead)[None, :, None] | (values[..., None] ^ masks)
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("id", "code")} | {"cells": _lists(at.reshape(len(at), -1), pa.int64())})

    return run


def _celled(rows: DataFrame, plan: Plan, lead: int, reach: int) -> DataFrame:
    return rows.mapInArrow(tidy(_cells(plan, lead, reach)), "id long, code array<long>, cells array<long>").select("id", "code", F.explode("cells").alias("cell"))


def _within(plan: Plan, lead: int, k: int):
    """Of one part of a cell: (query, row) pairs in the radius; row -1 where a query has too many to list."""
    masks = ball(plan.width, plan.near) if plan.near <= 6 else None

    def pairs(values: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if masks is not None and len(masks) <= len(values):
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            for a in range(0, len(asked), max(1, _AT_ONCE // len(masks))):
                own = asked[a : a + max(1, _AT_ONCE // len(masks))]
                probes = (own[:, None] ^ masks).ravel()
                begin, end = np.searchsorted(ranked, probes), np.searchsorted(ranked, probes, "right")
                n = end - begin
                hit = np.flatnonzero(n)
                begin, n = begin[hit], n[hit]
                yield a + np.repeat(hit // len(masks), n), order[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        else:
            for a in range(0, len(asked), max(1, _AT_ONCE // max(1, len(values)))):
                own = asked[a : a + max(1, _AT_ONCE // max(1, len(values)))]
                x, y = np.nonzero(np.bitwise_count((own[:, None] ^ values).astype(np.uint64)) <= plan.near)
                yield a + x, y

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_r = [], []
        if left.num_rows and right.num_rows:
            table = key[0].as_py() >> lead
            ids, rows, q_ids, q = np.asarray(left["id"]), _words(left["code"]), np.asarray(right["id"]), _words(right["code"])
            value = lambda code: substrings(code, table + 1, plan.width, table)[:, 0]
            for x, y in pairs(value(rows), value(q)):
                far = np.zeros(len(x), np.int64)
                for w in range(rows.shape[1]):
                    far += np.bitwise_count(q[x, w] ^ rows[y, w])
                near = np.flatnonzero(far <= plan.radius)
                x, y, far = x[near], y[near], far[near]
                order = np.lexsort((far, x))
                x, y, far = x[order], y[order], far[order]
                head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                size = np.diff(np.append(head, len(x)))
                # the k-th nearest code here is no nearer than that among all rows
                limit = far[np.minimum(head + k, head + size - 1)] + plan.slack
                limit[size <= k] = plan.radius
                keep = far <= np.repeat(limit, size)
                many = np.add.reduceat(keep, head) > WIDE if len(head) else np.zeros(0, bool)
                keep &= ~np.repeat(many, size)
                out_q += [q_ids[x[keep]], q_ids[x[head[many]]]]
                out_r += [ids[y[keep]], np.full(many.sum(), -1)]
        a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (out_q, out_r))
        return pa.table({"q": pa.array(a, pa.int64()), "r": pa.array(b, pa.int64())})

    return run


def probed(nodes: DataFrame, n: int, asked: DataFrame, plan: Plan, k: int) -> DataFrame:
    """Distinct (q, r): ids of the rows in the radius of each asked query, r = -1 for queries with too many. Both take id and code."""
    lead = int(min(plan.width, max(0, np.ceil(np.log2(max(n, 1) / CELL_ROWS)))))
    index, probes = _celled(nodes, plan, lead, 0), _celled(asked, plan, lead, plan.near)

    def crowded(cells: DataFrame, most: int, name: str) -> DataFrame:
        # at most one row for each ``most`` entries
        return cells.groupBy("cell").count().filter(F.col("count") > most).select(F.col("cell").alias(f"{name}_cell"), F.ceil(F.col("count") / most).cast("int").alias(name))

    many_rows, many_queries = written(crowded(index, CELL_ROWS, "rows"), "crowded"), written(crowded(probes, CELL_QUERIES, "queries"), "crowded")

    def dealt(cells: DataFrame, own: str, other: str) -> DataFrame:
        wide = cells.join(F.broadcast(many_rows), F.col("cell") == F.col("rows_cell"), "left").join(F.broadcast(many_queries), F.col("cell") == F.col("queries_cell"), "left")
        part = lambda c: F.coalesce(c, F.lit(1))
        wide = wide.withColumn(f"{own}_part", F.pmod(F.xxhash64("id"), part(own)).cast("int")).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), part(other) - 1)))
        return wide.select("id", "code", "cell", "rows_part", "queries_part")

    where = ("cell", "rows_part", "queries_part")
    left, right = dealt(index, "rows", "queries").groupBy(*where), dealt(probes, "queries", "rows").groupBy(*where)
    return left.cogroup(right).applyInArrow(_within(plan, lead, k), "q long, r long").distinct()


# ---- exact scores


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row: the sum's order depends on the dimension alone, so equal vectors have equal scores."""
    return (q * x).sum(1)


def _rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = _exact(_stacked(batch["w"]), _stacked(batch["v"])) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_pydict({"q": batch["q"], "r": batch["r"], "least": batch["least"], "score": pa.array(score)})


def _block(k: int):
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, least, x, q_ids, q = np.asarray(left["id"]), np.asarray(left["least"]), _stacked(left["v"]), np.asarray(right["id"]), _stacked(right["v"])
            for j in range(len(q)):
                rough = x @ q[j]
                # a hair below the k-th, so that rounding can't lose a tie
                rows = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, float(np.abs(rough).max()))) if len(x) > k else np.arange(len(x))
                score = _exact(q[j][None], x[rows])
                best = np.lexsort((least[rows], -score))[:k]
                out.append((np.full(len(best), q_ids[j]), ids[rows][best], least[rows][best], score[best]))
        a, b, c, d = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"q": pa.array(a, pa.int64()), "r": pa.array(b, pa.int64()), "least": pa.array(c, pa.int64()), "score": pa.array(d)})

    return run


FOUND = "q long, r long, least long, score double"


def _against_all(nodes: DataFrame, n: int, asked: DataFrame, k: int) -> DataFrame:
    """The k best of all rows for each of the asked queries, block by block."""
    row_blocks, query_blocks = -(-n // BLOCK_ROWS), max(1, -(-asked.count() // BLOCK_QUERIES))
    block = lambda number: F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")
    left = nodes.select("id", "least", "v", block(row_blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("j"))
    right = asked.select("id", "v", block(query_blocks).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("i"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_block(k), FOUND)


# ---- all together


def _coded(rotation: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes(_stacked(batch["v"]), rotation) if batch.num_rows else np.zeros((0, -(-rotation.shape[1] // 64)), np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "code": _lists(own.view(np.int64), pa.int64())})

    return run


def _searched(nodes: DataFrame, n: int, due: int, asked: DataFrame, k: int) -> DataFrame:
    """FOUND: nodes that have the ``due`` best rows for each asked node (id, v)."""
    plan = learned(nodes, n, k)
    coded = lambda df, what: written(df.select("id", "v").mapInArrow(tidy(_coded(plan.rotation)), "id long, code array<long>"), what)
    index, probes = coded(nodes, "codes"), coded(asked, "codes")
    vectors = nodes.select(F.col("id").alias("r_id"), "least", "v")
    wanted = asked.select(F.col("id").alias("q_id"), F.col("v").alias("w"))
    found, open_ = None, asked.select("id")
    for _ in range(2):
        pairs = written(probed(index, n, probes, plan, k), "pairs")
        sizes = nodes.select(F.col("id").alias("n_id"), "rows")
        held = pairs.filter("r >= 0").join(sizes.hint("shuffle_merge"), F.col("r") == F.col("n_id")).groupBy("q").agg(F.sum("rows").alias("held"))
        wide = pairs.filter("r < 0").select("q").distinct()
        held = held.join(wide.withColumnRenamed("q", "wide"), F.col("q") == F.col("wide"), "left_anti")
        done = written(held.filter(F.col("held") >= due).select("q"), "done")
        good = pairs.filter("r >= 0").join(done.withColumnRenamed("q", "done").hint("shuffle_merge"), F.col("q") == F.col("done"), "left_semi")
        both = good.join(vectors.hint("shuffle_merge"), F.col("r") == F.col("r_id")).join(wanted.hint("shuffle_merge"), F.col("q") == F.col("q_id"))
        scored = both.select("q", "r", "least", "v", "w").mapInArrow(tidy(_rescored), FOUND)
        found = scored if found is None else found.union(scored)
        open_ = written(open_.join(done.hint("shuffle_merge"), F.col("id") == F.col("q"), "left_anti"), "open")
        # queries with too many rows would have too many again
        again = open_.join(wide.hint("shuffle_merge"), F.col("id") == F.col("q"), "left_anti").withColumnRenamed("id", "again")
        probes = written(probes.join(again.hint("shuffle_merge"), F.col("id") == F.col("again"), "left_semi"), "again")
        if probes.isEmpty():
            break
        plan = plan.wider()
    if not open_.isEmpty():
        rest = written(asked.join(open_.withColumnRenamed("id", "open").hint("shuffle_merge"), F.col("id") == F.col("open"), "left_semi").select("id", "v"), "rest")
        found = found.union(_against_all(nodes, n, rest, due))
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``queries`` by inner product: query_id, rank (from 1), vec_id, score.

    ``vectors`` takes vec_id and the vector column, ``queries`` names rows of it by vec_id. A query's own vec_id is no candidate; fewer than k
    candidates are all returned. Ties go to the smaller vec_id. Unusable vectors (see ``usable``) take no part. Rows that repeat a vec_id are
    candidates each; of queries that repeat one, the least vector stands.
    """
    keyed = usable(vectors, vector).withColumns({"key_a": F.xxhash64("v"), "key_b": F.xxhash64(F.lit(1), "v")})
    rows = written(keyed, "vectors")
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], RESULT)
    named = queries.select(F.col("vec_id").cast("long").alias("asked")).distinct()
    wanted = rows.join(named.hint("shuffle_merge"), F.col("vec_id") == F.col("asked"), "left_semi").groupBy(F.col("vec_id").alias("query_id"))
    wanted = written(wanted.agg(F.min(F.struct("v", "key_a", "key_b")).alias("m"), F.count_distinct("key_a").alias("vectors")).select("query_id", "vectors", "m.*"), "queries")
    # with so many rows, k are left without the query's own (one, unless a vec_id has several vectors)
    most = k + (wanted.agg(F.max("vectors")).first()[0] or 1)
    # a node has its least ids, and how often each stands there
    by_key = Window.partitionBy("key_a", "key_b").orderBy("vec_id")
    ids = rows.groupBy("key_a", "key_b", "vec_id").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= most)
    nodes = ids.groupBy("key_a", "key_b").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.collect_list(F.struct("vec_id", "n")).alias("ids"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    asked = wanted.groupBy("key_a", "key_b").agg(F.first("v").alias("v"))
    asked = written(asked.withColumn("id", F.monotonically_increasing_id()), "asked")
    n, held = nodes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    found = _searched(nodes, n, min(most, held), asked, k)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))).filter(F.col("place") <= most).select("q", "r", "score")
    # of the best nodes the best ids, with no regard to the query's own
    each = best.join(nodes.select("id", "ids").hint("shuffle_merge"), F.col("r") == F.col("id")).select("q", "score", F.explode("ids").alias("x")).select("q", "score", "x.vec_id", "x.n")
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= most)
    lists = written(each.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id", "n")).alias("list")), "lists")
    # a vector that many queries share: its list meets them in several tasks
    lists = lists.join(asked.select("id", "key_a", "key_b").hint("shuffle_merge"), F.col("q") == F.col("id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lists = lists.select(F.col("key_a").alias("list_a"), F.col("key_b").alias("list_b"), "salt", "list")
    salted = wanted.select("query_id", "key_a", "key_b", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int").alias("own"))
    met = salted.join(lists.hint("shuffle_merge"), (F.col("key_a") == F.col("list_a")) & (F.col("key_b") == F.col("list_b")) & (F.col("own") == F.col("salt")))
    other = met.select("query_id", F.explode("list").alias("x")).select("query_id", "x.*").filter("vec_id != query_id")
    out = other.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long")))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Copies of a query vector's list, over which the queries that share it are dealt.
SALTS = 8
