"""Near copies by similarity of shingle sets: fingerprints compared bit-sliced in buckets, the sets themselves decide, components join what is alike.

A node is a distinct shingle set; its SimHash fingerprint is voted by distinct shingles, as the similarity counts them. Nodes meet in buckets, one for
each of ``bands`` keys of ``rows`` least values of their shingles under as many hash functions: two sets share a key with the chance similarity ** rows, so
unrelated sets hardly ever do, and a bucket is large only where many sets are much alike. In a bucket the fingerprints are compared as bit planes
(``simhash``); pairs that differ in ``radius`` bits or fewer are candidates if their sizes and sketches allow it. A sketch has a byte of the least
value of each function: two sets agree in as large a share of the bytes as they are similar, give or take.

No link counts unchecked, and none stands for another before it is checked. A bucket hands on all its candidate pairs; only where rows hang together by
more than ``DENSE`` pairs a row, a spanning forest goes first and the rows are kept as a group. Groups whose rows the checked links
leave apart are compared in full, slice against slice, by the sets themselves, which are brought to the slices and not to each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import simhash
from sessionloom.llm.bytetext import Words, chunks, tidy
from sessionloom.llm.shared import written

#: Pairs a row up to which connected rows of a bucket are all handed on at once.
DENSE = 8
#: Rows, and values of their sets, of a slice of a group: a task compares two slices, each row with each.
SLICE_ROWS, SLICE_VALUES = 1024, 1 << 20
BITS = 256
#: Standard deviations below the least similarity at which sketches rule a pair out: at that similarity one pair in some millions.
SIGMAS = 5.0
COLUMNS = [f"f{k}" for k in range(BITS // 64)]


def distinct_shingles(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, ascending, in document order."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _set_keys(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A hash of each document's set: sums of remixed values."""
    total = np.zeros(docs + 1, np.uint64)
    total[1:] = np.bincount(doc, minlength=docs)
    out = total[1:] * simhash._P3
    if len(h):
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        with np.errstate(over="ignore"):
            out[doc[at]] += np.add.reduceat(simhash._remixed(h, simhash._P4), at)
    return out


def band_keys(h: np.ndarray, doc: np.ndarray, docs: int, bands: int, rows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's values, a key for each band: a hash of the least values under ``rows`` functions of its own; and a byte of each of those least values.

    No values have the key of the band alone, and bytes of 0.
    """
    random = np.random.default_rng(seed)
    x = (h >> np.uint64(32)).astype(np.uint32)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(h) else np.zeros(0, np.int64)
    out, sketch = np.zeros((docs, bands), np.uint64), np.zeros((docs, bands * rows), np.uint8)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(at), band, np.uint64)
            out[:, band] = simhash._remixed(np.full(1, band, np.uint64), simhash._P5)
            for row in range(rows):
                salt, factor = random.integers(0, 2**32, 2, dtype=np.uint32)
                least = np.minimum.reduceat((x ^ salt) * (factor | np.uint32(1)), at) if len(at) else x
                key = simhash._remixed(key * simhash._P1 ^ least, simhash._P4)
                sketch[doc[at], band * rows + row] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            out[doc[at], band] = key
    return out, sketch


class Gate:
    """Which pairs of rows sizes and sketches do not rule out."""

    def __init__(self, table: pa.Table, least: float):
        self.size = np.asarray(table["size"]).astype(np.int64)
        column = table["sketch"].combine_chunks() if isinstance(table["sketch"], pa.ChunkedArray) else table["sketch"]
        self.sketch = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(self.size), -1)
        n = self.sketch.shape[1]
        self.same, self.least = least * n - SIGMAS * (n * least * (1 - least)) ** 0.5, least

    def open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.size[a], self.size[b]
        out = np.minimum(x, y) >= self.least * np.maximum(x, y)
        at = np.flatnonzero(out)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            out[part] = (self.sketch[a[part]] == self.sketch[b[part]]).sum(1) >= self.same
        return out


def _printed(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, doc = distinct_shingles(*simhash._shingle_hashes(Words(batch["text"], lower=True), shingle))
            out = {c: batch[c] for c in batch.schema.names if c != "text"}
            out["id"] = pa.array(_set_keys(h, doc, batch.num_rows).view(np.int64))
            for c, salt in zip(COLUMNS, simhash._SALTS, strict=True):
                out[c] = pa.array(simhash._majority(simhash._remixed(h, salt), doc, batch.num_rows).view(np.int64))
            keys, sketch = band_keys(h, doc, batch.num_rows, bands, rows)
            out["size"] = pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int32))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * sketch.shape[1]
            out["sketch"] = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sketch))])
            out["keys"] = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    return run


def printed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, id (a hash of the shingle set), f0 .. f3, size and sketch of the set, and the keys of the bands."""
    fields = [T.StructField(c, T.LongType()) for c in ("text_key", "id", *COLUMNS)]
    fields += [T.StructField("size", T.IntegerType()), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text")).mapInArrow(tidy(_printed(shingle, bands, rows)), schema)


def _passes(bucket: np.ndarray, prints: np.ndarray, radius: int, done: np.ndarray, step: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows in bucket order, pairs of a bucket within the radius, some places apart at a time.

    A bucket whose rows all have one label in ``done``, which may be changed meanwhile, is left.
    """
    n, words64 = prints.shape
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, n))
    by_size = np.argsort(-sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 1]
    at, sizes = at[by_size], sizes[by_size]
    # rows of the largest buckets first: those still at work are always a prefix
    order = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    shift = 0
    while True:
        live = int(np.searchsorted(-sizes, -shift - 1, "right"))  # buckets with more than shift rows
        if not live:
            break
        sizes = sizes[:live]
        order = order[: sizes.sum()]
        now = done[order]
        begin = np.cumsum(sizes) - sizes
        stay = np.minimum.reduceat(now, begin) != np.maximum.reduceat(now, begin)
        order, sizes = order[np.repeat(stay, sizes)], sizes[stay]
        if not len(sizes):
            break
        group = np.repeat(np.arange(len(sizes)), sizes)
        planes = simhash._planes(prints[order], words64)
        for _ in range(step):
            shift += 1
            m = int(sizes[: np.searchsorted(-sizes, -shift, "left")].sum())
            if not m:
                break
            hit = simhash._compare(planes, group[:m], shift, radius, radius.bit_length())
            yield order[hit], order[hit + shift]


def candidate_pairs(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in bucket order: pairs to check, as row numbers a, b; and per row the least row of its group, or -1 where all its pairs are among those."""
    n = len(prints)
    label, done, dense = np.arange(n), np.arange(n), np.zeros(n, bool)
    a = b = np.zeros(0, np.int64)
    more_a, more_b, more = [], [], 0

    def thinned() -> None:
        nonlocal a, b
        x, y = np.concatenate([a[:0], *more_a]), np.concatenate([b[:0], *more_b])
        simhash._joined(label, x, y)
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        hot = np.bincount(label[a], minlength=n) > DENSE * np.bincount(label, minlength=n)
        hot[label[dense]] = True
        dense[:] = hot[label]
        done[dense] = label[dense]
        of = dense[a]
        x, y = a[of], b[of]
        near = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64) // 8
        rows = simhash._forest(np.arange(n), x, y, near)
        a, b = np.concatenate([a[~of], x[rows]]), np.concatenate([b[~of], y[rows]])

    for x, y in _passes(bucket, prints, radius, done):
        more_a.append(x), more_b.append(y)
        more += len(x)
        if more > n:
            thinned()
            more_a, more_b, more = [], [], 0
    thinned()
    return a, b, np.where(dense, label, -1)


def _out(a: np.ndarray, b: np.ndarray, group: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "of_group": pa.array(np.full(len(a), group))})


def _candidates(radius: int, least: float):
    def flush(table: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(table["id"])
        a, b, group = candidate_pairs(bucket, simhash._stacked(table, COLUMNS).view(np.uint64), radius)
        # the pairs of a group bring its rows' sets, and are checked with them
        keep = (group[a] >= 0) | Gate(table, least).open(a, b)
        a, b = a[keep], b[keep]
        yield _out(np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), False)
        at = np.flatnonzero(group >= 0)
        first = group[at]
        key = np.zeros(len(at), np.uint64)
        for c in ("key", "low", "high", "id"):
            key = simhash._remixed(key ^ np.asarray(table[c]).astype(np.int64)[first].view(np.uint64), simhash._P5)
        # groups that meet under one key would be compared as one: nothing is lost
        yield _out(ids[at], key.view(np.int64), True)

    return simhash._whole(["key", "low", "high"], flush)


def candidates(nodes: DataFrame, radius: int, least: float) -> DataFrame:
    """Pairs a > b to check; and, where of_group, rows a of the groups b that are to be compared further."""
    carried = [*COLUMNS, "size", "sketch"]
    banded = nodes.select("id", F.explode("keys").alias("key"))
    shared = written(banded.groupBy("key").count().filter("count > 1").select(F.col("key").alias("of_key"), F.ceil(F.col("count") / simhash.SPLIT).alias("slices")), "shared")
    # rows that meet no other are left here, before fingerprints and sketches move: those come to the rows that are left
    met = banded.join(shared.hint("shuffle_merge"), F.col("key") == F.col("of_key")).select(F.col("id").alias("met_id"), "key", "slices")
    sized = met.join(nodes.select("id", *carried).hint("shuffle_merge"), F.col("met_id") == F.col("id"))
    # slice s meets every slice t, as the unordered pair (s, t); a bucket of one slice has the pair (0, 0)
    dealt = sized.withColumn("s", F.pmod(F.xxhash64("id"), F.col("slices"))).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    dealt = dealt.filter("slices = 1 or s != t").select("id", *carried, "key", F.least("s", "t").cast("int").alias("low"), F.greatest("s", "t").cast("int").alias("high"))
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.repartition(count, "key", "low", "high").sortWithinPartitions("key", "low", "high", "id")
    return ready.mapInArrow(tidy(_candidates(radius, least)), "a long, b long, of_group boolean").distinct()


def alike_rows(ids: np.ndarray, label: np.ndarray, own: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between rows of different labels that join all rows of similarity ``least`` or more; where ``own`` differs, only across it.

    Rows already joined, by their labels or by links found here, are not linked again.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    ids, own, size, sets = ids[order], own[order], size[order], [sets[k] for k in order]
    label = np.unique(label[order], return_inverse=True)[1]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    common = np.bincount(codes) > 1
    # values of one row only are in no intersection
    kept = common[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(size)])]
    codes = codes[kept]
    marked, floor = np.zeros(len(common), np.int32), least * size
    across = len(np.unique(own)) > 1
    out_a, out_b = [ids[:0]], [ids[:0]]
    for k in range(len(ids)):
        # sizes ascend: each pair is met at its larger row
        low = int(np.searchsorted(size[:k], floor[k], "left"))
        other = label[low:k] != label[k]
        if across:
            other &= own[low:k] != own[k]
        if not other.any():
            continue
        mine = codes[ends[k] : ends[k + 1]]
        marked[mine] = 1
        sums = np.concatenate([[0], np.cumsum(marked[codes[ends[low] : ends[k]]])])
        marked[mine] = 0
        cut = ends[low : k + 1] - ends[low]
        both = sums[cut[1:]] - sums[cut[:-1]]
        hit = low + np.flatnonzero(other & (both >= least * (size[low:k] + size[k] - both)))
        if len(hit):
            found, first = np.unique(label[hit], return_index=True)
            out_a.append(np.full(len(first), ids[k])), out_b.append(ids[hit[first]])
            label[np.isin(label, found)] = label[k]
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.maximum(a, b), np.minimum(a, b)


def _block(least: float):
    def run(table: pa.Table) -> pa.Table:
        sets = [simhash.unpacked(x) for x in table["set"].to_pylist()]
        a, b = alike_rows(*(np.asarray(table[c]) for c in ("id", "root", "s")), sets, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def grouped_links(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a > b) of the rows (of, id, root, size) of each group ``of`` whose roots differ: all pairs of a group are compared by their sets, block by block."""
    n, values = F.count(F.lit(1)), F.sum("size")
    sized = rows.groupBy("of").agg(F.greatest(F.ceil(n / SLICE_ROWS), F.ceil(values / SLICE_VALUES), F.lit(1)).alias("slices"), F.min("root").alias("low"), F.max("root").alias("high"))
    apart = written(sized.filter("low != high").select(F.col("of").alias("open"), "slices"), "apart")
    own = F.pmod(F.xxhash64("id"), F.col("slices"))
    dealt = rows.join(apart.hint("shuffle_merge"), F.col("of") == F.col("open")).withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    dealt = dealt.select("of", "id", "root", "s", F.least("s", "t").alias("low"), F.greatest("s", "t").alias("high"))
    with_sets = dealt.join(sets.hint("shuffle_merge"), F.col("id") == F.col("set_id")).drop("set_id")
    return with_sets.groupBy("of", "low", "high").applyInArrow(_block(least), "a long, b long").distinct()


def _sets(ends: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """set_id and the packed set of the nodes among ``ends``."""
    asked = written(nodes.join(ends.hint("shuffle_merge"), F.col("id") == F.col("end"), "left_semi").select(F.col("id").alias("set_id"), "text_key"), "asked")
    keyed = docs.select(F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = keyed.mapInArrow(tidy(simhash._sieve(asked, "text_key")), keyed.schema)
    # one text a key is enough: rows that repeat it give the same set
    found = keyed.join(asked, F.col("key") == F.col("text_key")).select("set_id", "text").mapInArrow(tidy(simhash._shingle_sets(shingle)), "set_id long, set binary")
    return written(found.dropDuplicates(["set_id"]), "sets")


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose sets are that similar."""
    one, other = sets.withColumnsRenamed({"set_id": "id_a", "set": "set_a"}), sets.withColumnsRenamed({"set_id": "id_b", "set": "set_b"})
    both = pairs.select("a", "b").join(one.hint("shuffle_merge"), F.col("a") == F.col("id_a")).join(other.hint("shuffle_merge"), F.col("b") == F.col("id_b"))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(tidy(simhash._similar(least)), "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    """(id, root) of all nodes that a link joins; nodes: id, f0 .. f3, size, sketch, keys and text_key, that of some text with the set."""
    found = written(candidates(nodes, radius, least), "candidates")
    pairs, members = found.filter("not of_group").select("a", "b"), found.filter("of_group").select(F.col("a").alias("member"), F.col("b").alias("of"))
    # each row of a group has a link in its forest, so the sets of all rows of groups are among these
    sets = _sets(pairs.select(F.col("a").alias("end")).union(pairs.select(F.col("b").alias("end"))).distinct(), docs, nodes, shingle)
    roots = simhash.components(written(_checked(pairs, sets, least), "links"))
    rooted = members.join(roots.hint("shuffle_merge"), F.col("member") == F.col("id"), "left").select("member", "of", F.coalesce("root", "member").alias("root"))
    sized = rooted.join(nodes.select("id", "size").hint("shuffle_merge"), F.col("member") == F.col("id")).select("of", "id", "root", "size")
    new = written(grouped_links(written(sized, "members"), sets, least), "links")
    if new.isEmpty():
        return roots
    # rows and their roots stand for the links before
    return simhash.components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(new))


def near_copies(docs: DataFrame, shingle: int = 5, radius: int = 80, bands: int = 18, rows: int = 4, least_similarity: float = 0.8) -> DataFrame:
    """Per row doc_id, text_key, component_id and ``stays``; text_key is a hash of the text, and component_id the least doc_id among the documents
    that links join with it, itself included.

    Takes doc_id and text; other columns are ignored. Texts are lower-cased (A-Z) and cut into runs of ``shingle`` words; a shorter text is one
    shingle, null and empty texts have the empty set and are alike. Rows of null doc_id take part; they give no component id (null if alone).
    Of each component the rows of one doc_id and text stay: of the least doc_id (null last), then of the least text_key. So rows that repeat a
    doc_id are judged each by its own text, and rows that repeat both are all said to stay: ``one_each`` leaves one of them.
    """
    prints = written(printed(docs, shingle, bands, rows), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("text_key"))).alias("first")
    nodes = prints.groupBy("id").agg(first, *(F.min(c).alias(c) for c in COLUMNS), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    nodes = written(nodes.withColumn("text_key", F.col("first.text_key")), "nodes")
    found = links(docs, nodes, shingle, radius, least_similarity)
    rooted = nodes.join(found.withColumnRenamed("id", "node").hint("shuffle_merge"), F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    # written, as in ``simhash.components``: a component that holds many nodes can then be split in the join
    least = written(rooted.groupBy("root").agg(F.min("first").alias("stay")).withColumnRenamed("root", "of"), "least")
    named = written(rooted.join(least.hint("shuffle_merge"), F.col("root") == F.col("of")).select(F.col("id").alias("n_id"), "stay"), "named")
    stays = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("text_key") == F.col("stay.text_key"))
    return prints.join(named.hint("shuffle_merge"), F.col("id") == F.col("n_id")).select("doc_id", "text_key", F.col("stay.doc_id").alias("component_id"), stays.alias("stays"))


def one_each(docs: DataFrame, **near) -> DataFrame:
    """The rows, with all their columns, less near copies: of each component of ``near_copies`` one row stays.

    Which of several rows with that doc_id and text it is, where they differ in other columns, is not said.
    """
    found = written(near_copies(docs, **near), "copies")
    gone = written(found.filter("not stays").select("doc_id", "text_key").distinct(), "gone")
    again = written(found.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1"), "again")

    def same(rows: DataFrame, keys: DataFrame) -> Column:
        key = F.xxhash64(F.coalesce(rows["text"].cast("string"), F.lit("")))
        return rows["doc_id"].eqNullSafe(keys["doc_id"]) & (key == keys["text_key"])

    aside, maybe = _apart(docs, gone)
    left = aside.unionByName(maybe.join(gone.hint("shuffle_merge"), same(maybe, gone), "left_anti"))
    if again.isEmpty():
        return left
    aside, maybe = _apart(left, again)
    # texts of one key are equal, so the first of them is that of them all
    row = F.first(F.struct(*(maybe[c] for c in docs.columns))).alias("row")
    once = maybe.join(again.hint("shuffle_merge"), same(maybe, again)).groupBy(again["doc_id"], again["text_key"]).agg(row).select("row.*")
    return aside.unionByName(maybe.join(again.hint("shuffle_merge"), same(maybe, again), "left_anti")).unionByName(once)


def _apart(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are surely not among the keys (doc_id, text_key), which no join needs to move, and those that may be."""
    bits = simhash._sieve_bits(keys.select(F.xxhash64("doc_id", "text_key").alias("key")), "key")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return tuple(keyed.mapInArrow(tidy(simhash._sifted(bits, among)), keyed.schema).drop("key") for among in (False, True))
