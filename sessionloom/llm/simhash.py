"""SimHash near-dedup: fingerprints of word shingles, bit-sliced comparison, connected components.

Fingerprints are compared inside buckets. With ``bands=None`` the fingerprint is cut into radius + c pieces and two
fingerprints within the radius agree on c pieces at least (pigeonhole); each choice of c pieces is a key, so every link is found. More
pieces give more and longer keys: c follows the number of fingerprints (``keys``), so that buckets stay small. With ``bands=(n, width)``
the buckets are n disjoint pieces of ``width`` bits, which for long fingerprints trades a little recall for smaller buckets.

In a bucket the fingerprints lie as vertical bit planes; one pass compares every row with the row ``shift`` places on,
adding up differing bits in carry-save counters, 64 pairs to a machine word. Words whose pairs all exceed the radius
are abandoned; a bucket whose rows are all connected by sure links is left. What leaves a bucket is a spanning forest of its nearest links,
not its pairs. Buckets over ``SPLIT`` rows are dealt to several tasks as pairs of slices.

``alike`` finds near copies by the similarity of the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.bytetext import Words, chunks, tidy
from sessionloom.llm.shared import written

#: Rows of a bucket that one task compares; larger buckets are split into pairs of slices.
SPLIT = 8192
#: What an entry of a row in a bucket costs, in comparisons of two fingerprints.
ENTRY = 48
#: Rows that are compared at once.
BATCH_ROWS = 1 << 17

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SALTS = [np.uint64(x) for x in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer: all ranges of a length advance together."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded.data, strides=(1,))
    seed = np.uint64(seed)
    order = np.argsort(sizes.astype(np.uint16), kind="stable") if sizes.max() < 65536 else np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], sizes[order][1:] != sizes[order][:-1]]))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[a:b]
            at, n = starts[own], int(sizes[own[0]])
            off = 0
            if n >= 32:
                acc = [np.full(len(own), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while off + 32 <= n:
                    for k in range(4):
                        acc[k] = _rotl(acc[k] + eight[at + off + 8 * k] * _P2, 31) * _P1
                    off += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for k in range(4):
                    h = (h ^ (_rotl(acc[k] * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(own), seed + _P5, np.uint64)
            h = h + np.uint64(n)
            while off + 8 <= n:
                h = _rotl(h ^ (_rotl(eight[at + off] * _P2, 31) * _P1), 27) * _P1 + _P4
                off += 8
            if off + 4 <= n:
                h = _rotl(h ^ (four[at + off].astype(np.uint64) * _P1), 23) * _P2 + _P3
                off += 4
            while off < n:
                h = _rotl(h ^ (padded[at + off].astype(np.uint64) * _P5), 11) * _P1
                off += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[own] = h ^ (h >> np.uint64(32))
    return out


def _remixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    if not salt:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ salt) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _majority(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document, bit k is 1 where over half of its values have it; values come in document order."""
    out = np.zeros(docs, np.uint64)
    if not len(h):
        return out
    count = np.bincount(doc, minlength=docs)
    begin = np.concatenate([[0], np.cumsum(count)])
    # byte lanes hold sums of 255 values at most, so each document is summed in pieces of 255
    piece_of = np.repeat(np.arange(docs), -(-count // 255))
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(-(-count // 255)) - (-(-count // 255)), -(-count // 255))
    piece_at = begin[piece_of] + 255 * nth
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & lanes, piece_at)
        each = sums[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)
        at = np.flatnonzero(np.concatenate([[True], piece_of[1:] != piece_of[:-1]]))
        total = np.add.reduceat(each.astype(np.int64), at, axis=0)
        has = piece_of[at]
        bits = (2 * total > count[has][:, None]).astype(np.uint64)
        for lane in range(8):
            out[has] |= bits[:, lane] << np.uint64(8 * lane + k)
    return out


def _shingle_hashes(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and its document, in order; a document of few words is one shingle."""
    buffer, at, _ = w.joined()
    most = max(0, len(w.starts) - shingle + 1)
    first = np.arange(most)
    first = first[w.doc[first] == w.doc[first + shingle - 1]]
    few = w.first[:-1][(w.count > 0) & (w.count < shingle)].astype(np.int64)
    size = np.concatenate([np.full(len(first), shingle), w.count[w.doc[few]] if len(few) else few])
    first = np.concatenate([first, few])
    order = np.argsort(first, kind="stable")
    first, size = first[order], size[order]
    return xxh64(buffer, at[first], at[first + size] - 1 - at[first]), w.doc[first]


def _fingerprints(shingle: int, words64: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, doc = _shingle_hashes(Words(batch["text"], lower=True), shingle)
            out = {c: batch[c] for c in batch.schema.names if c != "text"}
            for k in range(words64):
                out[f"f{k}"] = pa.array(_majority(_remixed(h, _SALTS[k]), doc, batch.num_rows).view(np.int64))
            yield pa.RecordBatch.from_pydict(out)

    return run


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64) -> DataFrame:
    """doc_id, text_key (a hash of the text) and the words f0, f1, ... (long) of the fingerprint of each row's whole text; null counts as empty, empty gives zeros."""
    words64 = bits // 64
    if bits % 64 or not 1 <= words64 <= len(_SALTS):
        raise ValueError("bits must be 64, 128, 192 or 256")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), *(T.StructField(f"f{k}", T.LongType()) for k in range(words64))])
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text")).mapInArrow(tidy(_fingerprints(shingle, words64)), schema)


# ---- comparison inside buckets


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Add links to the components in ``label`` (least row number of each), in place; the numbers of links that form a forest with those before."""
    used = []
    number = np.arange(len(a))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, number, la, lb = a[apart], b[apart], number[apart], la[apart], lb[apart]
        if not len(a):
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        # every component that is not the least of its links hooks on by one of them
        roots, first = np.unique(high, return_index=True)
        label[roots] = low[first]
        used.append(number[first])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return np.concatenate(used) if used else np.zeros(0, np.int64)


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Numbers of the links of a spanning forest that takes lower levels first; ``label`` becomes its components."""
    return np.concatenate([rows[_joined(label, a[rows], b[rows])] for rows in (np.flatnonzero(level == v) for v in np.unique(level))] or [np.zeros(0, np.int64)])


#: Levels between the sure radius and the radius, in which the forest of links is built.
LEVELS = 4


def linked_rows(bucket: np.ndarray, prints: np.ndarray, radius: int, sure: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in bucket order: a spanning forest of their links, as row numbers a, b and level (0: at most ``sure`` bits differ).

    prints: one row of 64-bit words a fingerprint. Pairs of one bucket at ``radius`` or fewer differing bits are links.
    """
    n, words64 = prints.shape
    sure = radius if sure is None else sure
    label = np.arange(n)
    empty = np.zeros(0, np.int64)
    kept = (empty, empty, empty)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else empty
    size = np.diff(np.append(at, n))
    by_size = np.argsort(-size, kind="stable")
    by_size = by_size[size[by_size] > 1]
    if not len(by_size):
        return kept
    # rows of the largest buckets first: those still at work are always a prefix
    order = np.repeat(at[by_size], size[by_size]) + np.arange(size[by_size].sum()) - np.repeat(np.cumsum(size[by_size]) - size[by_size], size[by_size])
    group = np.repeat(np.arange(len(by_size)), size[by_size])
    sizes = size[by_size]
    depth = radius.bit_length()
    shift = 0
    while True:
        live = int(np.searchsorted(-sizes, -shift - 1, "right"))  # buckets with more than shift rows
        if not live:
            break
        m = int(np.cumsum(sizes)[live - 1])
        planes = _planes(prints[order[:m]], words64)
        a_all, b_all = [], []
        until = shift + 64
        while shift < until:
            shift += 1
            live = int(np.searchsorted(-sizes, -shift, "left"))
            if not live:
                break
            m = int(np.cumsum(sizes)[live - 1])
            hit = _compare(planes, group[:m], shift, radius, depth)
            a_all.append(order[hit]), b_all.append(order[hit + shift])
        a, b = np.concatenate(a_all or [empty]), np.concatenate(b_all or [empty])
        far = np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64)
        level = np.where(far <= sure, 0, 1 + (far - sure - 1) * LEVELS // max(1, radius - sure))
        a, b, level = (np.concatenate([x, y]) for x, y in zip(kept, (a, b, level), strict=True))
        label = np.arange(n)
        rows = _forest(label, a, b, level)
        kept = a[rows], b[rows], level[rows]
        # buckets that sure links connect wholly are done
        certain = np.arange(n)
        _joined(certain, *(x[kept[2] == 0] for x in kept[:2]))
        live = int(np.searchsorted(-sizes, -shift - 1, "right"))
        if not live:
            break
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[:live]
        m = int(np.cumsum(sizes)[live - 1])
        now = certain[order[:m]]
        stay = np.minimum.reduceat(now, begin) != np.maximum.reduceat(now, begin)
        order, sizes = order[:m][np.repeat(stay, sizes[:live])], sizes[:live][stay]
        group = np.repeat(np.arange(len(sizes)), sizes)
    return kept


def _planes(prints: np.ndarray, words64: int) -> np.ndarray:
    """Bit planes over the rows, as 64-bit words with one spare word at the end."""
    n = len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * words64), axis=1, bitorder="little")
    width = -(-n // 64) + 1
    out = np.zeros((64 * words64, width * 8), np.uint8)
    out[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    return out.view(np.uint64)


def _compare(planes: np.ndarray, group: np.ndarray, shift: int, radius: int, depth: int) -> np.ndarray:
    """Rows i whose fingerprint is within the radius of row i + shift of the same bucket."""
    n = len(group) - shift
    if n <= 0:
        return np.zeros(0, np.int64)
    same = np.packbits(group[:n] == group[shift:], bitorder="little")
    width = -(-n // 64)
    valid = np.zeros(width * 8, np.uint8)
    valid[: len(same)] = same
    valid = valid.view(np.uint64)
    word, bit = shift >> 6, np.uint64(shift & 63)
    active = np.flatnonzero(valid)
    open_pairs = valid[active]
    counters = [np.zeros(len(active), np.uint64) for _ in range(depth)]
    over = np.zeros(len(active), np.uint64)
    last = planes.shape[1] - 1
    for k in range(len(planes)):
        p = planes[k]
        moved = p[np.minimum(active + word, last)]
        if bit:
            moved = (moved >> bit) | (p[np.minimum(active + word + 1, last)] << (np.uint64(64) - bit))
        carry = p[active] ^ moved
        for c in counters:
            c ^= carry
            carry = carry & ~c
        over |= carry
        if k % 8 == 7 and k >= 15:
            over |= _exceeds(counters, radius)
            alive = np.flatnonzero(open_pairs & ~over)
            if len(alive) < 0.75 * len(active):
                active, open_pairs, over = active[alive], open_pairs[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(active):
                    return np.zeros(0, np.int64)
    near = open_pairs & ~(over | _exceeds(counters, radius))
    rows = np.flatnonzero(near)
    found = np.unpackbits(near[rows].view(np.uint8), bitorder="little").reshape(len(rows), 64)
    r, b = np.nonzero(found)
    return active[rows[r]] * 64 + b


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Pairs whose counter is above the radius, by a bitwise comparison from the top."""
    above = np.zeros_like(counters[0])
    equal = ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _links(columns: list[str], radius: int, sure: int | None):
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        key = np.stack([table[c].to_numpy() for c in ("band", "part", "low", "high")], 1).astype(np.int64)
        bucket = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
        prints = np.stack([table[c].to_numpy() for c in columns], 1).view(np.uint64)
        a, b, level = linked_rows(bucket, prints, radius, sure)
        ids = table["id"].to_numpy()
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(ids[a], ids[b])), "b": pa.array(np.minimum(ids[a], ids[b])), "level": pa.array(level, pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            # whole buckets only: the last bucket of what is held may go on in the next batch
            if n >= BATCH_ROWS and batch.num_rows:
                key = [batch[c][0].as_py() for c in ("band", "part", "low", "high")]
                tail = held[-1]
                same = np.ones(tail.num_rows, bool)
                for c, v in zip(("band", "part", "low", "high"), key, strict=True):
                    same &= np.asarray(tail[c]) == v
                cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
                if cut:
                    held[-1] = tail.slice(0, cut)
                    yield from flush(held)
                    held = [tail.slice(cut)] if cut < tail.num_rows else []
                    n = sum(x.num_rows for x in held)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from flush(held)

    return run


def keys(bits: int, radius: int, bands: tuple[int, int] | None, rows: int) -> list[list[tuple[int, int]]]:
    """For each key of ``rows`` fingerprints the first bit and width of the pieces that it is made of.

    Of radius + c pieces c agree. A row has one entry for each choice of c pieces and is compared with the rows that share one, about
    rows / 2 ** bits of a key by chance; c is that of least cost, and all give the same links.
    """
    if bands:
        n, width = bands
        return [[(k * (bits // n), width)] for k in range(n)]

    def cost(c: int) -> float:
        chosen = c * (bits // (radius + c))
        return comb(radius + c, c) * (ENTRY + rows / 2 ** (chosen + 1)) if c == 1 or chosen <= 56 else inf

    c = min(range(1, 6), key=cost)
    n = radius + c
    cuts = [k * bits // n for k in range(n + 1)]
    return [list(x) for x in combinations([(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], c)]


def _piece(columns: list[str], first: int, width: int) -> F.Column:
    """Bits first .. first + width - 1 of the fingerprint as a long."""
    word, bit = divmod(first, 64)
    low = F.shiftrightunsigned(F.col(columns[word]), bit)
    got = min(width, 64 - bit)
    low = low.bitwiseAND(F.lit((1 << got) - 1 if got < 64 else -1))
    if got == width:
        return low
    return low.bitwiseOR(F.shiftleft(F.col(columns[word + 1]).bitwiseAND(F.lit((1 << (width - got)) - 1)), got))


def _key(columns: list[str], chosen: list[tuple[int, int]]) -> F.Column:
    """The chosen pieces, one after the other, as a long."""
    out = _piece(columns, *chosen[0])
    for first, width in chosen[1:]:
        out = F.shiftleft(out, width).bitwiseOR(_piece(columns, first, width))
    return out


def bucketed(prints: DataFrame, bits: int, radius: int, bands: tuple[int, int] | None = None, rows: int | None = None) -> DataFrame:
    """Each fingerprint once a key: id, f0, ..., band (the number of the key) and part (its value)."""
    columns = [f"f{k}" for k in range(bits // 64)]
    chosen = keys(bits, radius, bands, prints.count() if rows is None and not bands else rows or 0)
    return prints.select("id", *columns, F.posexplode(F.array(*[_key(columns, x) for x in chosen])).alias("band", "part"))


def near_links(prints: DataFrame, bits: int, radius: int, bands: tuple[int, int] | None = None, sure: int | None = None, rows: int | None = None) -> DataFrame:
    """Spanning links (a > b, level) of ids whose fingerprints share a key and differ in ``radius`` bits or fewer; level 0 has at most ``sure``.

    prints: ``id`` (any distinct longs) and the words f0, ... of distinct fingerprints, ``rows`` of them (counted if not given).
    """
    columns = [f"f{k}" for k in range(bits // 64)]
    banded = bucketed(prints, bits, radius, bands, rows)
    size = banded.groupBy("band", "part").count().filter("count > 1").withColumn("slices", F.ceil(F.col("count") / SPLIT)).select(F.col("band").alias("of_band"), F.col("part").alias("of_part"), "slices")
    sized = banded.join(size.hint("shuffle_merge"), (F.col("band") == F.col("of_band")) & (F.col("part") == F.col("of_part")))
    own = F.pmod(F.xxhash64("id"), F.col("slices"))
    # slice s meets every slice t, as the unordered pair (s, t); a bucket of one slice has the pair (0, 0)
    dealt = sized.withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    dealt = dealt.filter("slices = 1 or s != t").select("id", *columns, "band", "part", F.least("s", "t").alias("low"), F.greatest("s", "t").alias("high"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.repartition(parts, "band", "part", "low", "high").sortWithinPartitions("band", "part", "low", "high", "id")
    return ready.mapInArrow(tidy(_links(columns, radius, sure)), "a long, b long, level int").distinct()


def _shingle_sets(shingle: int):
    """Hashes of each text's distinct shingles, ascending, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, doc = _shingle_hashes(Words(batch["text"], lower=True), shingle)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = [np.unique(h[a:b] >> np.uint64(24)).astype("<u8") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            # five bytes of each are enough to tell the shingles of two texts apart
            packed = [x.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for x in sets]
            yield pa.RecordBatch.from_pydict({"set_id": batch["set_id"], "set": pa.array(packed, pa.binary())})

    return run


def unpacked(x: bytes) -> np.ndarray:
    """The values of a packed set."""
    wide = np.zeros((len(x) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True):
                both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                keep.append(both >= least * ((len(x) + len(y)) // 5 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bits of the sieve through which texts go before they are moved: a fixed size, 1 MB.
SIEVE_BITS = 1 << 23


def _sieve_bits(keys: DataFrame, column: str) -> np.ndarray:
    """The bits of the sieve that the keys set, 64 a word."""
    slot = F.pmod(F.col(column), F.lit(SIEVE_BITS))
    words = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits")).collect()
    table = np.zeros(SIEVE_BITS // 64, np.int64)
    for r in words:  # SIEVE_BITS / 64 rows at most
        table[r["word"]] = r["bits"]
    return table.view(np.uint64)


def _sifted(table: np.ndarray, among: bool = True):
    """Lets through the rows whose ``key`` may be among the keys of the sieve; with ``among`` false the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.mod(batch["key"].to_numpy(zero_copy_only=False), SIEVE_BITS)
            yield batch.filter(pa.array((table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool) == among))

    return run


def _sieve(keys: DataFrame, column: str):
    """Lets through the rows whose ``key`` may be among the keys. It only saves moving texts: too many keys let all rows through, and the join decides."""
    return _sifted(_sieve_bits(keys, column))


def _stacked(table: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([np.asarray(table[c]) for c in columns], 1)


def _whole(keys: list[str], flush: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]):
    """Task function over rows sorted by the keys: ``flush`` gets tables of whole buckets and the bucket of each row."""

    def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        key = _stacked(table, keys).astype(np.int64)
        yield from flush(table, np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= BATCH_ROWS:
                # the last bucket of what is held may go on in this batch
                key = np.concatenate([_stacked(held[-1], keys), _stacked(batch.slice(0, 1), keys)]).astype(np.int64)
                other = np.flatnonzero((key[:-1] != key[-1]).any(1))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    tail = held.pop()
                    yield from flushed([*held, tail.slice(0, cut)])
                    held = [tail.slice(cut)] if cut < tail.num_rows else []
                    n = sum(x.num_rows for x in held)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from flushed(held)

    return run


def _stars(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The components of these links as stars: each id but the least of its component, with that least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(ids))
    _joined(label, at[: len(a)], at[len(a) :])
    own = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_pydict({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[label[own]], pa.int64())})


def _stars_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield from _stars(*_stacked(pa.Table.from_batches(held), ["a", "b"]).T)
            held, n = [], 0
    if n:
        yield from _stars(*_stacked(pa.Table.from_batches(held), ["a", "b"]).T)


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """(id, root): the least id in each linked id's component.

    Each round every id of a link gets the least id that its neighbours lead to, then links that share an id are joined where they meet: in each task,
    shuffled by their greater id, and in each task again. A task leaves an id one link to a lesser id for ``BATCH_ROWS`` links, so no id is the
    greater of many. It ends when nothing changes: each id then has one link, to an id that has none.
    """
    count = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(pairs: DataFrame) -> DataFrame:
        met = pairs.mapInArrow(tidy(_stars_held), "a long, b long").repartition(count, "a").sortWithinPartitions("a")
        return written(met.mapInArrow(tidy(_whole(["a"], lambda table, _: _stars(*_stacked(table, ["a", "b"]).T))), "a long, b long"), what)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    found = joined(links.select("a", "b"))
    before = state(found)
    while before[0]:
        # written, so that both sides of the join are plain exchanges and a star's hot centre can be split
        least = written(found.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of"), what)
        found = joined(found.join(least.hint("shuffle_merge"), F.col("b") == F.col("of"), "left").select("a", F.coalesce("least", "b").alias("b")))
        now = state(found)
        if now == before:
            break
        before = now
    return found.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 64, radius: int = 4, bands: tuple[int, int] | None = None) -> DataFrame:
    """Each row's fingerprint words f0, ... and ``component_id``, the least doc_id among the documents it is linked with, itself included.

    Takes doc_id and text; other columns are ignored. Texts are lower-cased (A-Z) and cut into runs of ``shingle`` words;
    a shorter text is one shingle, a null or empty text has the fingerprint zero and links like any other. Equal
    fingerprints are one node, so copies cost nothing. Rows of null doc_id take part; they give no component id of
    their own (null if alone). Links of ``radius`` or fewer bits count.
    """
    columns = [f"f{k}" for k in range(bits // 64)]
    prints = written(fingerprints(docs, shingle, bits), "fingerprints")
    nodes = written(prints.groupBy(*columns).agg(F.min("doc_id").alias("least_doc")).withColumn("id", F.xxhash64(*columns) if bits > 64 else F.col("f0")), "nodes")
    links = near_links(nodes.select("id", *columns), bits, radius, bands)
    found = components(links.select("a", "b"))
    rooted = nodes.join(found.withColumnRenamed("id", "node").hint("shuffle_merge"), F.col("id") == F.col("node"), "left").select(*columns, "least_doc", F.coalesce("root", "id").alias("root"))
    # written, as in ``components``: a component that holds many fingerprints can then be split in the join
    least = written(rooted.groupBy("root").agg(F.min("least_doc").alias("component_id")).withColumnRenamed("root", "of"), "least")
    named = written(rooted.join(least.hint("shuffle_merge"), F.col("root") == F.col("of")).select(*(F.col(c).alias(f"n_{c}") for c in columns), "component_id"), "named")
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) == F.col(f"n_{c}"))
    return prints.join(named.hint("shuffle_merge"), same).select("doc_id", *columns, "component_id")


def hex64(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
