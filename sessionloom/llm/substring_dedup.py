"""Exact substring dedup with fixed-block anchors.

Reference blocks are the non-overlapping runs of ``anchor`` words at word numbers 0, anchor, 2*anchor, ...
of every document. Every rolling run of ``anchor`` words of every document probes them. A repeat of
``window`` = 2*anchor - 1 words always holds one whole reference block, so each repeat has an anchor hit; the hits are
then extended: all ``window``-word runs around a hit are compared, by 64 bits of one hash and 32 of another that has word hashes of its own, and
runs that repeat and overlap join into maximal repeats.

Scale: text never goes to a group. A map chunk settles among its own documents what it can, so a passage held by a third of all documents
sends one representative a chunk. What it sends is addressed by its number of the word in the chunk (about six bytes a word, however many
buckets there are), and hits come back to the chunk, whose directory names the documents. From ``ONE_LEVEL`` buckets on entries
go by coarse buckets first, so that a chunk's parcels never become small. The document exchange is shared by both joins that need texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.bytetext import Words, chunks, deltas, pack, runs, tidy, undo_deltas, unpack
from sessionloom.llm.shared import parts_for

_PROBE, _WIDE, _NARROW = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407
#: Words that one map chunk compares among themselves before anything is sent.
CHUNK_WORDS = 900_000
#: Input bytes a bucket, buckets up to which chunks send straight to them, and bytes that are dealt anew at a time beyond that.
BUCKET_BYTES, ONE_LEVEL, RESPLIT_BYTES = 10 << 20, 16384, 16 << 20
_LOW = np.uint64(0xFFFFFFFF)
#: Kinds of rows: entries to be matched; words of a chunk that are hits; the documents of a chunk and their words.
OPEN, HITS, DIRECTORY = range(3)
ROUTED = "bucket int, kind int, chunk long, payload binary"
ADDRESSED = "chunk long, kind int, payload binary"
MARKS = "row_key long, marks binary"


class Chunk:
    """Some documents of a map task that are compared among themselves before anything is sent: words are numbered through the chunk."""

    def __init__(self, number: int, held: list[tuple]):
        self.id = np.array([TaskContext.get().partitionId() << 32 | number], np.uint64)
        self.held = held
        self.keys = np.concatenate([b["row_key"].to_numpy(zero_copy_only=False) for b, _ in held]).view(np.uint64)
        self.counts = np.concatenate([w.count for _, w in held]).astype(np.uint32)

    def each(self) -> Iterator[tuple[pa.RecordBatch, Words, int, int]]:
        """Batches, their words, and the number of the first document and word of each."""
        doc = word = 0
        for batch, w in self.held:
            yield batch, w, doc, word
            doc, word = doc + w.docs, word + len(w.starts)

    def directory(self, buckets: int) -> tuple[int, int, np.uint64, bytes]:
        return int(self.id[0] % np.uint64(buckets)), DIRECTORY, self.id[0], pack(self.keys, self.counts)

    def settled(self, word: np.ndarray, buckets: int) -> Iterator[tuple[int, int, np.uint64, bytes]]:
        if len(word):
            word = np.sort(word)
            yield int(self.id[0] % np.uint64(buckets)), HITS, self.id[0], pack(deltas(np.zeros(len(word)), word))


def _gathered(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[Chunk]:
    held, n, number = [], 0, 0
    for batch in chunks(batches, "text", 2 << 20):
        w = Words(batch["text"])
        held.append((batch, w))
        n += len(w.starts)
        if n >= words_each:
            yield Chunk(number, held)
            held, n, number = [], 0, number + 1
    if held:
        yield Chunk(number, held)


def _bucket(value: np.ndarray, coarse: int, fine: int) -> np.ndarray:
    """Coarse bucket by the upper half of a hash, fine bucket in it by the lower half."""
    return ((value >> np.uint64(32)) % np.uint64(coarse) * np.uint64(fine) + (value & _LOW) % np.uint64(fine)).astype(np.int64)


def _rows(rows: list[tuple[int, int, np.uint64, bytes]]) -> pa.RecordBatch:
    bucket, kind, chunk, payload = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(np.array(chunk, np.uint64).view(np.int64)), pa.array(payload, pa.binary())], ["bucket", "kind", "chunk", "payload"])


def _sent(bucket: np.ndarray, chunk: np.ndarray, word: np.ndarray, values: dict[str, np.ndarray]) -> Iterator[tuple[int, int, np.uint64, bytes]]:
    """Entries in chunk and word order, packed for each bucket: chunks, how many entries of each, gaps between words, values."""
    order = np.argsort(bucket, kind="stable")
    at = runs(bucket[order])
    for own in np.split(order, at[1:]) if len(at) else []:
        head = runs(chunk[own])
        count = np.diff(np.append(head, len(own))).astype(np.uint32)
        arrays = []
        for name, v in values.items():
            if name == "flag":
                arrays.append(np.packbits(v[own]))
            elif name == "id":
                base = v[own].min()
                away = (v[own].astype(np.uint64) - base.astype(np.uint64)).astype(np.uint64)
                arrays += [np.array([base], np.int64), away.astype(np.uint32) if away.max() <= _LOW else away]
            else:
                arrays.append(v[own])
        yield int(bucket[own[0]]), OPEN, np.uint64(0), pack(chunk[own][head], count, deltas(chunk[own], word[own]), *arrays)


def _opened(payloads: list[bytes], names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Chunk, word and values of all entries, payload after payload."""
    chunk, word, values = [], [], {n: [] for n in names}
    for payload in payloads:
        owner, count, gaps, *rest = unpack(payload)
        group = np.repeat(np.arange(len(owner)), count)
        chunk.append(owner[group]), word.append(undo_deltas(group, gaps))
        for n in names:
            v = rest.pop(0)
            if n == "flag":
                v = np.unpackbits(v)[: len(group)]
            elif n == "id":
                v = (v.astype(np.uint64) + rest.pop(0).astype(np.uint64)).view(np.int64)
            values[n].append(v)
    return np.concatenate(chunk), np.concatenate(word), {n: np.concatenate(v) for n, v in values.items()}


ANCHOR, WINDOW = ("low", "flag"), ("id", "wide", "narrow")


def _resplit(names: tuple[str, ...], fine: int):
    """Entries of coarse buckets, in bucket order, are dealt to the fine ones, many payloads at a time."""

    def dealt(payloads: list[bytes], coarse: int) -> list[tuple]:
        chunk, word, values = _opened(payloads, names)
        low = values["low"].astype(np.uint64) if "low" in values else values["wide"] & _LOW
        order = np.lexsort((word, chunk))
        bucket = coarse * fine + (low % np.uint64(fine)).astype(np.int64)
        return list(_sent(bucket[order], chunk[order], word[order], {n: v[order] for n, v in values.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for b, kind, chunk, payload in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "chunk", "payload")), strict=True):
                if kind != OPEN:
                    yield _rows([(b, kind, np.int64(chunk).astype(np.uint64), payload)])
                    continue
                if held and (b // fine != now or size > RESPLIT_BYTES):
                    yield _rows(dealt(held, now))
                    held, size = [], 0
                now = b // fine
                held.append(payload)
                size += len(payload)
        if held:
            yield _rows(dealt(held, now))

    return run


def _probes(anchor: int, coarse: int, fine: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _gathered(batches, CHUNK_WORDS):
            doc, word, value, aligned = [], [], [], []
            for _, w, first_doc, first_word in c.each():
                at, h = w.windows(anchor, _PROBE, w.hashes())
                doc.append((w.doc[at] + first_doc).astype(np.int32))
                word.append((at + first_word).astype(np.int32))
                aligned.append((at - w.first[w.doc[at]]) % anchor == 0)
                value.append(h)
            doc, word, value, aligned = map(np.concatenate, (doc, word, value, aligned))
            c.held.clear()
            order = np.argsort(value, kind="stable")
            at = runs(value[order])
            if not len(at):
                continue
            size = np.diff(np.append(at, len(order)))
            first = np.repeat(doc[order][at], size)
            other = doc[order] != first
            shared = np.repeat(np.logical_or.reduceat(other, at), size)
            anchored = np.repeat(np.logical_or.reduceat(aligned[order], at), size)
            # of entries of this chunk that are equal, those of one document go on: entries of two chunks are of two documents
            go, flag = np.zeros(len(order), bool), np.zeros(len(order), np.uint8)
            go[order[~other]], flag[order] = True, anchored
            go = np.flatnonzero(go)
            h = value[go]
            sent = _sent(_bucket(h, coarse, fine) // fine * fine, np.repeat(c.id, len(go)), word[go], {"low": (h & _LOW).astype(np.uint32), "flag": flag[go]})
            yield _rows([c.directory(coarse * fine), *c.settled(word[order[shared]], coarse * fine), *sent])

    return run


def _addressed(table: pa.Table, kind: np.ndarray, chunk: np.ndarray, word: np.ndarray) -> pa.Table:
    """What was settled before, and the hits found here, by the chunk that they came from."""
    order = np.lexsort((word, chunk))
    chunk, word = chunk[order], word[order]
    at = runs(chunk)
    hits = [(0, HITS, chunk[own[0]], pack(deltas(chunk[own], word[own]))) for own in np.split(np.arange(len(chunk)), at[1:])] if len(at) else []
    found = pa.Table.from_batches([_rows(hits)])
    return pa.concat_tables([table.filter(pa.array(kind != OPEN)).select(found.column_names).cast(found.schema), found]).select(["chunk", "kind", "payload"])


def _matched(names: tuple[str, ...], hits):
    """Per bucket the entries that ``hits`` finds among the open ones."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table["kind"])
        chunk, word = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if (kind == OPEN).any():
            chunk, word, values = _opened([p for p, k in zip(table["payload"].to_pylist(), kind, strict=True) if k == OPEN], names)
            hit = hits(chunk, **values)
            chunk, word = chunk[hit], word[hit]
        return _addressed(table, kind, chunk, word)

    return run


def _shared_anchors(chunk: np.ndarray, low: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Anchors that another document has too, at least one of them a reference block."""
    order = np.argsort(low, kind="stable")
    at = runs(low[order])
    size = np.diff(np.append(at, len(order)))
    mixed = np.logical_or.reduceat(chunk[order] != np.repeat(chunk[order][at], size), at)
    return order[np.repeat(mixed & np.logical_or.reduceat(flag[order] > 0, at), size)]


def _later_windows(chunk: np.ndarray, id: np.ndarray, wide: np.ndarray, narrow: np.ndarray) -> np.ndarray:  # noqa: A002
    """Windows that begin in a document of smaller id too."""
    order = np.lexsort((narrow, wide))
    at = runs(_pair_code(wide[order], narrow[order]))
    return order[id[order] > np.repeat(np.minimum.reduceat(id[order], at), np.diff(np.append(at, len(order))))]


def _gather(table: pa.Table) -> pa.Table:
    """The marks of the documents of a chunk."""
    kind, payload = np.asarray(table["kind"]), table["payload"].to_pylist()
    found = [undo_deltas(np.zeros(len(gaps)), gaps) for p, k in zip(payload, kind, strict=True) if k == HITS for gaps in unpack(p)]
    none = pa.table({"row_key": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
    if not found:
        return none
    keys, counts = unpack(payload[int(np.flatnonzero(kind == DIRECTORY)[0])])
    word = np.unique(np.concatenate(found))
    first = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    doc = np.searchsorted(first, word, "right") - 1
    at = runs(doc)
    marks = [pack(deltas(doc[own], word[own] - first[doc[own]])) for own in np.split(np.arange(len(doc)), at[1:])]
    return pa.table({"row_key": pa.array(keys[doc[at]].view(np.int64)), "marks": pa.array(marks, pa.binary())})


def _spread(w: Words, marks: list, back: int, forth: int) -> np.ndarray:
    """Words from ``back`` before to ``forth`` after any marked position of their document."""
    change = np.zeros(len(w.starts) + 1, np.int64)
    for d, mark in enumerate(marks):
        if mark:
            gaps = unpack(mark)[0]
            at = undo_deltas(np.zeros(len(gaps)), gaps)
            np.add.at(change, w.first[d] + np.maximum(at - back, 0), 1)
            np.add.at(change, w.first[d] + np.minimum(at + forth + 1, w.count[d]), -1)
    return np.cumsum(change[:-1]) > 0


def _pair_code(wide: np.ndarray, narrow: np.ndarray) -> np.ndarray:
    """A number for each run of equal pairs in sorted order."""
    new = np.concatenate([[False], (wide[1:] != wide[:-1]) | (narrow[1:] != narrow[:-1])])
    return np.cumsum(new)


def _candidates(anchor: int, window: int, coarse: int, fine: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _gathered(batches, CHUNK_WORDS):
            ids, word, wide, narrow = [], [], [], []
            for batch, w, _, first_word in c.each():
                near = _spread(w, batch["marks"].to_pylist(), window - anchor, 0)
                at, h = w.windows(window, _WIDE, w.hashes())
                _, h2 = w.windows(window, _NARROW, w.hashes(1))
                keep = near[at]
                at = at[keep]
                ids.append(batch["doc_id"].to_numpy(zero_copy_only=False)[w.doc[at]])
                word.append((at + first_word).astype(np.int32))
                wide.append(h[keep])
                narrow.append((h2[keep] >> np.uint64(32)).astype(np.uint32))
            ids, word, wide, narrow = map(np.concatenate, (ids, word, wide, narrow))
            c.held.clear()
            if not len(word):
                continue
            order = np.lexsort((narrow, wide))
            at = runs(_pair_code(wide[order], narrow[order]))
            size = np.diff(np.append(at, len(order)))
            later = ids[order] > np.repeat(np.minimum.reduceat(ids[order], at), size)
            go = np.sort(order[~later])
            sent = _sent(_bucket(wide[go], coarse, fine) // fine * fine, np.repeat(c.id, len(go)), word[go], {"id": ids[go], "wide": wide[go], "narrow": narrow[go]})
            yield _rows([c.directory(coarse * fine), *c.settled(word[order[later]], coarse * fine), *sent])

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            w = Words(batch["text"])
            keep = ~_spread(w, batch["marks"].to_pylist(), 0, window - 1)
            buffer, at, per_doc = w.joined(keep)
            cuts = at[per_doc]
            raw = buffer.tobytes()
            texts = [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kept = np.diff(per_doc)
            columns = {"doc_id": batch["doc_id"], "n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(w.count - kept, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
            if with_text:
                columns["kept_text"] = pa.array([t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also begins in a document of smaller id.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256 and, with
    ``with_text``, kept_text (kept words joined by one space), one row per input row. A null text has no words. A row with
    null doc_id keeps all its words and removes none elsewhere. Rows that repeat a doc_id never remove
    words from each other. ``window`` is odd, 3 at least.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    anchor = (window + 1) // 2
    coarse, fine = parts_for(docs, BUCKET_BYTES), 1
    if coarse > ONE_LEVEL:
        coarse = fine = int(np.ceil(np.sqrt(coarse)))
    # columns of the right type stay as they are: an alias would hide that both joins below need the same exchange of the texts
    kinds = dict(docs.dtypes)
    rows = docs.select(*(c if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    known = rows.filter("doc_id is not null")

    def matched(routed: DataFrame, names: tuple[str, ...], hits, key: str) -> DataFrame:
        if fine > 1:
            routed = routed.repartition(coarse, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_resplit(names, fine)), ROUTED)
        found = routed.groupBy("bucket").applyInArrow(_matched(names, hits), ADDRESSED)
        marks = found.groupBy("chunk").applyInArrow(_gather, MARKS)
        # rows that repeat id and text have equal marks, from more than one chunk perhaps
        return marks.groupBy(F.col("row_key").alias(key)).agg(F.first("marks").alias("marks"))

    anchors = matched(known.select("row_key", "text").mapInArrow(tidy(_probes(anchor, coarse, fine)), ROUTED), ANCHOR, _shared_anchors, "anchor_key")
    around = known.hint("shuffle_merge").join(anchors.hint("shuffle_merge"), known["row_key"] == anchors["anchor_key"]).select("doc_id", "row_key", "text", "marks")
    repeats = matched(around.mapInArrow(tidy(_candidates(anchor, window, coarse, fine)), ROUTED), WINDOW, _later_windows, "repeat_key")
    joined = known.hint("shuffle_merge").join(repeats.hint("shuffle_merge"), known["row_key"] == repeats["repeat_key"], "left").select("doc_id", "text", "marks")
    alone = rows.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("binary").alias("marks"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.unionByName(alone).mapInArrow(tidy(_kept(window, with_text)), schema)
