"""Vectorised word handling on UTF-8 buffers inside Arrow tasks.

A word is a maximal run of bytes other than the six ASCII blanks; UTF-8 continuation bytes are never
blanks, so this equals the code point rule ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two independent codes of the bytes, for two independent hashes of a word.
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers["up"], _powers["down"] = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, r, np.uint64)])) if n else np.zeros(0, np.uint64) for r in (_R, _R_INV))
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False), np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function, which gives free memory back at its end: a Python worker stays alive for later tasks, beside the others of its executor."""

    @wraps(run)
    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return then_trim


class Words:
    """Words of the texts of a batch: byte ranges, document of each, and number of the first word of each document; ``blank`` says which bytes part them."""

    def __init__(self, column: pa.Array, lower: bool = False, blank: np.ndarray = BLANK):
        self.data, self.offsets = utf8(column)
        data, offsets = self.data, self.offsets
        if lower:
            data = self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.docs = len(offsets) - 1
        ink = ~blank[data]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = ink[cut]
        last[cut - 1] = ink[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self, which: int = 0) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[which][self.data] * up[:-1])])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, words: int, multiplier: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word, and hash, of each run of ``words`` words inside one document."""
        n = len(hashes) - words + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(hashes) - words + 1] == self.doc[words - 1 :])
        out = np.zeros(n, np.uint64)
        for k in range(words):
            out = out * np.uint64(multiplier) + hashes[k : k + n]
        return at, mix(out[at])

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (kept) words, each followed by one space; where each begins there, and where each document does."""
        starts, ends, doc = (self.starts, self.ends, self.doc) if keep is None else (self.starts[keep], self.ends[keep], self.doc[keep])
        size = ends - starts + 1
        out_at = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(starts - out_at[:-1], size) + np.arange(out_at[-1])
        if len(source):
            source[-1] = min(source[-1], len(self.data) - 1)
        buffer = self.data[source]
        buffer[out_at[1:] - 1] = 32
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.docs))]).astype(np.int64)
        return buffer, out_at, per_doc


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value, each deflated where that helps."""
    out = [np.array([len(arrays)], np.uint32).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = zlib.compress(raw, 1) if a.dtype.itemsize <= 2 else raw
        packed = len(small) < len(raw)
        code = a.dtype.str.encode().ljust(4)
        out += [code, np.array([packed, len(small) if packed else len(raw)], np.uint32).tobytes(), small if packed else raw]
    return b"".join(out)


def unpack(value: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int(np.frombuffer(value, np.uint32, 1)[0])):
        kind = value[at : at + 4].decode().strip()
        packed, size = map(int, np.frombuffer(value, np.uint32, 2, at + 4))
        raw = value[at + 12 : at + 12 + size]
        out.append(np.frombuffer(zlib.decompress(raw) if packed else raw, kind))
        at += 12 + size
    return out


def deltas(groups: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Differences of ascending positions that begin anew in each group; the least unsigned type that holds them."""
    d = positions.astype(np.int64).copy()
    d[1:] -= np.where(groups[1:] == groups[:-1], positions[:-1], 0)
    most = int(d.max(initial=0))
    return d.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)


def undo_deltas(groups: np.ndarray, d: np.ndarray) -> np.ndarray:
    if not len(d):
        return np.zeros(0, np.int64)
    total = np.cumsum(d.astype(np.int64))
    new = np.concatenate([[True], groups[1:] != groups[:-1]])
    base = (total - d)[new]
    return total - np.repeat(base, np.diff(np.append(np.flatnonzero(new), len(d))))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
