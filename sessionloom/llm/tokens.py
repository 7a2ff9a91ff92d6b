"""Token ids of whole texts by a public word-level BPE vocabulary, many texts at a time.

Pre-tokens are found for all texts of a batch at once, on arrays, and every distinct one is encoded by the
tokenizer once for each Python worker. This covers texts of U+0000 to U+00FF without special token strings, where normal form C
changes nothing and lower-casing is a table; any other text goes to the tokenizer whole. The pre-token rule is that of the
vocabulary file: contractions, runs of letters, single digits, runs of anything else but blanks.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sessionloom.llm.bytetext import _BYTE_CODES, mix, powers, utf8

#: Distinct pre-tokens that a worker remembers; beyond it begins anew.
REMEMBERED = 400_000
#: Pre-tokens that are encoded at once.
ENCODED = 2048
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
_CLASS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *(set(range(0xC0, 0x100)) - {0xD7, 0xF7})]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x41, 0x5B), *(set(range(0xC0, 0xDF)) - {0xD7})]] += 32


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes ascending
        self.sizes, self.at, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Place of each distinct pre-token (hashes ascending) in the tables; new ones are encoded. Arrays take a third of a dict's memory."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        there = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        there[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~there)
        number = np.empty(len(hashes), np.int64)
        number[there] = self.place[at[there]]
        if len(new):
            # few at a time: an encoding takes about a kilobyte until its ids are taken out
            got = [np.array(e.ids, np.uint32) for k in range(0, len(new), ENCODED) for e in self.tokenizer.encode_batch_fast([text_of(x) for x in new[k : k + ENCODED].tolist()], add_special_tokens=False)]
            size = np.array([len(x) for x in got], np.int32)
            number[new] = np.arange(len(self.hashes), len(self.hashes) + len(new))
            self.place = np.insert(self.place, at[new], number[new])
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.sizes = np.concatenate([self.sizes, size])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
            self.ids = np.concatenate([self.ids, *got])
        return number

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and n + 1 offsets of the texts among them."""
        data, offsets = utf8(column)
        docs = len(offsets) - 1
        doc_of_odd = np.searchsorted(offsets, np.flatnonzero(data >= 0xC4), "right") - 1
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) else np.zeros(0, np.int64)
        odd = np.zeros(docs, bool)
        odd[doc_of_odd] = True
        odd[np.searchsorted(offsets, special, "right") - 1] = True
        plain_ids, plain_count = self._plain(data, offsets, odd)
        if not odd.any():
            return plain_ids, np.concatenate([[0], np.cumsum(plain_count)])
        # one at a time is as fast here, and holds the offsets of one text only
        others = {int(d): np.array(self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for d in np.flatnonzero(odd)}
        cuts = np.concatenate([[0], np.cumsum(plain_count)])
        parts = [others[d] if d in others else plain_ids[cuts[d] : cuts[d + 1]] for d in range(docs)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(offsets) - 1
        length = np.where(odd, 0, np.diff(offsets))
        if odd.any():
            data = data[np.repeat(~odd, np.diff(offsets))]
        offsets = np.concatenate([[0], np.cumsum(length)])
        lead = (data == 0xC2) | (data == 0xC3)
        points = data.copy()
        points[np.flatnonzero(data == 0xC3) + 1] += 0x40
        points = _LOWER[points[~lead]]
        offsets = offsets - np.concatenate([[0], np.cumsum(lead)])[offsets]
        n = len(points)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        kind = _CLASS[points]
        begins = np.zeros(n + 1, bool)
        begins[offsets[:-1]] = True
        begins = begins[:n]
        before = np.concatenate([[_SPACE], kind[:-1]])
        before[begins] = _SPACE
        start = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
        quote = np.flatnonzero((points == 0x27) & start)
        if len(quote):
            end_of_doc = offsets[np.searchsorted(offsets, quote, "right")]
            padded = np.concatenate([points, np.zeros(2, np.uint8)])
            one, two = padded[quote + 1], padded[quote + 2]
            size = np.where((quote + 1 < end_of_doc) & np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
            pair = one.astype(np.int64) * 256 + two
            size = np.where((quote + 2 < end_of_doc) & np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]), 3, size)
            hit, size, end_of_doc = quote[size > 0], size[size > 0], end_of_doc[size > 0]
            start[hit + 1] = False
            after = (hit + size)[(hit + size) < end_of_doc]
            start[after] = kind[after] != _SPACE
        bound = np.flatnonzero(start | (kind == _SPACE) | begins)
        starts = np.flatnonzero(start)
        ends = np.append(bound, n)[np.searchsorted(bound, starts, "right")]
        doc = np.searchsorted(offsets, starts, "right") - 1
        up, down = powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[0][points] * up[:-1])])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = points.tobytes()
        number = self._numbers(distinct, lambda k: raw[starts[first[k]] : ends[first[k]]].decode("latin-1"))[inverse]
        size = self.sizes[number].astype(np.int64)
        out_at = np.cumsum(size) - size
        source = np.repeat(self.at[number] - out_at, size) + np.arange(int(size.sum()))
        return self.ids[source], np.bincount(doc, weights=size, minlength=docs).astype(np.int64)


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One a worker and path."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
