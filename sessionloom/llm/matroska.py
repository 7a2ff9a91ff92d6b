"""Media columns in Matroska form: texts stored as 8-bit sample tracks, and containers parsed into packet tables.

``mux`` writes a container for each row; ``packets`` parses containers (variable-length EBML elements, clusters, simple blocks and
block groups with every kind of lacing, cues) into one row a frame with its timestamp, track and byte range; ``demux`` reads
the sample bytes back through those byte ranges and computes features. Every row stands for itself: no shuffle, and
memory is bounded by the batch's size.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.bytetext import chunks, tidy

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: What ends an element of unknown size: another of its own level or above.
_TOP = {SEGMENT, EBML}
_SEGMENT_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

#: Samples a frame, frames a block, blocks a cluster; samples a second; nanoseconds a tick.
FRAME, PER_BLOCK, PER_CLUSTER, RATE, TICK = 576, 8, 16, 8000, 1_000_000
_FRAME_TICKS = FRAME * 1000 // RATE

PACKETS = "track int, time long, duration long, byte_start long, byte_size int, lacing int, keyframe boolean, cluster_at long, cued boolean"


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A number as EBML data size; the value of all ones is left to mean unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(x: int, body: bytes) -> bytes:
    return _id(x) + vint(len(body)) + body


def _uint(x: int, n: int) -> bytes:
    return element(x, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(x: int, v: float) -> bytes:
    return element(x, np.array(v, ">f8").tobytes())


_HEAD = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, _float(SAMPLING, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def laced(frames: list[bytes], kind: int) -> bytes:
    """Frame sizes and data of a block; kind 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == 3:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            d = n - before
            width = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux_payload(payload: bytes) -> bytes:
    """A container with one track of 8-bit samples; the payload is whole frames."""
    frames = len(payload) // FRAME
    info = element(INFO, _uint(SCALE, TICK) + element(MUXING_APP, b"sessionloom") + element(WRITING_APP, b"sessionloom") + _float(DURATION, float(frames * _FRAME_TICKS)))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for c in range(0, frames, PER_BLOCK * PER_CLUSTER):
        time = c * _FRAME_TICKS
        body = [_uint(CLUSTER_TIME, time)]
        for b in range(c, min(frames, c + PER_BLOCK * PER_CLUSTER), PER_BLOCK):
            n = min(PER_BLOCK, frames - b)
            head = b"\x81" + ((b - c) * _FRAME_TICKS).to_bytes(2, "big") + (b"\x84" + bytes([n - 1]) if n > 1 else b"\x80")
            body.append(element(SIMPLE_BLOCK, head + payload[b * FRAME : (b + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_size(data: bytes, at: int) -> tuple[int | None, int]:
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return None if value == (1 << 7 * width) - 1 else value, at + width


def _frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    if kind == 0:
        return [end - at], at
    number, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(number - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == 3 and number > 1:
        first, at = _read_size(data, at)
        sizes.append(first or 0)
        for _ in range(number - 2):
            width = 9 - data[at].bit_length()
            raw, at = _read_size(data, at)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - (1 << 7 * width - 1) + 1)
    elif kind == 2:
        if (end - at) % number:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // number] * number, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    return sizes, at


def parse(data: bytes) -> tuple[list[tuple], dict]:
    """Packets (fields of PACKETS) and what the headers and cues say. Raises ValueError on a damaged container."""
    try:
        return _parsed(data)
    except IndexError as e:
        raise ValueError("a container that is cut off") from e


def _parsed(data: bytes) -> tuple[list[tuple], dict]:
    packets: list[tuple] = []
    facts: dict = {"scale": TICK, "clusters": 0, "blocks": 0, "cues": [], "segment_at": 0, "codec": "", "duration": 0.0}
    ends: list[tuple[int, int]] = []  # (end, id) of open masters
    at, cluster_at, cluster_time = 0, 0, 0
    group: list | None = None
    size_of_data = len(data)
    while at < size_of_data:
        while ends and at >= ends[-1][0]:
            if ends.pop()[1] == BLOCK_GROUP:
                group = None
        begin = at
        x, at = _read_id(data, at)
        size, at = _read_size(data, at)
        if size is not None and at + size > size_of_data:
            raise ValueError(f"element {x:X} at byte {begin} exceeds the data")
        if x in _TOP or x in _SEGMENT_LEVEL:  # what has an unknown size ends here
            while ends and (ends[-1][1] in (_SEGMENT_LEVEL | {BLOCK_GROUP}) or x in _TOP):
                ends.pop()
        if x in _MASTERS:
            ends.append((size_of_data if size is None else at + size, x))
            if x == SEGMENT:
                facts["segment_at"] = at
            elif x == CLUSTER:
                cluster_at, cluster_time = begin, 0
                facts["clusters"] += 1
            elif x == BLOCK_GROUP:
                group = [len(packets), 0]
            elif x == CUE_POINT:
                facts["cues"].append([0, 0, 0])
            continue
        if size is None:
            raise ValueError(f"element {x:X} of unknown size")
        end = at + size
        if x == CLUSTER_TIME:
            cluster_time = int.from_bytes(data[at:end], "big")
        elif x in (SIMPLE_BLOCK, BLOCK):
            track, p = _read_size(data, at)
            time = cluster_time + int.from_bytes(data[p : p + 2], "big", signed=True)
            flags = data[p + 2]
            kind = flags >> 1 & 3
            sizes, p = _frame_sizes(data, p + 3, end, kind)
            facts["blocks"] += 1
            key = x == BLOCK or bool(flags & 0x80)
            for n in sizes:
                packets.append((track, time, 0, p, n, kind, key, cluster_at))
                p += n
        elif x == BLOCK_DURATION and group:
            each = int.from_bytes(data[at:end], "big") // max(1, len(packets) - group[0])
            for k in range(group[0], len(packets)):
                packets[k] = (packets[k][0], packets[k][1] + (k - group[0]) * each, each, *packets[k][3:])
        elif x == SCALE:
            facts["scale"] = int.from_bytes(data[at:end], "big")
        elif x == CODEC_ID:
            facts["codec"] = data[at:end].decode("ascii", "replace")
        elif x == DURATION:
            facts["duration"] = float(np.frombuffer(data[at:end], ">f8" if size == 8 else ">f4")[0])
        elif x in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and facts["cues"]:
            facts["cues"][-1][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(x)] = int.from_bytes(data[at:end], "big")
        at = end
    cued = {c[2] + facts["segment_at"] for c in facts["cues"]}
    # frames of a laced block follow each other: without a block duration, by the samples that they hold
    out, before = [], None
    for p in packets:
        laced_on = before is not None and p[5] and p[1] == before[0] and p[7] == before[2] and not p[2]
        step = before[1] + before[3] if laced_on else p[1]
        duration = p[2] or (p[4] * 1_000_000_000 // RATE // facts["scale"] if facts["codec"] == "A_PCM/INT/LIT" else 0)
        out.append((p[0], step, duration, *p[3:], p[7] in cued))
        before = (p[1], step, p[7], duration)
    return out, facts


def padded(text: bytes) -> bytes:
    """The payload: bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * ((-len(text)) % FRAME if text else FRAME)


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        texts = [(t or "").encode() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([mux_payload(padded(t)) for t in texts], pa.binary())})


def mux(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, a container of the whole text (UTF-8, null counts as empty) as 8-bit samples, one row an input row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(_mux), schema)


def packets(media: DataFrame) -> DataFrame:
    """One row a frame of each row's container: doc_id, then the fields of PACKETS; times in ticks of the container. A null container has none."""
    schema = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType), *T.StructType.fromDDL(PACKETS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields[1:]]
        for batch in chunks(batches, "media"):
            row, found = [], []
            for k, data in enumerate(batch["media"].to_pylist()):
                own = parse(data)[0] if data else []
                row += [k] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(row, pa.int64())), **{n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}})

    return media.select("doc_id", "media").mapInArrow(run, schema)


def features(payload: np.ndarray, found: list[tuple], facts: dict) -> str:
    """Features of the sample bytes and the container, as JSON with sorted keys."""
    if not len(payload):  # a container without frames
        payload = np.zeros(1, np.uint8)
    share = np.bincount(payload, minlength=256)
    p = share[share > 0] / len(payload)
    middle = payload >= 128
    return json.dumps({
        "blocks": facts["blocks"], "clusters": facts["clusters"], "cues": len(facts["cues"]), "frames": len(found),
        "duration_ms": (found[-1][1] + found[-1][2]) * facts["scale"] // 1_000_000 if found else 0,
        "crossings": int(np.count_nonzero(middle[1:] != middle[:-1])), "entropy": round(float(-(p * np.log2(p)).sum()), 4), "mean": round(float(payload.mean()), 4), "peak": int(payload.max()),
    }, sort_keys=True)


def _demux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "media"):
        out: list[tuple] = []
        for data in batch["media"].to_pylist():
            if data is None:
                out.append((None,) * 6)
                continue
            found, facts = parse(data)
            view = memoryview(data)
            payload = b"".join(view[p[3] : p[3] + p[4]] for p in found if p[0] == 1)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(np.frombuffer(payload, np.uint8), found, facts)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], **{n: pa.array(c, t) for (n, t), c in zip({"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}.items(), columns, strict=True)}})


def demux(media: DataFrame) -> DataFrame:
    """What the stored bytes of each container hold, read back through its packets' byte ranges; of a null container nothing is known."""
    schema = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType), *T.StructType.fromDDL("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields])
    return media.mapInArrow(tidy(_demux), schema)
