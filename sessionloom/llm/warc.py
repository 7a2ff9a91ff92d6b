"""WARC archives written and read back, with a capture index merged from locally sorted runs.

Writing: digests are grouped without the payloads; payloads are moved at most once, to learn which records are revisits.
Each task writes archives of bounded size (gzip members, one a record) as rows of a table in the shared folder.
Reading: a task sorts the captures of the archives it reads by URL key, timestamp, page and place, ``RUN_ROWS`` at a time: runs, written in packed
blocks. Where there are more than ``FAN_IN`` runs, groups of that many become one run each, level by level, so that a range of the last merge gets few long
pieces. In every merge the first keys of a bounded sample of blocks cut the index into key ranges by its size; blocks are cut there and dealt to their
ranges, and in each range a loser tree merges the runs, opening a block when its run comes to it. So the ranges one after another are the globally ordered
capture histories, and a task holds the packed blocks of one range and one open block a run. No two captures have one key, so a range can always be cut.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.shared import written

#: Payload bytes from which equal payloads become revisits; bytes of records gathered into one archive.
LEAST_REVISIT, ARCHIVE_BYTES = 100, 8 << 20
#: Captures of a packed block, of a run that a task sorts, and of a key range; a range has a block's captures or more of each run, on average.
BLOCK_ROWS, RUN_ROWS, RANGE_ROWS = 1024, 1 << 16, 1 << 18
#: Runs that are merged at once.
FAN_IN = 64
#: Blocks sampled a range to find where ranges begin, ranges at most, and characters of a sampled URL key: what the driver holds is bounded.
SAMPLED, MOST_RANGES, KEY_CHARS = 32, 4096, 256
#: Bytes that are inflated at once.
WINDOW = 64 << 10
CAPTURES = "url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, record_at long, record_size long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame) -> DataFrame:
    """The rows with digest and, for a revisit, refers_to: of equal payloads of LEAST_REVISIT bytes or more all but the least page_id.

    A row without a page_id revisits the least page_id; where no row of a payload has one, all are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = written(large.filter("copies > 1").select(F.col("digest").alias("of_digest"), "first"), "digests")
    return rows.join(shared, F.col("digest") == F.col("of_digest"), "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))).select("page_id", "url", "html", "digest", "refers_to")


def _one_line(text: str) -> str:
    """Header values hold no line ends; they and per cent signs are written per cent coded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _as_was(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has no payload; its length stands in an extension field."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, count()

        def archive() -> pa.RecordBatch:
            data = b"".join(held)
            held.clear()
            # archives of the same records have names of their own
            name = f"{hashlib.sha1(data).hexdigest()}-{TaskContext.get().partitionId()}-{next(number)}"
            return pa.RecordBatch.from_pydict({"archive": pa.array([name]), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for page_id, url, html, digest, refers_to, date in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "date")), strict=True):
                held.append(_gzip(record(page_id, url, html.encode(), digest, refers_to, date)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    size = 0
        if held:
            yield archive()

    return run


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, data): archives in the shared folder, each a series of gzip members.

    Takes page_id, url, html (null: empty). The capture date is not in the pages, so it is made from the page_id: so many
    seconds after 2024-01-01, for null and negative ids that moment.
    """
    second = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.greatest(F.coalesce("page_id", F.lit(0)), F.lit(0)), F.lit(10**10)))
    dated = planned(pages).withColumn("date", F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return written(dated.mapInArrow(_write(ARCHIVE_BYTES), "archive string, data binary"), "archives")


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then the rest, lower-cased; ``)`` alone for null."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").lower()
    host = re.match(r"[^/?#]*", plain)[0]
    return ",".join(reversed(host.split("."))) + ")" + plain[len(host) :]


def parse_record(data: bytes) -> dict:
    """Header fields, lower-cased, and ``body``, the payload after the HTTP header (for responses)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record that is cut off")
    fields["http"], _, fields["body"] = block.partition(b"\r\n\r\n")
    return fields


def _number(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


SCHEMA = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_at", pa.int64()), ("record_size", pa.int64())])
#: A block's run, its first key, how many captures it has, and they themselves.
BLOCKS = "run string, url_key string, timestamp string, no_page boolean, page_id long, archive string, record_at long, captures int, data binary"
KEY = ("url_key", "timestamp", "no_page", "page_id", "archive", "record_at")


def _key(row: tuple) -> tuple:
    """URL key, timestamp, page (null last), and the place of the record: the order of captures."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at``, inflated a window at a time, and its size."""
    z, out, to = zlib.decompressobj(31), [], at
    while not z.eof:
        if to >= len(data):
            raise ValueError("an archive that is cut off")
        out.append(z.decompress(data[to : to + WINDOW]))
        to = min(to + WINDOW, len(data))
    return b"".join(out), to - len(z.unused_data) - at


def _captures(archive: str, data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        inflated, size = _member(data, at)
        f = parse_record(inflated)
        said = f["warc-payload-digest"].removeprefix("sha256:")
        if f["warc-type"] == "response":
            n, digest, refers = len(f["body"]), hashlib.sha256(f["body"]).hexdigest(), None
            if digest != said:
                raise ValueError(f"payload of record {f['warc-record-id']} does not have its digest")
        else:
            n, digest, refers = int(f["http"].rpartition(b"Content-Length: ")[2]), said, _number(f["warc-refers-to"])
        url = f.get("warc-target-uri")
        url = None if url is None else _as_was(url)
        yield url_key(url), f["warc-date"], _number(f["warc-record-id"]), url, f["warc-type"], n, digest, refers, archive, at, size
        at += size


def _packed(run: str, rows: list[tuple]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA))
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    values = (run, *_key(rows[0]), len(rows), sink.getvalue().to_pybytes())
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)


def _opened(data: bytes) -> list[tuple]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _runs(run_rows: int, block_rows: int):
    """Captures of whole archives, sorted when they are ``run_rows`` or more; a run has the name of its first archive."""

    def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        name = rows[0][8]
        rows.sort(key=_key)
        for at in range(0, len(rows), block_rows):
            yield _packed(name, rows[at : at + block_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for archive, data in zip(batch["archive"].to_pylist(), batch["data"].to_pylist(), strict=True):
                held.extend(_captures(archive, data))
                if len(held) >= run_rows:
                    yield from packed(held)
                    held = []
        if held:
            yield from packed(held)

    return run


def _cut(bounds: list[tuple]):
    """Blocks, cut where a key range begins, with the number of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (name, data) in enumerate(zip(batch["run"].to_pylist(), batch["data"].to_pylist(), strict=True)):
                rows = _opened(data)
                keys = [_key(r) for r in rows]
                cuts = sorted({0, *(bisect_left(keys, b) for b in bounds[bisect_left(bounds, keys[0]) : bisect_left(bounds, keys[-1]) + 1]), len(rows)})
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(k, 1) if b - a == len(rows) else _packed(name, rows[a:b])
                    number = bisect_right(bounds, keys[a])
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *part.columns], ["range", *part.schema.names])

    return run


class LoserTree:
    """Merges k sorted runs: each inner node holds the loser of its match, the winner goes on; replacing a winner replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for run in reversed(range(self.k)):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.tree[node] < 0:  # the first to come waits here for its match
                self.tree[node] = run
                return
            if self._less(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[winner := self.tree[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _merge(block_rows: int, level: int | None = None):
    """Blocks in order of group, range and first key become the captures in order, range by range; or, at a level, the blocks of a run for each group."""

    def opened(blocks: list[bytes]) -> Iterator[tuple]:
        for data in blocks:
            for row in _opened(data):
                yield _key(row), row

    def batch_of(group: int, rows: list[tuple]) -> pa.RecordBatch:
        if level is not None:
            return _packed(f"level-{level}-{group}", rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    def merged(group: int, runs: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, row in LoserTree([opened(x) for x in runs.values()]):
            held.append(row)
            if len(held) == block_rows:
                yield batch_of(group, held)
                held = []
        if held:
            yield batch_of(group, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = (0, 0), {}
        for batch in batches:
            for group, number, name, data in zip(*(batch[c].to_pylist() for c in ("group", "range", "run", "data")), strict=True):
                if (group, number) != now:
                    yield from merged(now[0], runs)
                    now, runs = (group, number), {}
                runs.setdefault(name, []).append(data)
        yield from merged(now[0], runs)

    return run


def _bounds(runs: DataFrame, captures: int, merged: int) -> list[tuple]:
    """Where key ranges begin, for a merge of so many runs that have so many captures together."""
    ranges = min(-(-captures // max(RANGE_ROWS, merged * BLOCK_ROWS)), MOST_RANGES)
    if ranges <= 1:
        return []
    # a sample in proportion to the number of ranges, as for any range partitioning
    short = runs.select(F.substring("url_key", 1, KEY_CHARS).alias("url_key"), *KEY[1:])
    some = sorted(tuple(r) for r in short.orderBy(F.xxhash64("archive", "record_at"), *KEY).limit(SAMPLED * ranges).collect())
    return sorted({some[k * len(some) // ranges] for k in range(1, ranges)})


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs (BLOCKS) merged, level by level, until they are ``FAN_IN`` or fewer."""
    captures, n = runs.agg(F.coalesce(F.sum("captures"), F.lit(0)), F.count_distinct("run")).first()
    least, level = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    while n > FAN_IN:
        groups = -(-n // FAN_IN)
        bounds = _bounds(runs, captures // groups, FAN_IN)
        cut = runs.mapInArrow(_cut(bounds), f"range int, {BLOCKS}").withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
        parts = max(least, min(groups * (len(bounds) + 1), MOST_RANGES))
        dealt = cut.repartition(parts, "group", "range").sortWithinPartitions("group", "range", *KEY)
        runs = written(dealt.mapInArrow(_merge(BLOCK_ROWS, level), BLOCKS), "runs")
        n, level = groups, level + 1
    return runs


def read_archives(archives: DataFrame) -> DataFrame:
    """All captures in order of URL key, timestamp and page_id (null last): CAPTURES. Payloads of responses are digested anew and must agree."""
    # written, as finding the key ranges reads the runs once more: archives are to be read once
    runs = merged_runs(written(archives.mapInArrow(_runs(RUN_ROWS, BLOCK_ROWS), BLOCKS), "runs"))
    captures, n = runs.agg(F.coalesce(F.sum("captures"), F.lit(0)), F.count_distinct("run")).first()
    bounds = _bounds(runs, captures, n)
    cut = runs.mapInArrow(_cut(bounds), f"range int, {BLOCKS}").withColumn("group", F.lit(0))
    parts = max(len(bounds) + 1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut.repartitionByRange(parts, "range").sortWithinPartitions("range", *KEY)
    return ranged.mapInArrow(_merge(4 * BLOCK_ROWS), T.StructType.fromDDL(CAPTURES))
