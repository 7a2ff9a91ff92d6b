"""The operators on small fixtures, against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionloom.llm import matroska, mih, mixing, packing, pii, quality, queries, simhash, substring_dedup, urlfilter, warc

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(WORD, text or "")


def passage(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, 5000, n))


SHARED = passage(1, 20)
TEXTS = [
    (1, passage(2, 40) + " " + SHARED + " " + passage(3, 30)),
    (2, SHARED + "\n" + passage(4, 25)),
    (3, None),
    (4, ""),
    (5, "one two"),
    (6, passage(2, 40) + " " + SHARED + " " + passage(3, 30)),
    (6, passage(2, 40) + " " + SHARED + " " + passage(3, 30)),
    (6, "other words with the same number"),
    (7, "É ß 日本 \t " + passage(5, 9000)),
    (8, "word " * 500),
    (None, SHARED),
    (None, None),
    (9, " \n\t "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}", 5) for k, (i, t) in enumerate(TEXTS)]
    # columns whose names operators use themselves
    return spark.createDataFrame(rows, DOCS).withColumns({"row_key": F.lit(1), "size": F.lit("x"), "base": F.lit(2), "marks": F.lit(3), "c0": F.lit(4)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def removed(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("one_level", [3, 2])
def test_substring_dedup_by_levels(spark, monkeypatch, one_level):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "ONE_LEVEL", one_level)
    monkeypatch.setattr(substring_dedup, "RESPLIT_BYTES", 300)
    r = np.random.default_rng(5)
    rows = [(int(x), " ".join(f"v{x}" for x in r.integers(0, 3, 90)) + " " + SHARED) for x in r.permutation(70)] + [(3, SHARED), (3, SHARED), (200, SHARED)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 13, with_text=False).collect()
    assert sorted(tuple(r) for r in got) == sorted(removed(rows, 13))


def test_what_substring_dedup_sends_grows_with_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.xxhash64("doc_id").alias("row_key"), "text").coalesce(2)
    sent = {}
    for buckets in (4, 400):
        rows = docs.mapInArrow(substring_dedup._probes(7, buckets, 1), substring_dedup.ROUTED)
        sent[buckets] = rows.agg(F.sum(F.length("payload"))).first()[0]
    assert sent[400] < 1.25 * sent[4]


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(docs, none, window):
    key = lambda x: (x[0] is None, *(str(y) for y in x))
    got = substring_dedup.remove_repeats(docs, window).collect()
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(removed(TEXTS, window), key=key)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.remove_repeats(none, window).count() == 0


def test_substring_dedup_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 50)
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"v{x}" for x in r.integers(0, 3, 60))) for k in range(40)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 7, with_text=False).collect()
    assert sorted(tuple(r) for r in got) == sorted(removed(rows, 7))


def test_matroska(docs, none):
    media = matroska.mux(docs)
    got = matroska.demux(media).collect()
    want = sorted(hashlib.sha256(matroska.padded((t or "").encode())).hexdigest() for _, t in TEXTS)
    assert sorted(r.payload_sha256 for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[4].payload_bytes == 576 and by[4].n_bytes == 0 and by[3].feature == by[4].feature
    frames = matroska.packets(media).filter("doc_id = 7").orderBy("time").collect()
    assert sum(f.byte_size for f in frames) == by[7].payload_bytes and [f.time for f in frames] == [72 * k for k in range(len(frames))]
    assert matroska.demux(matroska.mux(none)).count() == 0 and matroska.packets(matroska.mux(none)).count() == 0


def test_matroska_damaged_and_null(spark):
    data = matroska.mux_payload(matroska.padded(b"some text " * 200))
    for cut in range(1, len(data), 7):
        try:
            found, _ = matroska.parse(data[:cut])
        except ValueError:
            continue
        assert all(p[3] + p[4] <= cut for p in found)
    df = spark.createDataFrame([(1, 5, None), (2, 10, bytearray(data))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in matroska.demux(df).collect()}
    assert got[1].payload_sha256 is None and got[1].media_bytes is None and got[2].media_bytes == len(data)


def test_op2_columns(spark):
    got = {r.doc_id: r for r in queries.op2_matroska_media(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = (r.text or "").encode()
        payload = text + b"\xff" * ((-len(text)) % 576 if text else 576)
        media = matroska.mux_payload(payload)
        want = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.media_bytes, g.media_sha256) == want and g.feature


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_matroska_lacing(kind):
    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d" * 699]
    if kind == 2:
        frames = [f[:10] for f in frames]
    block = matroska.element(matroska.BLOCK, b"\x81\x00\x05" + bytes([kind << 1]) + matroska.laced(frames, kind))
    group = matroska.element(matroska.BLOCK_GROUP, block + matroska._uint(matroska.BLOCK_DURATION, 40))
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + matroska._uint(matroska.CLUSTER_TIME, 100) + group
    data = matroska._HEAD + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska._TRACKS + cluster + cluster
    found, facts = matroska.parse(data)
    assert [data[p[3] : p[3] + p[4]] for p in found] == frames * 2 and [p[1] for p in found][:4] == [105, 115, 125, 135] and facts["clusters"] == 2
    with pytest.raises(ValueError):
        matroska.parse(data[:-1])


def test_mixing(docs, none):
    got = mixing.mix(docs, block_words=16)
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(r.taken <= 2 * r.size for r in rows)
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t in TEXTS)
    by = {}
    for r in rows:
        size, target, taken = by.get(r.source, (0, r.target, 0))
        by[r.source] = size + r.size, target, taken + r.taken
    for size, target, taken in by.values():
        assert abs(taken - target) <= 1
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(s for s, _, _ in by.values()))
    key = lambda rs: sorted(map(str, map(tuple, rs)))
    assert key(mixing.mix(docs.repartition(5), block_words=16).collect()) == key(rows)
    assert all((r.first_shard is None) == (r.taken == 0) and (r.first_shard or 0) <= (r.last_shard or 0) for r in rows)
    texts = mixing.mix(docs, block_words=16, with_text=True).collect()
    assert all(len(words(r.taken_text)) == r.taken for r in texts) and key((r.doc_id, r.size, r.taken) for r in texts) == key((r.doc_id, r.size, r.taken) for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mix(none, with_text=True).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 400)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    caps, weights, total = {"a": 20, "b": 2000, "c": 800, None: 200}, {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * 1510
    done = {}
    while True:
        left, w = total - sum(done.values()), sum(v for k, v in weights.items() if k not in done)
        over = {k: caps[k] for k, v in weights.items() if k not in done and left * v / w > caps[k]}
        if not over:
            break
        done |= over
    assert got == pytest.approx(done | {k: left * v / w for k, v in weights.items() if k not in done})


def test_shards_draw_their_sources(spark):
    debts = spark.createDataFrame([(0, 30000), (1, 9000), (2, 1000), (3, 0)], "source_rank int, slots long")
    share = np.array([30000, 9000, 1000]) / 40000
    drawn = np.zeros((400, 3))
    for r in mixing.drawn_counts(debts, 100, 5).collect():
        drawn[r.shard, r.source_rank] = r.drawn
    assert (drawn.sum(1) == 100).all()
    # means and variances of 400 multinomial draws of 100
    assert np.abs(drawn.mean(0) - 100 * share).max() < 4 * np.sqrt(100 * 0.25 / 400)
    assert drawn.var(0) == pytest.approx(100 * share * (1 - share), rel=0.35)
    taken, mixed = {}, np.zeros((400, 3))
    for r in mixing.shard_segments(debts, 100, 5).collect():
        taken.setdefault(r.source_rank, []).append((r.first, r.number))
        mixed[r.shard, r.source_rank] += r.number
    # each source's numbers are all taken, once; shards stay full, and most counts stay as they were drawn
    for rank, n in ((0, 30000), (1, 9000), (2, 1000)):
        at = 0
        for first, number in sorted(taken[rank]):
            assert first == at
            at += number
        assert at == n
    assert (mixed.sum(1) == 100).all() and (mixed != drawn).sum() <= 0.1 * drawn.size
    assert mixing.shard_segments(debts.filter("slots = 0"), 100, 5).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 300, 5000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_slots_take_each_block_once_an_epoch(spark):
    targets = spark.createDataFrame([("a", 0, 1000, 1700.0), ("b", 1, 90, 45.0)], "source string, source_rank int, source_size long, target double")
    rows = mixing.mix_slots(targets, 16, 8, 1).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and len({(r.source_rank, r.epoch, r.block) for r in rows}) == len(rows)
    assert sum(r.words for r in rows if r.source_rank == 0) == 1700 and sum(r.words for r in rows if r.source_rank == 1) == 45
    last = -(-len(rows) // 8) - 1
    assert {(r.shard, r.slot) for r in rows} == {(k // 8, k % 8) for k in range(len(rows))} and max(r.shard for r in rows) == last


def test_nearest(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=16)], "x") for k in range(400)]
    rows += [(1000, rows[3][1], "x"), (1001, [0.0] * 16, "x"), (1002, None, "x"), (1003, [float("nan")] + [1.0] * 15, "x"), (1004, [None] + [1.0] * 15, "x"), (1005, [1.0] * 3, "x"), (None, rows[4][1], "x"), (20, rows[20][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = mih.nearest(df, df.filter("vec_id % 20 = 0"), k=10).collect()
    usable = [(i, np.array(v)) for i, v, _ in rows if i is not None and i not in (1001, 1002, 1003, 1004, 1005)]
    ids, x = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    hits = n = 0
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        own = x[ids == q][0]
        other = ids != q
        score = (own[None] * x[other]).sum(1)
        best = ids[other][np.lexsort((ids[other], -score))[:10]]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(float(own @ x[ids == r.vec_id][0]), abs=1e-12) for r in mine)
        hits, n = hits + len({r.vec_id for r in mine} & set(best.tolist())), n + 10
    assert hits / n >= 0.9
    few = mih.nearest(df.filter("vec_id < 5"), df.filter("vec_id = 0")).collect()
    assert len(few) == 4
    assert mih.nearest(df.filter("vec_id = 1001"), df.filter("vec_id = 0")).count() == 0


def test_nearest_of_outliers(spark):
    # a dense cluster sets the radius; the queries far from it have k rows too
    r = np.random.default_rng(8)
    dense = np.eye(16)[0] * 10 + r.normal(size=(600, 16)) * 0.05
    x = np.concatenate([dense, r.normal(size=(6, 16)), -dense[:2]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mih.nearest(df, df.filter("vec_id % 20 = 0 or vec_id >= 600"), k=20).collect()
    by = {q: sorted(r.rank for r in got if r.query_id == q) for q in [*range(0, 600, 20), *range(600, 608)]}
    assert all(v == list(range(1, 21)) for v in by.values())
    best = [r.vec_id for r in got if r.query_id == 606 and r.rank == 1]
    assert best == [int(np.argsort(-np.where(np.arange(608) == 606, -np.inf, x @ x[606]))[0])]
    for n in (12, 43):
        few = mih.nearest(df.filter(f"vec_id >= {608 - n}"), df.filter("vec_id >= 600"), k=20).collect()
        assert {q: sum(r.query_id == q for r in few) for q in range(600, 608)} == dict.fromkeys(range(600, 608), min(20, n - 1))


@pytest.mark.parametrize("cell_rows", [32768, 100])
def test_probing_finds_every_code_in_the_pigeonhole_radius(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(mih, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(mih, "CELL_QUERIES", cell_rows)
    r = np.random.default_rng(2)
    code = r.integers(0, 2**64, (500, 1), dtype=np.uint64)
    code[250:] = code[:250] ^ np.uint64(1) << r.integers(0, 64, (250, 1)).astype(np.uint64)
    df = spark.createDataFrame([(k, [int(x)]) for k, x in enumerate(code.view(np.int64)[:, 0])], "id long, code array<long>")
    far = mih.distances(code[:20], code)
    for near in (0, 2, 7):
        certain = 8 * (near + 1) - 1
        plan = mih.Plan(np.zeros((4, 64)), 8, 8, near, certain, 64, 1.0, 1.0)
        got = {(x.q, x.r) for x in mih.probed(df, 500, df.filter("id < 20"), plan, 500).collect()}
        assert got == {(int(q), int(n)) for q, n in zip(*np.nonzero(far <= certain), strict=True)}


def test_equal_vectors_and_crowded_radii(spark, monkeypatch):
    # a third of the rows is one vector, another third lies close together; queries in either get whole lists
    monkeypatch.setattr(mih, "WIDE", 40)
    r = np.random.default_rng(12)
    x = r.normal(size=(900, 16))
    x[:300], x[300:600] = x[0], x[300] + 0.01 * r.normal(size=(300, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mih.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    hits = 0
    for q in range(0, 900, 20):
        score = (x[q][None] * x).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20].tolist()
        mine = [y.vec_id for y in sorted((y for y in got if y.query_id == q), key=lambda y: y.rank)]
        hits += len(set(mine) & set(best))
        assert len(mine) == 20 and (q >= 300 or mine == best)
    assert hits >= 0.95 * 20 * 45


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids, all_of = np.array(sorted(x)), np.stack([x[k] for k in sorted(x)])
    got = {}
    for r in queries.op4_multi_index_hashing(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = np.where(ids == q, -np.inf, (x[q][None] * all_of).sum(1))
        hits += len(got[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert {len(v) for v in got.values()} == {20} and hits >= 0.95 * 20 * (ids % 20 == 0).sum()


def print_of(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(docs, none):
    got = simhash.fingerprints(docs.filter("doc_id is not null"), 4).select("doc_id", simhash.hex64("f0").alias("p")).collect()
    assert sorted((r.doc_id, r.p) for r in got) == sorted((i, f"{print_of(t, 4):016x}") for i, t in TEXTS if i is not None)
    assert simhash.near_duplicates(none, 4).count() == 0


def test_xxh64():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, sizes = np.arange(150), np.arange(150) + 1
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes, strict=True)]
    assert simhash.xxh64(data, starts, sizes).tolist() == want


def linked(ids, prints, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("split", [8192, 20])
def test_links_and_components(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = np.random.default_rng(7)
    base = [int(x) for x in r.integers(0, 2**63, 30, dtype=np.uint64)]
    prints = []
    for k in range(300):  # chains: each differs from one before by a few bits
        p = base[k] if k < 30 else prints[int(r.integers(0, k))]
        for b in r.integers(0, 64, int(r.integers(0, 8))):
            p ^= 1 << int(b)
        prints.append(p)
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p, p) for p in signed], "id long, f0 long")
    got = {r.id: r.root for r in simhash.components(simhash.near_links(df, 64, 4)).collect()}
    want = linked(signed, prints, 4)
    assert [got.get(i, i) for i in signed] == want


def test_near_duplicates_of_long_prints(spark):
    base = words(passage(11, 400))
    near = base[:200] + ["changed"] + base[201:]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (8, " ".join(base)), (9, passage(12, 400)), (None, " ".join(base)), (10, None), (11, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 256, 44, (20, 12)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (3, 3), (5, 3), (8, 3), (9, 9), (10, 10), (11, 10)]


def test_url_filter(spark, none):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/fr/", "block")]
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/12?x#y", "http://notorg/", "ftp://x.com/de/", "http://com/de/?q", "http://x.com/DE/", "http://x.com?/de/", "http://x.com/fr/a", "://org/", "http://x.com/de/\nb", "http://sub.org", "http://sub.org", "http://ex.com:80/de/"]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = host.lower()
        fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit)[2:] if fit else (None, "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, *best), u
    assert urlfilter.judge_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_warc(spark):
    long = "x" * 200
    rows = [(4, "http://b.org/1", long, 0), (2, "http://a.org/2", long, 0), (3, "http://a.org/1", "short", 0), (5, "http://a.org/1", "short", 0), (6, None, None, 0), (7, "http://a\nb%0A/", "é" * 60, 0), (2, "http://a.org/2", long, 0), (None, "http://c.org", long, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.read_archives(warc.write_archives(df)).collect()
    seen = sorted((r.page_id or -1, r.url or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got)
    want = [(i or -1, u or "", len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), "revisit" if t == long and i != 2 else "response", 2 if t == long and i != 2 else 0) for i, u, t, _ in rows]
    assert seen == sorted(want)
    order = [(r.url_key, r.timestamp) for r in got]
    assert order == sorted(order)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 4)
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    # one URL has a third of the rows, some rows repeat whole, others have no number
    rows = [(None if k % 11 == 0 else k % 350, f"http://h{k * k % 7}.org/{k % 13}" if k % 3 else "http://hot.org/", f"text {k % 350}", 0) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(5)
    got = warc.read_archives(warc.write_archives(df)).collect()
    key = [(r.url_key, r.timestamp, r.page_id is None, r.page_id or 0) for r in got]
    assert key == sorted(key) and len({(r.archive, r.record_at) for r in got}) == 400
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(i), u) for i, u, _, _ in rows)


def test_warc_levels(spark, monkeypatch):
    for name, value in {"ARCHIVE_BYTES": 1500, "RUN_ROWS": 12, "BLOCK_ROWS": 4, "RANGE_ROWS": 30, "FAN_IN": 3}.items():
        monkeypatch.setattr(warc, name, value)
    # a third of the rows have one URL, some have no number, one has a URL longer than what is sampled of it
    rows = [(None if k % 50 == 0 else k, "http://hot.org/" if k % 3 else f"http://h{k * k % 7}.org/{k}", f"text {k}") for k in range(400)] + [(1000, "http://h.org/" + "a/" * 5000, "x" * 10**6)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    first = archives.mapInArrow(warc._runs(warc.RUN_ROWS, warc.BLOCK_ROWS), warc.BLOCKS).select("run").distinct().count()
    assert first > warc.FAN_IN**2  # so there are two levels or more
    runs = warc.merged_runs(archives.mapInArrow(warc._runs(warc.RUN_ROWS, warc.BLOCK_ROWS), warc.BLOCKS)).collect()
    by_run = {}
    for r in runs:
        by_run.setdefault(r.run, []).append([warc._key(x) for x in warc._opened(bytes(r.data))])
    assert len(by_run) <= warc.FAN_IN
    for blocks in by_run.values():
        keys = [k for block in sorted(blocks) for k in block]
        assert keys == sorted(keys)
    got = warc.read_archives(archives).collect()
    key = [(r.url_key, r.timestamp, r.page_id is None, r.page_id or 0) for r in got]
    assert key == sorted(key) and len({(r.archive, r.record_at) for r in got}) == len(rows)
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(i), u) for i, u, _ in rows)


def test_warc_ranges_do_not_shred_blocks(spark, monkeypatch):
    df = spark.range(2500).selectExpr("id AS page_id", "concat('http://h', id % 97, '.org/', id) AS url", "concat('text ', id) AS html")
    runs = warc.written(warc.write_archives(df.coalesce(1)).mapInArrow(warc._runs(warc.RUN_ROWS, warc.BLOCK_ROWS), warc.BLOCKS), "runs")
    size = lambda bounds: runs.mapInArrow(warc._cut(bounds), f"range int, {warc.BLOCKS}").selectExpr("sum(length(data))").first()[0]
    whole = size([])
    for rows in (2500, 500, 50, 3):
        monkeypatch.setattr(warc, "RANGE_ROWS", rows)
        assert size(warc._bounds(runs, 2500, 1)) < 1.3 * whole


def test_warc_members(spark):
    data = warc._gzip(b"a" * 10**6) + warc._gzip(b"") + warc._gzip(bytes(np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8)))
    at, found = 0, []
    while at < len(data):
        out, size = warc._member(data, at)
        found.append(len(out))
        at += size
    assert found == [10**6, 0, 200_000]
    with pytest.raises(ValueError):
        warc._member(data[:-9], len(warc._gzip(b"a" * 10**6)) + len(warc._gzip(b"")))


def test_loser_tree():
    r = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((int(x), i) for x in r.integers(0, 50, int(r.integers(0, 30)))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_quality(spark, docs, none):
    good = [(k, passage(k, 80).replace("w", "ab") + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in words(passage(k, 60)))) for k in range(300)]
    df = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, "x"), (1, good[1][1])], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = quality.scored(df, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) > 0.95
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.scored(none, labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    r = np.random.default_rng(4)
    s = np.sort(r.normal(size=200))
    y, n = r.integers(0, 2, 200).astype(float), np.ones(200)
    knots, levels = quality.isotonic(s, y, n)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and levels.min() >= 0 and levels.max() <= 1


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, none, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rows = packing.pack(docs, vocabulary, 64).collect()
    want = []
    for i, text in TEXTS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 64) + 2 and sorted(bins) == list(range(len(bins)))
    assert packing.pack(none, vocabulary, 64).count() == 0


def test_sweeps_are_best_fit_decreasing():
    r = np.random.default_rng(8)
    for capacity in (10, 50, 64):
        for _ in range(20):
            sizes = r.integers(1, capacity + 1, 200)
            plan = packing.sweeps({int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}, capacity)
            fill, ranks = {}, {}
            for s in sorted(sizes, reverse=True):
                k = ranks.get(s, 0)
                ranks[s] = k + 1
                row = max((p for p in plan if p[0] == s and p[1] <= k), key=lambda p: p[1])
                b, at = row[2] + (k - row[1]) // row[3], row[4] + (k - row[1]) % row[3] * s
                fill.setdefault(int(b), []).append((int(at), int(s)))
            for b in fill.values():
                end = 0
                for at, s in sorted(b):
                    assert at == end
                    end += s
                assert end <= capacity
            gaps = []
            for s in sorted(sizes, reverse=True):  # one at a time
                fit = [g for g in gaps if g >= s]
                if fit:
                    gaps.remove(min(fit))
                    gaps.append(min(fit) - s)
                else:
                    gaps.append(capacity - s)
            assert len(fill) == len(gaps)


@pytest.mark.parametrize("text", ["it's 'super ''s \"'s don't we'll I'VE a're 'd'd x'", "", "<|endoftext|> a", "É Ñ×÷ ß²³ ¼1234 µ ªº \x85x", "ŒUVRE Σς", "a\x1cb\x00c", "'s", "'l", "'", "’s", "日本語 text", "x" * 5000, "\t\n"])
def test_tokens(vocabulary, text):
    import pyarrow as pa

    from sessionloom.llm.tokens import word_tokenizer

    w = word_tokenizer(vocabulary)
    ids, offsets = w.encode(pa.array(["before", text, None, text + " after"]))
    assert ids[offsets[1] : offsets[2]].tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids and offsets[2] == offsets[3]
    assert ids[offsets[3] :].tolist() == w.tokenizer.encode(text + " after", add_special_tokens=False).ids


def base_spans(t):
    check = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and check(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


PERSONAL = ["a@b.com_x@y.z 1.2.3.4.5 999.1.1.1 1.2.3 0001.002.3.4 0256.1.1.1 1.2.3.0000255", None, "", "call 555-123-4567 now", "mail jo.doe (at) site (dot) org please", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713. +12 +1-2-3-4-5-6-7-8-9", "é@x.de ünï@q.r 😀 t@u.v +49 30 1234567", "9" * 30 + " 1" * 30, "x" * 20000 + "@", "a.b@c..d.e@f.g@h.i", "4111111111111111@x.y 4111111111111111", "\n1.1.1.1\n"]


def test_personal_data(spark):
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(PERSONAL)], "doc_id long, text string, spans string").withColumn("c0", F.lit(1))
    got = {r.doc_id: r for r in pii.span_digest(df).collect()}
    for k, t in enumerate(PERSONAL):
        want = base_spans(t or "")
        said = ",".join(f"{pii.KINDS[n]}:{a}:{e}" for a, n, e in want)
        r = got[k]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == j for _, n, _ in want) for j in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert "phone:5:17" in got[3].spans and "email:5:31" in got[4].spans
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[3] == "call [PHONE] now" and text[4] == "mail [EMAIL] please" and text[1] is None and text[2] == ""
    assert text[5] == "[CARD] and 4111-1111-1111-1112"
    assert pii.span_digest(df.limit(0)).count() == 0
    # columns of the input stay, whatever their names
    kept = pii.find_spans(df)
    assert [c for c in kept.columns if c not in ("base", "spans")] == ["doc_id", "text", "c0"] and {r.c0 for r in kept.collect()} == {1}


def test_spans_beyond_the_base_rules(spark):
    """Planted rows, with words that the training examples do not have."""
    r = np.random.default_rng(21)
    noise = lambda: passage(int(r.integers(0, 10**6)), 12)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    hexes = lambda n: "".join("0123456789abcdef"[k] for k in r.integers(0, 16, n))
    said = lambda n: " ".join(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")[k] for k in r.integers(0, 10, n))
    plant = {
        "secret": lambda: ('client_secret: "', hexes(40), '"'),
        "key": lambda: ("export API_KEY=", "pk-" + hexes(29), ""),
        "spelled": lambda: ("contact me: ", f"mary.smith{digits(2)} [at] uni{digits(1)} [dot] edu", ""),
        "national": lambda: ("phone ", f"({digits(3)}) {digits(3)}-{digits(4)}", ""),
        "said": lambda: ("ring ", said(10), ""),
    }
    clean = {
        "commit": lambda: ("commit ", hexes(40), ""),
        "slug": lambda: ("see /", "winter-sale-2024-page-two", ""),
        "date": lambda: ("on ", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", ""),
        "at": lambda: ("", "shown at noon.", ""),
        "count": lambda: ("page ", f"{digits(3)} 12", ""),
    }
    rows, where = [], []
    for label, kinds in ((1, plant), (0, clean)):
        for name, make in kinds.items():
            for _ in range(40):
                before, value, after = make()
                head = f"{noise()} {before}"
                rows.append((len(rows), f"{head}{value}{after} {noise()}"))
                where.append((label, name, len(head), len(head) + len(value)))
    got = {x.doc_id: x.spans for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    hit = [any(s.start < e and a < s.end for s in got[k]) for k, (_, _, a, e) in enumerate(where)]
    recall = {n: np.mean([h for h, w in zip(hit, where, strict=True) if w[1] == n]) for n in plant}
    found = sum(len(x) for x in got.values())
    right = sum(h for h, w in zip(hit, where, strict=True) if w[0])
    assert min(recall.values()) >= 0.9, recall
    assert right / found >= 0.9, (right, found)


def test_secrets_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = [(r.doc_id, m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")]
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if pii.KINDS[s.kind] == "secret"} for r in pii.find_spans(docs.select("doc_id", "text")).collect()}
    assert planted and np.mean([(a, e) in got[i] for i, a, e in planted]) >= 0.95


def test_long_texts_with_many_spans(spark):
    # more matches than are added up at once, and places far into the text
    text = " ".join(f"word{k % 7} u{k}@h.org" for k in range(1000)) + " é" * 3000 + " 1.2.3.4"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(s.start, s.kind, s.end) for s in pii.find_spans(df).first().base] == base_spans(text)
    want, at = "", 0
    for a, k, e in base_spans(text):
        want, at = want + text[at:a] + f"[{pii.KINDS[k].upper()}]", e
    assert pii.redact(df).first().text == want + text[at:]
