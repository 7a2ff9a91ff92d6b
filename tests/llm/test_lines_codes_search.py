"""Line dedup, vector codes and ranked search against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import line_runs, part_codes, queries, ranked

BLANKS = " \t\n\x0b\x0c\r"
UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"
LICENSE = "Permission is granted to anyone who reads this line, free of charge"
FOREIGN = "Ünïcode Zeile mit genau so vielen Zeichen wie nötig sind"


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(k) for k, c in enumerate(("place", "low", "high", "keeper", "places", "n", "terms", "item", "rank", "m"))}).repartition(3)


# ---- lines


def line_rows():
    r = np.random.default_rng(3)
    rows = [(k, f"own line of document number {k} which no other has\n{LICENSE}\nshort\n") for k in range(30)]
    rows += [(k, f"  {LICENSE.upper()}\t\r\n{FOREIGN}") for k in range(30, 36)]
    rows += [(40 + k, FOREIGN.replace("Ü", "ü")) for k in range(4)]  # one document too few, and not the same key
    rows += [(50, f"{'x' * 40}\n" * 3), *((50 + k, "X" * 40) for k in range(1, 5))]  # several times in one document
    rows += [(60 + k, "y" * 39) for k in range(9)]  # too short by one
    rows += [(70, "z" * 50), *[(70, "z" * 50)] * 8, (71, "z" * 50)]  # a document that repeats is one
    rows += [(80, None), (81, ""), (82, "\n"), (83, "\n\n \n"), (None, None), (None, f"{LICENSE}\nmore"), (None, LICENSE)]
    rows += [(90, "\n".join(f"{LICENSE if k % 7 == 0 else r.integers(10**9)} " for k in range(20000))), (91, "no break " * 9000)]
    rows += [(92, "a b" + "c" * 40 + "\r" + LICENSE), (93, f"{LICENSE}\n{LICENSE}\nlast")]
    return rows


def plain_lines(rows, least=40, documents=5):
    def key(line):
        return line.strip(BLANKS).translate(UPPER_LOWER)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders[key(line)].add(i)
    often = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often or (i is not None and often[key(x)] == i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_against_a_plain_version(spark, batches):
    rows = line_rows()
    found = line_runs.drop_lines(table(spark, rows), batches=batches, fan_in=2).withColumn("sha", F.sha2("kept_text", 256))
    assert in_order(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "sha").collect()) == in_order(plain_lines(rows))


def test_no_documents_no_lines(spark):
    none = line_runs.drop_lines(table(spark, []))
    assert none.count() == 0 and none.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    only = line_runs.drop_lines(spark.createDataFrame([(None, None)], DOCS)).collect()
    assert [tuple(r) for r in only] == [(None, 1, 0, "")]


def test_levels_of_runs(spark):
    entries = line_runs.line_entries(table(spark, line_rows()), 40)
    index = line_runs.LineRuns(spark, 5, fan_in=2)
    sizes = []
    for k in range(7):
        index.add(entries.filter(F.pmod(F.xxhash64("doc_id"), F.lit(7)) == k))
        sizes.append([len(level) for level in index.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]
    held = entries.filter("doc_id is not null").groupBy("low", "high").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    true = {(r["low"], r["high"]): (r["n"], r["keeper"]) for r in held.collect()}
    rows = index.counted().collect()
    assert len(rows) == len(true)
    for r in rows:  # what a batch leaves out because a run has settled it changes neither verdict nor keeper
        n, keeper = true[r["low"], r["high"]]
        assert r["keeper"] == keeper and (r["documents"] == n if n < 5 else r["documents"] >= 5)
    # a batch of settled keys with smaller documents adds nothing; a larger document does
    settled = [r for r in rows if r["documents"] >= 5]
    low = spark.createDataFrame([(r["low"], r["high"], -1) for r in settled], "low long, high long, doc_id long")
    alone = line_runs.LineRuns(spark, 5, fan_in=2)
    alone.levels[0].append(alone._write(index.counted().filter("documents >= 5")))
    assert alone.fresh(low).count() == 0 and alone.fresh(low.withColumn("doc_id", F.lit(10**6))).count() == len(settled)
    names = index.names() + alone.names()
    index.forget(), alone.forget()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_joins_of_runs_move_no_run(spark):
    entries = line_runs.line_entries(spark.createDataFrame(line_rows(), DOCS), 40)
    index = line_runs.LineRuns(spark, 5)
    index.add(entries.filter("doc_id < 40"))
    plan = index.fresh(entries.filter("doc_id >= 40"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 2  # both of the batch
    index.forget()


# ---- codes


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label) that take part."""
    whole = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows]
    width = len(whole[0][2]) // parts
    cut = [[tuple(v[k * width : (k + 1) * width]) for k in range(parts)] for _, _, v in whole]
    least = {}
    for n, (i, _, v) in enumerate(whole):
        if i not in least or v < whole[least[i]][2]:
            least[i] = n
    first = [least[i] for i in sorted(least, key=lambda i: (i is None, i or 0))][:entries]
    books = [[cut[n][k] for n in first] for k in range(parts)]

    def near(k, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(books[k]))

    for _ in range(rounds):
        at = [[near(k, c[k])[1] for k in range(parts)] for c in cut]
        for k in range(parts):
            for e in range(len(books[k])):
                own = [c[k] for c, a in zip(cut, at, strict=True) if a[k] == e]
                if own:
                    books[k][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    ends = [[near(k, c[k]) for k in range(parts)] for c in cut]
    by_label = Counter()
    for (_, label, _), e in zip(whole, ends, strict=True):
        by_label[label] += sum(d for d, _ in e)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in e), sum(d for d, _ in e), by_label[label], digest) for (i, label, _), e in zip(whole, ends, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"
CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def vectors():
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=8) * 0.3], int(i % 3) if i % 5 else None) for i in range(1, 90)]
    rows += [(200 + k, rows[3][1], 1) for k in range(40)]  # a third of all rows is one vector
    rows += [(None, rows[5][1], 2), (7, rows[8][1], 0), rows[9], (0, [0.0] * 8, None), (-3, [-0.25] * 8, 1), (300, [1000.0, -1000.0] * 4, 1)]
    bad = [(400, None, 1), (401, [], 1), (402, [1.0] * 7 + [None], 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [0.0] * 7, 1), (405, [0.5] * 4, 1)]
    return rows, bad


@pytest.mark.parametrize("entries", [16, 5])
def test_codes_against_a_plain_version(spark, entries):
    rows, bad = vectors()
    given = spark.createDataFrame(rows + bad, VECTORS).withColumns({"v": F.lit(1), "part": F.lit(2), "error": F.lit("x"), "code": F.lit(None).cast("string")}).repartition(5)
    found = part_codes.compressed(given, parts=4, entries=entries, rounds=6).select(CODES)
    assert in_order(tuple(r) for r in found.collect()) == in_order(plain_codes(rows, 4, entries, 6, 4096))


def test_codes_of_few_and_no_vectors(spark):
    few = [(2, [0.5, 0.25], 1), (1, [0.125, -0.5], None)]
    found = part_codes.compressed(spark.createDataFrame(few, VECTORS), parts=2).select(CODES)
    assert in_order(tuple(r) for r in found.collect()) == in_order(plain_codes(few, 2, 16, 6, 4096))
    for rows in ([], [(1, None, 1)]):
        assert part_codes.compressed(spark.createDataFrame(rows, VECTORS)).select(CODES).count() == 0
    with pytest.raises(ValueError):
        part_codes.compressed(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], VECTORS), parts=2)


def test_trees_find_the_nearest_and_leave_branches(spark):
    r = np.random.default_rng(9)
    centres = r.integers(-4000, 4000, (16, 8))
    for books, parts in (
        (centres, centres[r.integers(0, 16, 5000)] + r.integers(-300, 300, (5000, 8))),
        (r.integers(-2, 2, (16, 8)), r.integers(-2, 2, (5000, 8))),  # many ties
        (np.repeat(centres[:2], 8, 0), centres[r.integers(0, 16, 500)]),  # entries that repeat
        (centres[:1], centres),
        (r.integers(-(2**26), 2**26, (16, 8)), r.integers(-(2**26), 2**26, (2000, 8))),
    ):
        at, square, done = part_codes.nearest(part_codes.tree(books), books, parts)
        true = ((parts[:, None] - books[None]) ** 2).sum(2)
        assert (at == true.argmin(1)).all() and (square == true.min(1)).all() and done <= true.size
        if books is centres:
            assert done < 0.6 * true.size


# ---- search


def plain_search(docs, items, k):
    def terms(t):
        return [x.translate(UPPER_LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    count, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in set(items):
        scored = []
        for i, bag, n in bags:
            m = 10 + 90 * n * count // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return out


def documents():
    r = np.random.default_rng(11)
    vocabulary = [f"term{k}" for k in range(60)] + ["Straße", "ÉTÉ", "été", "x1", "日本"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(int(i), " ".join(r.choice(vocabulary, r.integers(1, 40), p=weight / weight.sum()))) for i in range(150)]
    rows += [(500 + k, "term3 term50 term51, the same text.") for k in range(80)]  # a third of all rows is one text
    rows += [(None, "term3 term50 term51, the same text."), (None, None), (4, None), (5, ""), (6, "--- ...\n"), (7, "TERM7 Term7 term7_term7"), rows[3], rows[3]]
    rows += [(900, "term50 " * 9000 + "rare"), (901, "filler " * 20000), (902, "other " * 30)]
    items = [(int(i), " ".join(r.choice(vocabulary, r.integers(1, 12)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (103, "nowhere found"), (104, "term50 term51"), (104, "rare"), (105, "TERM7"), (105, "TERM7"), (None, "term1 term2"), (106, "term0")]
    return rows, items


@pytest.mark.parametrize(("terms", "cells"), [(1 << 20, 1 << 21), (40, 300)])
def test_search_against_a_plain_version(spark, monkeypatch, terms, cells):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms)
    monkeypatch.setattr(ranked, "MOST_CELLS", cells)
    monkeypatch.setattr(ranked, "MOST_PAIRS", cells * 4)
    docs, items = documents()
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item_key", F.lit(1)).withColumn("score", F.lit("x"))
    found = ranked.search(table(spark, docs), asked, k=10)
    assert in_order(tuple(r) for r in found.collect()) == in_order(plain_search(docs, items, 10))


def test_search_of_nothing(spark):
    docs, items = documents()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(table(spark, []), asked).count() == 0
    assert ranked.search(table(spark, [(1, None), (2, "..")]), asked).count() == 0
    assert ranked.search(table(spark, docs), asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_above_and_few_documents_are_rescored():
    r = np.random.default_rng(2)
    tf, m = r.integers(1, 2000, 50000), r.integers(10, 5000, 50000)
    parts = ranked.term_parts(tf, m)
    impacts = -(-parts // ranked.STEP)
    assert impacts.max() <= 255 and (impacts * ranked.STEP >= parts).all() and (impacts * ranked.STEP - parts < ranked.STEP).all()
    assert (ranked.length_measure(np.array([1 << 40]), 1 << 40, 1 << 60) == 10 + 90 * (1 << 20)).all()


# ---- the registered queries


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_ranked_search", "op13_line_dedup"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    ours = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(ours.columns) == sorted(columns)
    assert in_order(tuple(r) for r in ours.select(columns).collect()) == in_order(found.fetchall())
