"""The pairwise ranker against a plain version, and labels as ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import lambdarank as L
from sessionloom.operators import recommend as R
from sessionloom.operators import splits as P

NAMES = ["f0", "f1", "f2"]


def candidates(seed, sessions, size, truth=(2.0, -1.0, 0.5)):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        x = r.normal(size=(size, 3)) + r.normal(size=3) * 3
        utility = x @ np.array(truth) + r.gumbel(size=size)
        hits = set(np.argsort(-utility)[: r.integers(1, 4)].tolist())
        rows += [(s, k * 10 + s % 3, int(k in hits), *map(float, x[k])) for k in range(size)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "session long, candidate_aid long, label int, f0 double, f1 double, f2 double")


def plain_sums(rows, weights, k):
    """Gradient, curvature, NDCG and sessions, pair by pair."""
    g, h, ndcg, n = np.zeros(3), np.zeros((3, 3)), 0.0, 0
    for s in sorted({r[0] for r in rows}):
        own = [(r[1], r[2], np.array(r[3:])) for r in rows if r[0] == s]
        own.sort(key=lambda c: (-float(c[2] @ weights), c[0]))
        hits = sum(c[1] for c in own)
        if not 0 < hits < len(own):
            continue
        d = [1 / math.log2(p + 2) if p < k else 0.0 for p in range(len(own))]
        best = sum(1 / math.log2(p + 2) for p in range(min(hits, k)))
        ndcg += sum(d[p] for p, c in enumerate(own) if c[1]) / best
        n += 1
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                if a[1] and not b[1]:
                    apart = a[2] - b[2]
                    wrong = 1 / (1 + math.exp(apart @ weights))
                    swap = abs(d[i] - d[j]) / best
                    g += swap * wrong * apart
                    h += swap * wrong * (1 - wrong) * np.outer(apart, apart)
    return g, h, ndcg, n


@pytest.mark.parametrize("piece", [8192, 7])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_gradient_of_ten_sessions(spark, monkeypatch, piece, k):
    monkeypatch.setattr(L, "PIECE", piece)
    rows = candidates(1, 10, 24)
    rows += [(50, 1, 1, 0.0, 0.0, 0.0), (50, 2, 1, 1.0, 0.0, 0.0), (51, 1, 0, 2.0, 1.0, 1.0)]  # only hits, only misses
    rows += [(52, a, int(a > 30), 0.5, 0.5, 0.5) for a in range(40)]  # all candidates tie
    packed = L.packed(frame(spark, rows), NAMES, dict.fromkeys(NAMES, 1.0)).persist()
    wide = packed.filter("pieces > 1")
    assert wide.isEmpty() == (piece == 8192)
    for weights in (np.zeros(3), np.array([0.5, -0.2, 0.1])):
        sums = L.pair_sums(packed.filter("pieces = 1"), wide, weights, k)
        g, h, ndcg, n = plain_sums(rows, weights, k)
        assert np.allclose(sums.gradient, g) and np.allclose(sums.curvature, h) and math.isclose(sums.ndcg, ndcg) and sums.sessions == n
    packed.unpersist()


def mean_ndcg(scored, k=20):
    rows = [(r.session, r.label, r.score, r.candidate_aid) for r in scored.collect()]
    out = []
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[3]))
        best = sum(1 / math.log2(p + 2) for p in range(min(k, sum(r[1] for r in own))))
        out.append(sum(r[1] / math.log2(p + 2) for p, r in enumerate(own[:k])) / best)
    return float(np.mean(out))


def test_held_out_sessions_rank_no_worse_than_by_regression(spark):
    rows = frame(spark, candidates(2, 300, 30)).withColumn("shared", F.col("session") * 1.0).persist()
    train, held = rows.filter("session % 3 != 0"), rows.filter("session % 3 = 0")
    ranker = L.fit(train, [*NAMES, "shared"], rounds=8)
    scorer, _ = R.fit_ranker(train, NAMES)
    ours, theirs, none = mean_ndcg(ranker.score(held)), mean_ndcg(scorer(held)), mean_ndcg(held.withColumn("score", F.lit(0.0)))
    assert ours >= theirs - 0.005 and ours > none + 0.2
    assert max(ranker.ndcg) > ranker.ndcg[0] and abs(ranker.weights["shared"]) < 1e-6  # what a session shares tells nothing
    assert ranker.weights["f0"] > 0 > ranker.weights["f1"]


def test_a_session_of_many_candidates_is_many_tasks_rows(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("candidate_aid"), (F.col("id") % 2).alias("label"), *((F.hash("id", F.lit(k)) / 2.0**31).alias(f"f{k}") for k in range(3)))
    packed = L.packed(rows, NAMES, dict.fromkeys(NAMES, 1.0)).persist()
    sizes = [r[0] for r in packed.select(F.size("rows")).collect()]
    assert len(sizes) == 13 and sum(sizes) == 100_000 and max(sizes) < 1.2 * L.PIECE
    sums = L.pair_sums(packed.filter("pieces = 1"), packed, np.array([1.0, 0.0, 0.0]), 20)
    assert sums.sessions == 1 and 0 < sums.ndcg < 1
    packed.unpersist()


def test_nothing_to_learn(spark):
    none = L.fit(frame(spark, []), NAMES)
    assert none.weights == dict.fromkeys(NAMES, 0.0) and none.ndcg == []
    same = L.fit(frame(spark, [(1, 1, 1, None, float("nan"), 1.0), (1, 2, 0, None, None, 1.0)]), NAMES, rounds=2)
    assert same.weights == dict.fromkeys(NAMES, 0.0)


# ---- labels as ranges


def test_ranges_written_out_are_the_sets_that_follow(spark):
    r = np.random.default_rng(4)
    rows = [(int(r.integers(4)), int(r.integers(6)), int(r.integers(40)), ("clicks", "carts", "orders")[r.integers(3)]) for _ in range(200)]
    rows += rows[:20] + [(9, 1, 5, "carts")] * 3 + [(10, 1, 1, "orders")]
    events = spark.createDataFrame(rows, "session long, aid long, ts long, type string")

    def plain():
        for s in sorted({x[0] for x in rows}):
            own = sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1], x[3]))
            for p, x in enumerate(own[:-1]):
                rest = own[p + 1 :]
                yield (*x, next((y[1] for y in rest if y[3] == "clicks"), None), *(sorted({y[1] for y in rest if y[3] == t}) for t in ("carts", "orders")))

    found = P.future_labels(events).select("session", "aid", "ts", "type", "next_click", "later_carts", "later_orders").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain()))
    marks, lists = P.future_ranges(events)
    distinct = events.filter("type != 'clicks'").select("session", "type", "aid").distinct().count()
    assert sum(len(x.carts) + len(x.orders) for x in lists.collect()) == distinct and marks.count() == len(rows) - len({x[0] for x in rows})


# ---- negatives and top lists


@pytest.mark.parametrize("seed", [None, 42])
def test_exactly_as_many_negatives(spark, seed):
    from sessionloom.operators import covisit as V

    items = 37
    rows = [(1, a) for a in range(items)] + [(2, a) for a in range(items - 3)] + [(3, 5), (4, 36), (4, 36), (-9, 0)]
    history = spark.createDataFrame(rows, "session long, aid long")
    found = R.exact_negatives(history, V.dense_ids(history, "aid"), 10, seed).collect()
    for session, want in ((1, 0), (2, 3), (3, 10), (4, 10), (-9, 10)):
        own = [r for r in found if r.session == session]
        assert [r.k for r in sorted(own, key=lambda r: r.k)] == list(range(1, want + 1)) and len({r.aid for r in own}) == want
        assert not {(session, r.aid) for r in own} & set(rows)
    assert R.next_prime(1) == 2 and R.next_prime(7) == 11 and R.next_prime(0) == 2
    assert R.exact_negatives(history.limit(0), V.dense_ids(history, "aid"), 10, seed).count() == 0


def test_short_vectors_are_left_where_long_ones_rule_them_out(spark):
    r = np.random.default_rng(6)
    size = np.concatenate([np.full(30, 8.0), np.full(470, 0.5)])
    vectors = [(int(i), [float(x) for x in v / np.linalg.norm(v) * size[i]]) for i, v in enumerate(r.normal(size=(500, 6)))]
    vectors += [(1000 + k, vectors[0][1]) for k in range(3)] + [(2000, [0.0] * 6)]
    items = spark.createDataFrame(vectors, "item long, v array<double>")
    users = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(vectors[:20])] + [(99, [0.0] * 6)], "user long, v array<double>")
    met = []
    found = R.pruned_top(users, items, 5, levels=4, met=met)
    whole = R.dot_product_top(users, items, 5)
    assert sorted((x.user, x.rank, x.item) for x in found.collect()) == sorted((x.user, x.rank, x.item) for x in whole.collect())
    assert met[0][0] == 21 and sum(n for _, n in met) == len(vectors)
    # of the pairs with short vectors only the user without length is left
    assert sum(a * b for a, b in met) < 0.35 * 21 * len(vectors)
    assert R.pruned_top(users, items.limit(0)).count() == 0
