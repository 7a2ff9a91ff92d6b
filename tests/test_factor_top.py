"""Exact top lists by products of factors, in blocks of users that meet all items."""

import numpy as np

from sessionloom.operators import recommend as R


def test_factor_top_equals_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(5)
    # whole numbers, so that many products tie, and lengths of all sizes, so that short items are skipped
    users, items = r.integers(-3, 4, (300, 4)), r.integers(-3, 4, (3000, 4)) * r.choice([1, 4], (3000, 1), p=[0.9, 0.1])
    monkeypatch.setattr("pyspark.ml.recommendation.ALSModel.recommendForAllUsers", None)
    frame = lambda x, shift: spark.createDataFrame([(k + shift, v.tolist()) for k, v in enumerate(x.astype(float))], "id int, features array<float>")
    found = R.factor_top(frame(users, 0), frame(items, 7).repartition(5), 20).collect()
    score = users @ items.T
    expected = set()
    for u, row in enumerate(score):
        for place, i in enumerate(np.lexsort((np.arange(len(row)), -row))[:20]):
            expected.add((u, place + 1, int(i) + 7, float(row[i])))
    assert {tuple(x) for x in found} == expected and len(found) == len(expected)
    few = R.factor_top(frame(users[:2], 0), frame(items[:3], 7), 20).collect()
    assert sorted((x.user, x["rank"]) for x in few) == [(u, k) for u in range(2) for k in (1, 2, 3)]


def test_als_top_meets_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("pyspark.ml.recommendation.ALSModel.recommendForAllUsers", None)
    rows = spark.createDataFrame([(u, (u * 7 + k) % 40, 1.0) for u in range(30) for k in range(6)], "user int, item int, weight float")
    assert R.als_top(rows, 5).count() == 150


def test_als_blocks_grow_with_interactions(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    blocks, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, rows: (blocks.append((self.getNumUserBlocks(), self.getNumItemBlocks())), fit(self, rows))[1])
    rows = spark.createDataFrame([(u, (u * 7 + k) % 40, 1.0) for u in range(30) for k in range(6)], "user int, item int, weight float")
    few = {(x.user, x["rank"]) for x in R.als_top(rows, 5).collect()}
    monkeypatch.setattr(R, "RATED", 10)
    many = {(x.user, x["rank"]) for x in R.als_top(rows, 5).collect()}
    assert blocks == [(10, 10), (18, 18)] and few == many == {(u, k) for u in range(30) for k in range(1, 6)}


def test_factor_top_orders_by_products_in_double(spark):
    r = np.random.default_rng(8)
    users, items = (r.normal(size=(n, 16)).astype(np.float32) for n in (700, 5000))
    # copies of items that differ in the last bits alone, which single precision orders by chance
    items[2500:] = np.nextafter(items[:2500], np.float32(9), dtype=np.float32)
    frame = lambda x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, features array<float>")
    found = {(x.user, x["rank"]): (x.item, x.score) for x in R.factor_top(frame(users), frame(items).repartition(3), 20).collect()}
    for u, x in enumerate(users.astype(float)):
        score = (x * items).sum(1)
        best = np.lexsort((np.arange(len(score)), -score))[:20]
        assert [found[u, k + 1] for k in range(20)] == [(i, score[i]) for i in best]


def test_users_leave_one_by_one():
    x = np.array([[1, 0], [0, 1]] * 300, np.float32)
    best = R._Best(np.arange(600), x, 2)
    best.add(np.arange(3), np.array([[4, 1], [4, 1], [4, 1]], np.float32), 17**0.5)
    best.add(np.arange(3, 5), np.array([[0, 2], [0, 2]], np.float32), 2.0)
    # those along the first axis have 4 twice, which no item of length 2 reaches
    assert set(best.open) == set(range(1, 600, 2))
    assert best.item[0].tolist() == [0, 1] and best.item[1].tolist() == [3, 4] and best.score[1].tolist() == [2.0, 2.0]
