"""Keys of several pieces: every link is kept, and buckets stay small as fingerprints grow in number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import simhash


def components_of(prints, radius):
    """Least id of each row's component, by all pairs."""
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    label = np.arange(len(prints))
    while True:
        least = np.where(far <= radius, label[None, :], len(prints)).min(1)
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize("rows", [10**3, 10**6, 10**10, 10**12])
@pytest.mark.parametrize("radius", [0, 3, 4])
def test_every_link_is_kept(spark, rows, radius):
    r = np.random.default_rng(rows % 97 + radius)
    prints = r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 300, dtype=np.uint64)
    near = []
    for k in range(600):  # copies with exactly 0 to 6 other bits, wherever they lie
        flips = r.choice(64, k % 7, replace=False)
        near.append(prints[r.integers(300)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    prints = np.unique(np.concatenate([prints, np.array(near, np.uint64)]))
    df = spark.createDataFrame(list(enumerate(prints.view(np.int64).tolist())), "id long, f0 long")
    found = simhash.components(simhash.near_links(df, 64, radius, rows=rows)).collect()
    label = np.arange(len(prints))
    for x in found:
        label[x.id] = x.root
    assert (label == components_of(prints, radius)).all()


def test_more_rows_have_longer_keys():
    width = lambda rows: [sum(w for _, w in x) for x in simhash.keys(64, 4, None, rows)]
    assert [len(width(10**k)) for k in (4, 6, 10)] == [5, 15, 35]
    assert min(width(10**4)) >= 12 and min(width(10**6)) >= 20 and min(width(10**10)) >= 27
    assert simhash.keys(256, 44, (20, 12), 10**9) == [[(12 * k, 12)] for k in range(20)]


def test_comparisons_grow_with_the_rows(spark):
    """Pairs in buckets a fingerprint, for random ones: below 40 from 10 ** 4 to 10 ** 6 (five keys of 12 to 13 bits would make ten times more at 10 ** 6 than at 10 ** 5)."""
    for n in (10**4, 10**5, 10**6):
        prints = spark.range(n).select("id", F.xxhash64("id").alias("f0"))
        sizes = simhash.bucketed(prints, 64, 4).groupBy("band", "part").count()
        assert sizes.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] < 40 * n
