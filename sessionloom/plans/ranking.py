"""Queries: the pairwise ranker, and labels as ranges; with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.constants import EVENT_TYPES
from sessionloom.operators import covisit as V
from sessionloom.operators import lambdarank as L
from sessionloom.operators import recommend as R
from sessionloom.operators import splits as P
from sessionloom.plans.analytics import _sql
from sessionloom.plans.graphs import _text
from sessionloom.plans.recommend import _FOUND, _LABELS, _WEIGHTS, _parts
from sessionloom.sources.events import WEB_SQL, web_events

#: Not features: keys, and times that no two sessions share.
KEYS = ("session", "candidate_aid", "session_end_ts")
ROUNDS = 6


def lambdarank_recommend(spark: SparkSession, d: str) -> DataFrame:
    """For each target a ranker fitted to all labelled candidates, and the 20 best of each session."""
    history, _, found = _parts(spark, d, labels=True, carry=True)
    rows = R.assemble(found, history, history).persist(StorageLevel.MEMORY_AND_DISK)
    hits = {kind: f"hit_{kind}" for kind in EVENT_TYPES}
    features = [c for c in rows.columns if c not in (*KEYS, *hits.values())]
    rankers = L.fit_targets(rows, features, hits, rounds=ROUNDS)
    return R.recommend_targets(rows, {kind: ranker.score for kind, ranker in rankers.items()})


def lambda_gradients(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs that NDCG@20 weights, the gradient by feature at fixed weights; NDCG and the number of sessions beside it."""
    _, future, found = _parts(spark, d, labels=True)
    rows = R.labelled(found, P.ground_truth(future), "clicks")
    features = list(_WEIGHTS)
    packed = L.packed(rows, features, dict.fromkeys(features, 1.0)).persist(StorageLevel.MEMORY_AND_DISK)
    whole, wide = packed.filter("pieces = 1"), packed.filter("pieces > 1")
    sums = L.sum_rows(whole, wide, np.array([_WEIGHTS[c] for c in features]), 20)
    names = F.array(*map(F.lit, ("ndcg", "sessions", *features)))
    named = sums.filter(F.col("place") < 2 + len(features)).select(F.element_at(names, F.col("place") + 1).alias("name"), F.round("value", 4).alias("value"))
    return named


def future_ranges(spark: SparkSession, d: str) -> DataFrame:
    return P.future_ranges(web_events(spark, d))[0]


def future_lists(spark: SparkSession, d: str) -> DataFrame:
    return P.future_ranges(web_events(spark, d))[1].select("session", _text("carts").alias("carts"), _text("orders").alias("orders"))


def exact_negatives(spark: SparkSession, d: str) -> DataFrame:
    events = web_events(spark, d)
    return R.exact_negatives(events, V.dense_ids(events, "aid"), 20, seed=None)


def pruned_dot_top(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose number 20 divides as users, all vectors as items, longer or shorter by their label."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    users = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("user"), F.col("embedding").alias("v"))
    items = rows.select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("v"))
    return R.pruned_top(users, items, 10).withColumn("score", F.round("score", 5))


QUERIES = {
    "exact_negatives": exact_negatives,
    "pruned_dot_top": pruned_dot_top,
    "lambdarank_recommend": lambdarank_recommend,
    "lambda_gradients": lambda_gradients,
    "future_ranges": future_ranges,
    "future_lists": future_lists,
}
_SCORE = " + ".join(f"{c} * {w}" for c, w in _WEIGHTS.items())
_LAMBDAS = f"""scored AS (SELECT f.*, label, CAST({_SCORE} AS DOUBLE) AS s FROM found AS f JOIN labels0 USING (session, candidate_aid)),
    placed AS (SELECT *, CASE WHEN r <= 20 THEN 1 / log2(r + 1) ELSE 0 END AS d FROM
        (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s DESC, candidate_aid) AS r FROM scored)),
    hits AS (SELECT session, sum(label) AS h FROM placed GROUP BY session HAVING sum(label) > 0 AND sum(label) < count(*)),
    ideal AS (SELECT session, sum(1 / log2(p + 1)) AS best FROM hits, unnest(range(1, 21)) AS u(p) WHERE p <= h GROUP BY session),
    pairs AS (SELECT a.session, abs(a.d - b.d) / best / (1 + exp(a.s - b.s)) AS pull, {", ".join(f"a.{c} - b.{c} AS {c}" for c in _WEIGHTS)}
        FROM placed AS a JOIN placed AS b ON a.session = b.session AND a.label = 1 AND b.label = 0 JOIN ideal ON a.session = ideal.session)"""
_PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, aid, type) AS place FROM ev),
    lasts AS (SELECT session, type, aid, max(place) AS last FROM placed WHERE type IN ('carts', 'orders') GROUP BY ALL)"""
ORACLES = {
    "exact_negatives": _sql(
        """SELECT session, aid, CAST(k AS INT) AS k FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY step) AS k FROM
            (SELECT session, step, (session * 7919 % p + step * (session * 104729 % (p - 1) + 1)) % p AS dense
                FROM (SELECT session, count(*) AS seen FROM seen GROUP BY session), prime, unnest(range(least(seen + 20 + p - n, p))) AS u(step))
            JOIN numbered USING (dense) ANTI JOIN seen USING (session, aid)) WHERE k <= 20""",
        WEB_SQL,
        "seen AS (SELECT DISTINCT session, aid FROM ev)",
        "numbered AS (SELECT aid, row_number() OVER (ORDER BY aid) - 1 AS dense FROM (SELECT DISTINCT aid FROM ev))",
        """prime AS (SELECT n, min(q) AS p FROM (SELECT n, n + k AS q FROM (SELECT count(*) AS n FROM numbered), range(1, 1000) AS r(k))
            WHERE q > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 100000) AS f(d) WHERE d * d <= q AND q % d = 0) GROUP BY n)""",
    ),
    "pruned_dot_top": """
        WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT a.vec_id AS "user", b.vec_id AS item, list_inner_product(a.v, list_transform(b.v, lambda x: x * (1 + b.label))) AS score
            FROM e AS a, e AS b WHERE a.vec_id % 20 = 0)
        SELECT "user", CAST(r AS INT) AS rank, item, round(score, 5) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS r FROM s) WHERE r <= 10""",
    "future_ranges": _sql(
        """SELECT p.session, p.aid, p.ts, p.type, CAST(p.place AS INT) AS place,
            (SELECT count(*) FROM lasts AS l WHERE l.session = p.session AND l.type = 'carts' AND l.last <= p.place) AS carts_from,
            (SELECT count(*) FROM lasts AS l WHERE l.session = p.session AND l.type = 'orders' AND l.last <= p.place) AS orders_from,
            (SELECT min_by(c.aid, c.place) FROM placed AS c WHERE c.session = p.session AND c.type = 'clicks' AND c.place > p.place) AS next_click
        FROM placed AS p WHERE p.place < (SELECT max(m.place) FROM placed AS m WHERE m.session = p.session)""",
        WEB_SQL, _PLACED,
    ),
    "future_lists": _sql(
        """SELECT session, coalesce(string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY last) FILTER (type = 'carts'), '') AS carts,
            coalesce(string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY last) FILTER (type = 'orders'), '') AS orders FROM lasts GROUP BY session""",
        WEB_SQL, _PLACED,
    ),
    "lambda_gradients": _sql(
        "SELECT 'sessions' AS name, CAST(count(*) AS DOUBLE) AS value FROM ideal"
        " UNION ALL SELECT 'ndcg', round(sum(dcg / best), 4) FROM (SELECT session, sum(d * label) AS dcg FROM placed GROUP BY session) JOIN ideal USING (session)"
        + "".join(f" UNION ALL SELECT '{c}', round(sum(pull * {c}), 4) FROM pairs" for c in _WEIGHTS),
        *_FOUND, _LABELS, _LAMBDAS,
    ),
}
