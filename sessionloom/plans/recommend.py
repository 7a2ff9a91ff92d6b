"""Queries: recommendations, candidates, features, training rows; with DuckDB SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import covisit as V
from sessionloom.operators import items as I
from sessionloom.operators import recommend as R
from sessionloom.operators import sessions as S
from sessionloom.operators import splits as P
from sessionloom.plans.analytics import _POPULAR, _sql, rounded
from sessionloom.plans.graphs import _PARTS, MONTH_MS, _unified
from sessionloom.sources.events import PURCHASE_SQL, WEB_SQL, parts_for, purchase_events, purchase_rows, web_events


def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_reciprocal(_dealt_purchases(spark, d)))


def _dealt_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Purchases by session, kept: what tails, lists and lengths group by session moves no more."""
    return R.dealt_by_session(purchase_events(spark, d), purchase_rows(spark, d)).persist(StorageLevel.MEMORY_AND_DISK)


#: Events whose pairs a task sums; each has about ten.
PAIRED = 1 << 17


def _reciprocal(events: DataFrame) -> DataFrame:
    return R.reciprocal_rank(events, V.adjacency(V.unified_edges(events, gap_ms=MONTH_MS, parts=parts_for(events.sparkSession, events.count(), PAIRED))))


def _parts(spark: SparkSession, d: str, labels: bool = False, carry: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = web_events(spark, d)
    history, future = P.history_split(events)
    # three graphs, popular items, what was seen and features are made of it
    history = history.persist(StorageLevel.MEMORY_AND_DISK)
    graphs = {g: V.typed_edges(history, g) for g in R.GRAPHS}
    return history, future, R.candidates(history, graphs, I.popular_candidates(history), P.ground_truth(future) if labels else None, carry)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_parts(spark, d)[2])


def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    history, _, found = _parts(spark, d, carry=True)
    return rounded(R.assemble(found, history, history))


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    _, future, found = _parts(spark, d, labels=True)
    return R.labelled(found, P.ground_truth(future), "clicks").select("session", "candidate_aid", "label")


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    history, future, found = _parts(spark, d, labels=True, carry=True)
    rows = R.labelled(R.assemble(found, history, history), P.ground_truth(future), "clicks").select("session", "candidate_aid", "click_all", "label")
    return R.training_rows(rows, seed=None)


_WEIGHTS = {"wgt_clicks": 1.0, "wgt_cart_order": 0.5, "wgt_buy2buy": 2.0, "source_history": 0.25, "source_popular": 0.125}


def batch_recommend(spark: SparkSession, d: str) -> DataFrame:
    found = _parts(spark, d)[2]
    return rounded(R.recommend(R.linear_score(_WEIGHTS)(found)))


def fallback_recommend(spark: SparkSession, d: str) -> DataFrame:
    history, _, found = _parts(spark, d)
    popular = I.popular_items(history, 20).filter("event_type = 'clicks'")
    scored = R.linear_score(_WEIGHTS)(found.filter("source_clicks = 1"))
    return rounded(R.with_fallback(scored, history, popular, history))


def fitted_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Fit the ranker on labelled candidates and recommend with it."""
    history, future, found = _parts(spark, d, labels=True, carry=True)
    features = ["wgt_clicks", "wgt_cart_order", "wgt_buy2buy", "source_history", "source_popular", "click_all", "click_7d", "repetitions", "n_sources_present", "log_recency"]
    rows = R.assemble(found, history, history).select("session", "candidate_aid", *features, "hit_clicks").persist(StorageLevel.MEMORY_AND_DISK)
    train = R.training_rows(R.labelled(rows, P.ground_truth(future), "clicks"))
    return R.recommend(R.fit_ranker(train, features)[0](rows))


#: Weights of the features for each target.
_TARGET_WEIGHTS = {
    "clicks": {"wgt_clicks": 1.0, "source_history": 0.25, "source_popular": 0.125},
    "carts": {"wgt_cart_order": 1.0, "wgt_clicks": 0.25, "source_history": 0.5},
    "orders": {"wgt_buy2buy": 2.0, "wgt_cart_order": 0.5, "source_history": 1.0},
}


def target_recommend(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates for each target, by weights of its own."""
    found = _parts(spark, d)[2]
    return rounded(R.recommend_targets(found, {kind: R.linear_score(w) for kind, w in _TARGET_WEIGHTS.items()}))


def target_submission(spark: SparkSession, d: str) -> DataFrame:
    found = _parts(spark, d)[2]
    return R.submission(R.recommend_targets(found, {kind: R.linear_score(w) for kind, w in _TARGET_WEIGHTS.items()}))


def recommend_blocks(spark: SparkSession, d: str) -> DataFrame:
    scored = R.linear_score(_WEIGHTS)(_parts(spark, d)[2])
    return R.blocks(R.recommend(scored, 15), 5)


def submission(spark: SparkSession, d: str) -> DataFrame:
    scored = R.linear_score(_WEIGHTS)(_parts(spark, d)[2])
    return R.submission(R.recommend(scored), ("clicks", "carts", "orders"))


def served_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with an even number have a cached list (their first items), all have a computed one."""
    events = _dealt_purchases(spark, d)
    lengths = events.groupBy("session").agg(F.count(F.lit(1)).alias("length"))
    items = events.groupBy("session").agg(F.slice(F.array_sort(F.collect_set("aid")), 1, 3).alias("items"))
    listed = _reciprocal(events).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("x"))
    computed = listed.select("session", F.transform("x", lambda y: y["aid"]).alias("items"))
    out = R.serve(items.filter("session % 2 = 0"), computed, lengths)
    return out.select("session", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "from_cache", "recompute")


def als_top(spark: SparkSession, d: str) -> DataFrame:
    bought = purchase_events(spark, d).select(F.col("session").cast("int").alias("user"), F.col("aid").cast("int").alias("item"))
    dealt = bought.repartition(parts_for(spark, purchase_rows(spark, d)), "user", "item")
    return R.als_top(dealt.groupBy("user", "item").agg(F.count(F.lit(1)).cast("float").alias("weight")))


def dot_product_top(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose number 20 divides as users, all vectors as items."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    users = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("user"), F.col("embedding").alias("v"))
    return rounded(R.dot_product_top(users, rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 10), 5)


def uniform_negatives(spark: SparkSession, d: str) -> DataFrame:
    events = web_events(spark, d)
    return R.uniform_negatives(events, V.dense_ids(events, "aid"), 20, seed=None)


def evaluation_sets(spark: SparkSession, d: str) -> DataFrame:
    events = web_events(spark, d)
    samples = S.leave_one_out(S.sequences(events, shift=0))
    return R.evaluation_sets(samples, R.uniform_negatives(events, V.dense_ids(events, "aid"), 50, seed=None))


QUERIES = {
    "reciprocal_rank_recommend": reciprocal_rank,
    "candidates": candidates,
    "candidate_features": candidate_features,
    "candidate_labels": candidate_labels,
    "training_rows": training_rows,
    "batch_recommend": batch_recommend,
    "fallback_recommend": fallback_recommend,
    "fitted_recommend": fitted_recommend,
    "target_recommend": target_recommend,
    "target_submission": target_submission,
    "recommend_blocks": recommend_blocks,
    "submission": submission,
    "served_lists": served_lists,
    "als_top": als_top,
    "dot_product_top": dot_product_top,
    "uniform_negatives": uniform_negatives,
    "evaluation_sets": evaluation_sets,
}


def _graph(name: str, gap: int, k: int, weight: str, types: str = "") -> str:
    return f"""{name}_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, type DESC) AS i FROM history {types}) WHERE i <= 30),
    {name}_k AS (SELECT * FROM (SELECT x.session, x.aid, y.aid AS candidate_aid, x.ts, y.type AS type_y, row_number() OVER (PARTITION BY x.session, x.aid, y.aid ORDER BY x.ts DESC, y.ts DESC, y.type DESC) AS n FROM {name}_t AS x JOIN {name}_t AS y ON x.session = y.session AND x.aid <> y.aid AND abs(x.ts - y.ts) < {gap}) WHERE n = 1),
    {name}_g AS (SELECT aid, candidate_aid, wgt, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY wgt DESC, candidate_aid) AS r FROM
        (SELECT aid, candidate_aid, CAST(sum(CAST({weight} AS DECIMAL(28, 9))) AS DOUBLE) AS wgt FROM {name}_k, (SELECT min(ts) AS t0, max(ts) AS t1 FROM {name}_k) GROUP BY aid, candidate_aid)) WHERE r <= {k})"""


_FOUND = (
    WEB_SQL,
    _PARTS,
    _graph("clicks", 86_400_000, 20, "1.0 + 3.0 * CAST(ts - t0 AS DOUBLE) / greatest(t1 - t0, 1)"),
    _graph("cart_order", 86_400_000, 15, "CASE type_y WHEN 'clicks' THEN 1 WHEN 'carts' THEN 6 ELSE 3 END"),
    _graph("buy2buy", 14 * 86_400_000, 15, "1", "WHERE type IN ('carts', 'orders')"),
    "popular AS (SELECT DISTINCT aid FROM (" + _POPULAR.format("(SELECT * FROM history WHERE ts >= (SELECT max(ts) FROM history) - 604800000)", 20) + "))",
    "seen AS (SELECT DISTINCT session, aid FROM history)",
    """tagged AS (SELECT session, aid AS candidate_aid, 'history' AS source, NULL AS rank, NULL AS wgt FROM seen UNION ALL SELECT session, popular.aid, 'popular', NULL, NULL FROM (SELECT DISTINCT session FROM seen), popular
        UNION ALL SELECT session, candidate_aid, 'clicks', rank, wgt FROM seen JOIN clicks_g USING (aid) UNION ALL SELECT session, candidate_aid, 'cart_order', rank, wgt FROM seen JOIN cart_order_g USING (aid) UNION ALL SELECT session, candidate_aid, 'buy2buy', rank, wgt FROM seen JOIN buy2buy_g USING (aid))""",
    "found AS (SELECT session, candidate_aid, " + ", ".join(f"max((source = '{s}')::INT) AS source_{s}" for s in R.SOURCES) + ", " + ", ".join(f"CAST(coalesce(min(rank) FILTER (source = '{g}'), 999) AS INT) AS rank_{g}, coalesce(max(wgt) FILTER (source = '{g}'), 0) AS wgt_{g}" for g in R.GRAPHS) + " FROM tagged GROUP BY ALL)",
)
_SCORE = " + ".join(f"{c} * {w}" for c, w in _WEIGHTS.items())
_BEST = f"best AS (SELECT session, CAST(r AS INT) AS rank, candidate_aid AS aid, score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, candidate_aid) AS r FROM (SELECT session, candidate_aid, CAST({_SCORE} AS DOUBLE) AS score FROM found)))"
_LABELS = "labels0 AS (SELECT f.session, f.candidate_aid, CAST(h.aid IS NOT NULL AS INT) AS label FROM found AS f LEFT JOIN (SELECT DISTINCT session, aid FROM future WHERE type = 'clicks') AS h ON f.session = h.session AND f.candidate_aid = h.aid)"
_ITEM = "SELECT aid AS candidate_aid, count(*) AS n_{0}, count(*) FILTER (type = 'clicks') AS click_{0}, count(*) FILTER (type = 'carts') AS cart_{0}, count(*) FILTER (type = 'orders') AS order_{0}, count(DISTINCT session) AS sessions_{0}, cart_{0} / (click_{0} + 10) AS cart_ratio_{0}, order_{0} / (click_{0} + 10) AS buy_ratio_{0}, order_{0} / (cart_{0} + 10) AS cart_buy_ratio_{0} FROM {1} GROUP BY aid"
_NUMBERS = ("n", "click", "cart", "order", "sessions", "cart_ratio", "buy_ratio", "cart_buy_ratio")
_FILLED = ", ".join(f"coalesce({c}_{w}, 0) AS {c}_{w}" for w in ("all", "7d") for c in _NUMBERS)
_FEATURES = (
    *_FOUND,
    "i_all AS (" + _ITEM.format("all", "history") + ")",
    "i_7d AS (" + _ITEM.format("7d", "(SELECT * FROM history WHERE ts >= (SELECT max(ts) FROM history) - 604800000)") + ")",
    "s_f AS (SELECT session, count(*) AS session_length, count(DISTINCT aid) AS unique_aids, max(ts) AS session_end_ts, (max(ts) - min(ts)) // 1000 AS duration_sec, count(*) FILTER (type = 'clicks') AS n_clicks, count(*) FILTER (type = 'carts') AS n_carts, count(*) FILTER (type = 'orders') AS n_orders, n_carts / (session_length + 1) AS cart_ratio, n_orders / (session_length + 1) AS order_ratio, arg_max(aid, (ts, aid)) AS last_aid FROM history GROUP BY session)",
    "x_f AS (SELECT session, aid AS candidate_aid, count(*) AS reps, max(ts) AS item_last_ts FROM history GROUP BY ALL)",
    f"""base AS (SELECT found.*, {_FILLED}, s_f.* EXCLUDE (session, last_aid), coalesce(reps, 0) AS repetitions, coalesce((session_end_ts - item_last_ts) / 1000.0, 604800) AS recency_sec, coalesce(CAST(candidate_aid = last_aid AS INT), 0) AS is_last_viewed
        FROM found LEFT JOIN i_all USING (candidate_aid) LEFT JOIN i_7d USING (candidate_aid) LEFT JOIN s_f USING (session) LEFT JOIN x_f USING (session, candidate_aid))""",
    """wide AS (SELECT *, ln(1 + recency_sec) AS log_recency, click_7d / (click_all + 10) AS click_trend_7d, order_7d / (order_all + 10) AS order_trend_7d, buy_ratio_7d - buy_ratio_all AS conversion_trend_diff, rank_clicks - rank_buy2buy AS rank_diff_click_b2b, rank_cart_order - rank_buy2buy AS rank_diff_buy_b2b,
        2 * wgt_buy2buy + wgt_cart_order AS combined_buy_weight, CAST(repetitions > 1 AS INT) AS is_repeated, wgt_buy2buy / (ln(1 + recency_sec) + 1) AS wgt_b2b_decayed, wgt_clicks / (ln(1 + recency_sec) + 1) AS wgt_clicks_decayed, least(rank_clicks, rank_cart_order, rank_buy2buy) AS min_rank_1,
        rank_clicks + rank_cart_order + rank_buy2buy - least(rank_clicks, rank_cart_order, rank_buy2buy) - greatest(rank_clicks, rank_cart_order, rank_buy2buy) AS min_rank_2, (rank_clicks < 999)::INT + (rank_cart_order < 999)::INT + (rank_buy2buy < 999)::INT AS n_sources_present FROM base)""",
)
_ROUND = ("wgt_clicks", "wgt_cart_order", "wgt_buy2buy", *(f"{c}_{w}" for w in ("all", "7d") for c in _NUMBERS[5:]), "cart_ratio", "order_ratio", "recency_sec", "log_recency", "click_trend_7d", "order_trend_7d", "conversion_trend_diff", "combined_buy_weight", "wgt_b2b_decayed", "wgt_clicks_decayed")

_RECIPROCAL = """SELECT session, CAST(rank AS INT) AS rank, aid, round(score, 6) AS score,
        CASE WHEN rank <= n // 3 + n % 3 THEN 'orders' WHEN rank <= n // 3 * 2 + n % 3 THEN 'carts' ELSE 'clicks' END AS objective
    FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place) AS rank, count(*) OVER (PARTITION BY session) AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, aid) AS place FROM
            (SELECT session, aid2 AS aid, CAST(sum(CAST(1.0 / rank AS DECIMAL(20, 12))) AS DOUBLE) AS score FROM seen JOIN edges ON seen.aid = edges.aid1 GROUP BY 1, 2))
        JOIN (SELECT session, count(*) AS n_seen FROM seen GROUP BY 1) USING (session) ANTI JOIN seen USING (session, aid) WHERE place <= 20 + n_seen)"""
_SEEN = "seen AS (SELECT DISTINCT session, aid FROM ev)"


def _targets(body: str) -> str:
    """``body`` over best: the candidates of each target in order of its score."""
    parts = []
    for kind, weights in _TARGET_WEIGHTS.items():
        score = " + ".join(f"{c} * {w}" for c, w in weights.items())
        parts.append(f"SELECT session, '{kind}' AS type, candidate_aid AS aid, CAST({score} AS DOUBLE) AS score FROM found")
    ranked = "SELECT *, row_number() OVER (PARTITION BY session, type ORDER BY score DESC, aid) AS r FROM (" + " UNION ALL ".join(parts) + ")"
    return _sql(body, *_FOUND, f"targeted AS ({ranked})")


_NEGATIVES = """ii AS (SELECT aid, row_number() OVER (ORDER BY aid) - 1 AS dense FROM (SELECT DISTINCT aid FROM ev)),
    negatives AS (SELECT DISTINCT session, aid FROM (SELECT session, (session * 7919 + k * 104729) % (SELECT count(*) FROM ii) AS dense FROM (SELECT DISTINCT session FROM ev), unnest(range({0})) AS u(k)) JOIN ii USING (dense)
        ANTI JOIN (SELECT DISTINCT session, aid FROM ev) USING (session, aid))"""

ORACLES = {
    "reciprocal_rank_recommend": _sql(_RECIPROCAL, PURCHASE_SQL, _unified(MONTH_MS), _SEEN),
    "target_recommend": _targets("SELECT session, type, CAST(r AS INT) AS rank, aid, round(score, 6) AS score FROM targeted WHERE r <= 20"),
    "target_submission": _targets("SELECT session || '_' || type AS session_type, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY r) AS labels FROM targeted WHERE r <= 20 GROUP BY session, type"),
    "uniform_negatives": _sql("SELECT session, aid FROM negatives", WEB_SQL, _NEGATIVES.format(20)),
    "evaluation_sets": _sql("""SELECT session, aid, 1 AS is_target FROM target UNION ALL SELECT session, aid, 0 FROM negatives ANTI JOIN target USING (session, aid)""", WEB_SQL, _NEGATIVES.format(50),
        "target AS (SELECT session, aid FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, type DESC) AS r, count(*) OVER (PARTITION BY session) AS n FROM ev) WHERE r = 1 AND n >= 2)"),
    "candidates": _sql("SELECT * REPLACE (round(wgt_clicks, 6) AS wgt_clicks, round(wgt_cart_order, 6) AS wgt_cart_order, round(wgt_buy2buy, 6) AS wgt_buy2buy) FROM found", *_FOUND),
    "candidate_features": _sql("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND) + ") FROM wide", *_FEATURES),
    "candidate_labels": _sql("SELECT * FROM labels0", *_FOUND, _LABELS),
    "training_rows": _sql("""SELECT session, candidate_aid, click_all, label FROM r WHERE label = 1 UNION ALL SELECT session, candidate_aid, click_all, label FROM hard WHERE p <= h UNION ALL SELECT session, candidate_aid, click_all, label FROM
        (SELECT *, row_number() OVER (ORDER BY (session * 31 + candidate_aid) % 1009, session, candidate_aid) AS q FROM hard WHERE p > h) WHERE q <= n - h""", *_FEATURES, _LABELS,
        "r AS (SELECT session, candidate_aid, click_all, label FROM labels0 JOIN (SELECT session, candidate_aid, click_all FROM wide) USING (session, candidate_aid))",
        "m AS (SELECT n, CAST(floor(n * 0.5) AS BIGINT) AS h FROM (SELECT least(20 * sum(label), count(*) FILTER (label = 0)) AS n FROM r))",
        "hard AS (SELECT *, row_number() OVER (ORDER BY click_all DESC, session, candidate_aid) AS p FROM r, m WHERE label = 0)"),
    "batch_recommend": _sql("SELECT session, rank, aid, round(score, 6) AS score FROM best WHERE rank <= 20", *_FOUND, _BEST),
    "fallback_recommend": _sql(f"""SELECT session, CAST(r AS INT) AS rank, aid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, f, aid) AS r FROM (SELECT session, aid, max(score) AS score, min(f) AS f FROM
        (SELECT session, candidate_aid AS aid, CAST({_SCORE} AS DOUBLE) AS score, 0 AS f FROM found WHERE source_clicks = 1 UNION ALL SELECT session, pop.aid, -99, rank FROM (SELECT DISTINCT session FROM seen), (SELECT * FROM ({_POPULAR.format("history", 20)}) WHERE event_type = 'clicks') AS pop) GROUP BY ALL) ANTI JOIN seen USING (session, aid)) WHERE r <= 20""", *_FOUND),
    "recommend_blocks": _sql("SELECT session, CASE WHEN rank <= 5 THEN 'clicks' WHEN rank <= 10 THEN 'carts' ELSE 'orders' END AS type, CAST((rank - 1) % 5 + 1 AS INT) AS rank, aid FROM best WHERE rank <= 15", *_FOUND, _BEST),
    "submission": _sql("SELECT session || '_' || t AS session_type, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY rank) AS labels FROM best, unnest(['clicks', 'carts', 'orders']) AS u(t) WHERE rank <= 20 GROUP BY session, t", *_FOUND, _BEST),
    "served_lists": _sql("""SELECT e.session, CASE WHEN e.session % 2 = 0 THEN cached ELSE coalesce(computed, '') END AS items, e.session % 2 = 0 AS from_cache, length >= 5 AS recompute FROM
        (SELECT session, count(*) AS length, array_to_string(list_sort(list_distinct(array_agg(aid)))[:3], ' ') AS cached FROM ev GROUP BY session) AS e
        LEFT JOIN (SELECT session, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY rank) AS computed FROM rr GROUP BY session) AS c ON e.session = c.session""",
        PURCHASE_SQL, _unified(MONTH_MS), _SEEN, f"rr AS ({_RECIPROCAL})"),
    "dot_product_top": "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT \"user\", CAST(r AS INT) AS rank, item, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, item) AS r FROM (SELECT a.vec_id AS \"user\", b.vec_id AS item, list_inner_product(a.v, b.v) AS score FROM e AS a, e AS b WHERE a.vec_id % 20 = 0)) WHERE r <= 10",
}
