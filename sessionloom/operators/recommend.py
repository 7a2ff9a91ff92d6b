"""Candidates, their features, training rows, and recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import constants as C
from sessionloom.operators import items as I
from sessionloom.operators import sessions as S
from sessionloom.operators.ordered import among_first
from sessionloom.sources.events import parts_for
from sessionloom.sources.folders import shared_folder

SOURCES = ("history", "popular", "clicks", "cart_order", "buy2buy")
GRAPHS = SOURCES[2:]


#: Rows of sessions that a task takes before they are written out as candidates.
DEALT = 1 << 16


def dealt_by_session(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows by session, in so many parts that what sessions group, join and rank moves no more and stays in a task's memory."""
    return rows.repartition(parts_for(rows.sparkSession, n, DEALT), "session")


def reciprocal_rank(history: DataFrame, neighbours: DataFrame, k: int = 20, depth: int = 20) -> DataFrame:
    """Score candidates by the sum of 1 / place over the session's distinct items; (session, rank, aid, score, objective).

    neighbours: (aid, candidates array of structs with aid2). Of the best k + (number of seen items) the seen are left out; what is left
    goes to orders, carts and clicks in thirds, orders first, the remainder of the division too. Ties to the smaller id.
    """
    seen = history.select("session", "aid").distinct()
    near = neighbours.select("aid", F.transform(F.slice("candidates", 1, depth), lambda c: c["aid2"]).alias("near"))
    # lists move to their session's task as they are; what they hold is grouped and ranked there
    met = dealt_by_session(seen.join(near, "aid", "left"), history.count())
    # whole billionths of thousandths: their sums do not depend on the order of addition
    shown = F.transform("near", lambda aid, at: F.struct(aid.alias("aid"), F.round(F.lit(1e12) / (at + 1)).cast("long").alias("part"), F.lit(0).alias("was_seen")))
    own_item = F.array(F.struct("aid", F.lit(None).cast("long").alias("part"), F.lit(1).alias("was_seen")))
    both = met.select("session", F.explode(F.concat(own_item, F.coalesce(shown, F.slice(own_item, 1, 0)))).alias("x")).select("session", "x.*")
    items = both.groupBy("session", "aid").agg((F.sum("part") / F.lit(1e12)).alias("score"), F.max("was_seen").alias("was_seen"))
    own = Window.partitionBy("session")
    places = items.withColumns({"place": F.row_number().over(own.orderBy(F.desc_nulls_last("score"), "aid")), "n_seen": F.sum("was_seen").over(own)})
    fresh = places.filter("was_seen = 0 and score is not null").filter(F.col("place") <= k + F.col("n_seen"))
    by = Window.partitionBy("session")
    out = fresh.withColumns({"rank": F.row_number().over(by.orderBy("place")), "n": F.count(F.lit(1)).over(by)})
    third = F.floor(F.col("n") / 3)
    first = third + F.col("n") % 3
    objective = F.when(F.col("rank") <= first, C.ORDER).when(F.col("rank") <= first + third, C.CART).otherwise(C.CLICK)
    return out.select("session", "rank", "aid", "score", objective.alias("objective"))


#: Items whose neighbour lists, and whose features, every task may hold: about 10 MB.
HELD_LISTS, HELD_ITEMS = 1 << 13, 1 << 16
#: What candidates may carry of the session's own events with the item.
CARRIED = ("repetitions", "item_last_ts", "item_first_ts")
_ENTRY = "struct<candidate_aid: long, source: int, rank: int, wgt: double>"


def _entry(aid: str | Column, source: int, rank: str | None = None, wgt: str | None = None) -> Column:
    value = lambda c: F.lit(None) if c is None else F.col(c)
    return F.struct((F.col(aid) if isinstance(aid, str) else aid).alias("candidate_aid"), F.lit(source).alias("source"), value(rank).alias("rank"), value(wgt).alias("wgt")).cast(_ENTRY)


def candidates(history: DataFrame, graphs: dict[str, DataFrame], popular: DataFrame, truth: DataFrame | None = None, carry: bool = False) -> DataFrame:
    """Distinct (session, candidate_aid) of five sources with a flag a source, and for each graph the least rank and greatest weight.

    An absent rank is 999, an absent weight 0. ``popular`` is a short list of items (aid). Items seen, with their neighbour lists, move to their session
    and are written out and grouped there, so candidates themselves do not move; the lists of a small catalogue do not either. With ``carry`` come the
    session's repetitions and times of the item, with ``truth`` (session, type, ground_truth) flags ``hit_...`` of each type.
    """
    near = None
    for k, g in enumerate(GRAPHS, 2):
        part = graphs[g].select("aid", _entry("candidate_aid", k, "rank", "wgt").alias("x"))
        near = part if near is None else near.unionByName(part)
    near = near.groupBy("aid").agg(F.collect_list("x").alias("near"))
    seen = S.interaction_features(history).withColumnsRenamed({"last_ts": "item_last_ts", "first_ts": "item_first_ts"}).withColumns({"own": F.lit(True), "more": F.lit(None).cast(f"array<{_ENTRY}>")})
    n, small = history.count(), history.select("aid").distinct().count() <= HELD_LISTS
    # the popular list has at most a few items a type
    listed = popular.agg(F.collect_list(_entry("aid", 1)).alias("more"))
    parts = [history.select("session").distinct().crossJoin(F.broadcast(listed))]
    types = {t: 2 + len(GRAPHS) + k for k, t in enumerate(C.EVENT_TYPES)}
    if truth is not None:
        for t, source in types.items():
            hits = F.transform("ground_truth", lambda aid: _entry(aid, source))  # noqa: B023
            parts.append(truth.filter(F.col("type") == t).select("session", hits.alias("more")))
    moved = seen if small else seen.join(near, "aid", "left")
    for p in parts:
        moved = moved.unionByName(p, allowMissingColumns=True)
    moved = dealt_by_session(moved, n)
    if small:
        moved = moved.join(F.broadcast(near), "aid", "left")
    nothing = F.array().cast(f"array<{_ENTRY}>")
    own = F.when(F.col("own"), F.array(_entry("aid", 0))).otherwise(nothing)
    rows = moved.select("session", F.explode(F.concat(own, *(F.coalesce(c, nothing) for c in ("near", "more")))).alias("x"), *CARRIED).select("session", "x.*", *CARRIED)
    of = lambda k, c: F.when(F.col("source") == k, F.col(c))
    flags = [F.max((F.col("source") == k).cast("int")).alias(f"source_{s}") for k, s in enumerate(SOURCES)]
    best = [c for k, g in enumerate(GRAPHS, 2) for c in (F.coalesce(F.min(of(k, "rank")), F.lit(C.RANK_MISSING)).alias(f"rank_{g}"), F.coalesce(F.max(of(k, "wgt")), F.lit(0.0)).alias(f"wgt_{g}"))]
    also = [F.max(of(0, c)).alias(c) for c in CARRIED] if carry else []
    if truth is not None:
        also += [F.max((F.col("source") == k).cast("int")).alias(f"hit_{t}") for t, k in types.items()]
    found = rows.groupBy("session", "candidate_aid").agg(*flags, *best, *also)
    return found if truth is None else found.filter(F.greatest(*(f"source_{s}" for s in SOURCES)) == 1)


def assemble(found: DataFrame, history: DataFrame, events: DataFrame, recent_days: int = 7) -> DataFrame:
    """Candidates with item features (all time and recent), session and interaction features, and what derives from them.

    Interaction features are taken from candidates that carry them; then candidates of a catalogue of up to HELD_ITEMS items do not move.
    """
    carried = [c for c in CARRIED if c in found.columns]
    items = I.item_features(events, "all").join(I.item_features(I.recent(events, recent_days), "7d"), "aid", "left").withColumnRenamed("aid", "candidate_aid")
    if events.select("aid").distinct().count() <= HELD_ITEMS:
        items = F.broadcast(items)
    of_session = S.session_features(history).join(S.last_items(history).select("session", "last_aid"), "session", "left")
    rows = found.join(items, "candidate_aid", "left").join(of_session, "session", "left")
    if not carried:
        inter = S.interaction_features(history).withColumnRenamed("aid", "candidate_aid").withColumnsRenamed({"last_ts": "item_last_ts", "first_ts": "item_first_ts"})
        rows = rows.join(inter, ["session", "candidate_aid"], "left")
    rows = rows.select("session", "candidate_aid", *(c for c in rows.columns if c not in ("session", "candidate_aid", "last_aid", *CARRIED)), *CARRIED, "last_aid")
    r = {g: F.col(f"rank_{g}") for g in GRAPHS}
    least, most = F.least(*r.values()), F.greatest(*r.values())
    filled = [c for c in rows.columns if c not in ("session", "candidate_aid", "item_last_ts", "item_first_ts", "last_aid")]
    rows = rows.na.fill(0, filled).na.fill(0.0, filled)
    recency = F.coalesce((F.col("session_end_ts") - F.col("item_last_ts")) / 1000.0, F.lit(float(C.RECENCY_MISSING)))
    rows = rows.withColumn("recency_sec", recency).withColumn("log_recency", F.log1p("recency_sec"))
    return rows.withColumns({
        "click_trend_7d": F.col("click_7d") / (F.col("click_all") + 10),
        "order_trend_7d": F.col("order_7d") / (F.col("order_all") + 10),
        "conversion_trend_diff": F.col("buy_ratio_7d") - F.col("buy_ratio_all"),
        "rank_diff_click_b2b": r["clicks"] - r["buy2buy"],
        "rank_diff_buy_b2b": r["cart_order"] - r["buy2buy"],
        "combined_buy_weight": 2 * F.col("wgt_buy2buy") + F.col("wgt_cart_order"),
        "is_last_viewed": F.coalesce((F.col("candidate_aid") == F.col("last_aid")).cast("int"), F.lit(0)),
        "is_repeated": (F.col("repetitions") > 1).cast("int"),
        "wgt_b2b_decayed": F.col("wgt_buy2buy") / (F.col("log_recency") + 1),
        "wgt_clicks_decayed": F.col("wgt_clicks") / (F.col("log_recency") + 1),
        "min_rank_1": least,
        "min_rank_2": r["clicks"] + r["cart_order"] + r["buy2buy"] - least - most,
        "n_sources_present": sum(((x < C.RANK_MISSING).cast("int") for x in r.values()), F.lit(0)),
    }).drop("item_last_ts", "item_first_ts", "last_aid")


def labelled(found: DataFrame, truth: DataFrame, kind: str) -> DataFrame:
    """Candidates with ``label``: 1 if the item comes with that type. truth: (session, type, ground_truth); candidates that have flags of it need no join."""
    if f"hit_{kind}" in found.columns:
        return found.withColumn("label", F.col(f"hit_{kind}"))
    hits = truth.filter(F.col("type") == kind).select("session", F.explode("ground_truth").alias("candidate_aid")).distinct().withColumn("hit", F.lit(1))
    return found.join(hits, ["session", "candidate_aid"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def training_rows(rows: DataFrame, popularity: str = "click_all", per_positive: int = C.NEGATIVES_PER_POSITIVE, popular_share: float = C.POPULAR_SHARE, seed: int | None = 42) -> DataFrame:
    """All positives and min(per_positive times as many, all) negatives: the most popular first half, the rest random among the others.

    Random order is a hash of the keys with the seed (without a seed an arithmetic rule, session * 31 + item modulo 1009). The rows are kept while
    the cuts are sought (see ``ordered.among_first``), so that they are made once; (session, candidate_aid) are distinct.
    """
    draw = F.pmod(F.col("session") * 31 + F.col("candidate_aid"), F.lit(1009)) if seed is None else F.xxhash64("session", "candidate_aid", F.lit(seed))
    kept = rows.withColumn("draw", draw).persist(StorageLevel.MEMORY_AND_DISK)
    positive, negative = kept.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count_if(F.col("label") == 0)).first()
    n = min(positive * per_positive, negative)
    hard_n = int(popular_share * n)
    negatives = kept.filter("label = 0")
    keys = ["session", "candidate_aid"]
    hard = among_first(negatives, [(popularity, True), *((c, False) for c in keys)], hard_n)
    rest = among_first(negatives.filter(~hard), [("draw", False), *((c, False) for c in keys)], n - hard_n)
    return kept.filter((F.col("label") == 1) | ((F.col("label") == 0) & (hard | rest))).drop("draw")


def uniform_negatives(history: DataFrame, items: DataFrame, per_session: int = 20, seed: int | None = 42, unseen: bool = True) -> DataFrame:
    """Random items for each session, by a hash of session and number; ``unseen`` leaves the session's own items out (then there may be fewer).

    Without a seed the draw is an arithmetic rule: session * 7919 + number * 104729, modulo the number of items.

    items: (aid, dense) with dense numbers from 0, see ``covisit.dense_ids``.
    """
    n = items.count()
    draws = history.select("session").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_session - 1))))
    draw = F.col("session") * 7919 + F.col("k") * 104729 if seed is None else F.xxhash64("session", "k", F.lit(seed))
    draws = draws.withColumn("dense", F.pmod(draw, F.lit(max(n, 1))))
    out = draws.join(items, "dense").select("session", "aid").distinct()
    return out.join(history.select("session", "aid").distinct(), ["session", "aid"], "left_anti") if unseen else out


def next_prime(n: int) -> int:
    """The least prime above n."""
    while True:
        n += 1
        if n > 1 and all(n % d for d in range(2, int(n**0.5) + 1)):
            return n


def exact_negatives(history: DataFrame, items: DataFrame, per_session: int = 20, seed: int | None = 42) -> DataFrame:
    """(session, aid, k): for each session exactly so many different items that it has not seen, in order of k from 1; all of them where there are fewer.

    A session walks over the item numbers by a stride of its own modulo a prime, so no number comes twice; a walk as long as what is asked for, what
    the session has seen and the numbers without an item always suffices. Start and stride are hashes of the session with the seed;
    without a seed session * 7919 and session * 104729.

    items: (aid, dense) with dense numbers from 0, see ``covisit.dense_ids``.
    """
    n = items.count()
    prime = next_prime(n)
    seen = history.select("session", "aid").distinct()
    sessions = seen.groupBy("session").agg(F.count(F.lit(1)).alias("seen"))
    start, stride = (F.col("session") * f if seed is None else F.xxhash64("session", F.lit(seed + f)) for f in (7919, 104729))
    steps = F.least(F.col("seen") + (per_session + prime - n), F.lit(prime))
    walks = sessions.withColumns({"start": F.pmod(start, F.lit(prime)), "stride": F.pmod(stride, F.lit(prime - 1)) + 1}).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)))
    drawn = walks.select("session", "step", F.pmod(F.col("start") + F.pmod(F.col("step") * F.col("stride"), F.lit(prime)), F.lit(prime)).alias("dense"))
    fresh = drawn.join(items, "dense").join(seen, ["session", "aid"], "left_anti")
    return fresh.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("step"))).filter(F.col("k") <= per_session).select("session", "aid", "k")


def evaluation_sets(samples: DataFrame, negatives: DataFrame) -> DataFrame:
    """Each session's target and its negatives: (session, aid, is_target)."""
    targets = samples.select("session", F.col("target").alias("aid"), F.lit(1).alias("is_target"))
    others = negatives.join(targets.select("session", "aid"), ["session", "aid"], "left_anti").withColumn("is_target", F.lit(0))
    return targets.unionByName(others.select("session", "aid", "is_target"))


def linear_score(weights: dict[str, float]) -> Callable[[DataFrame], DataFrame]:
    """A scorer by a weighted sum of features."""
    return lambda rows: rows.withColumn("score", sum((F.col(c).cast("double") * float(w) for c, w in weights.items()), F.lit(0.0)))


def centred(rows: DataFrame, features: list[str], group: str) -> DataFrame:
    """Features less their mean in the group, in columns c_...: what differs between the candidates of one session."""
    means = rows.groupBy(group).agg(*(F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features))
    joined = rows.join(means, group)
    return joined.withColumns({f"c_{c}": F.coalesce(F.col(c).cast("double") - F.col(f"m_{c}"), F.lit(0.0)) for c in features}).drop(*(f"m_{c}" for c in features))


def fit_ranker(rows: DataFrame, features: list[str], group: str | None = "session"):
    """(scorer, model): a ranker by Spark ML, and the pipeline that was fitted; the scorer adds ``score``.

    With a group it ranks inside it: a logistic regression without intercept on the features less their mean in the group, so that what all
    candidates of a session share has no say, as in a pairwise loss. Without one it is pointwise.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = (lambda d: centred(d, features, group)) if group else (lambda d: d)
    names = [f"c_{c}" for c in features] if group else features
    regression = LogisticRegression(featuresCol="_x", labelCol="label", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", regParam=0.01, maxIter=30, fitIntercept=not group)
    stages = [VectorAssembler(inputCols=names, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_x"), regression]
    model = Pipeline(stages=stages).fit(ready(rows))
    gone = ("_raw", "_x", "_p", "_r", "_c", *(names if group else ()))
    return (lambda d: model.transform(ready(d)).withColumn("score", vector_to_array("_p")[1]).drop(*gone)), model


def recommend_targets(rows: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], k: int = 20) -> DataFrame:
    """The k best candidates of each session for each target (event type), each by a scorer of its own: (session, type, rank, aid, score)."""
    out = None
    for kind, scorer in scorers.items():
        best = recommend(scorer(rows), k).select("session", F.lit(kind).alias("type"), "rank", "aid", "score")
        out = best if out is None else out.unionByName(best)
    return out


def recommend(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k best candidates of each session, ties to the smaller id: (session, rank, aid, score)."""
    ranked = I.top_by(scored.select("session", F.col("candidate_aid").alias("aid"), "score"), ["session"], [F.desc("score"), F.asc("aid")], k)
    return ranked.select("session", "rank", "aid", "score")


def with_fallback(scored: DataFrame, sessions: DataFrame, popular: DataFrame, seen: DataFrame | None = None, k: int = 20) -> DataFrame:
    """As recommend, filled up with popular items (score -99, by their rank) and, if given, without seen items."""
    fallback = sessions.select("session").distinct().crossJoin(F.broadcast(popular.select(F.col("aid").alias("candidate_aid"), F.col("rank").alias("fallback_rank"))))
    union = scored.select("session", "candidate_aid", "score", F.lit(0).alias("fallback_rank")).unionByName(fallback.select("session", "candidate_aid", F.lit(C.FALLBACK_SCORE).alias("score"), "fallback_rank"))
    best = union.groupBy("session", F.col("candidate_aid").alias("aid")).agg(F.max("score").alias("score"), F.min("fallback_rank").alias("fallback_rank"))
    if seen is not None:
        best = best.join(seen.select("session", "aid").distinct(), ["session", "aid"], "left_anti")
    ranked = I.top_by(best, ["session"], [F.desc("score"), F.asc("fallback_rank"), F.asc("aid")], k)
    return ranked.select("session", "rank", "aid", "score")


def blocks(recommended: DataFrame, k: int = 20) -> DataFrame:
    """Ranks 1 to 3k cut into clicks, carts and orders of k each."""
    kind = F.element_at(F.array(*map(F.lit, C.EVENT_TYPES)), (F.floor((F.col("rank") - 1) / k) + 1).cast("int"))
    return recommended.filter(F.col("rank") <= 3 * k).select("session", kind.alias("type"), ((F.col("rank") - 1) % k + 1).alias("rank"), "aid")


def submission(recommended: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(session_type, labels): items in rank order, space-joined. With ``types`` each list stands for every type, else the type column is used."""
    rows = recommended if types is None else recommended.withColumn("type", F.explode(F.array(*map(F.lit, types))))
    listed = rows.groupBy("session", "type").agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("x"))
    return listed.select(F.concat_ws("_", F.col("session").cast("string"), "type").alias("session_type"), F.array_join(F.transform("x", lambda y: y["aid"].cast("string")), " ").alias("labels"))


def dot_product_top(users: DataFrame, items: DataFrame, k: int = 20, block_rows: int = 4096) -> DataFrame:
    """Top k items of each user by dot product: (user, rank, item, score). users: (user, v); items: (item, v).

    Users and items meet in blocks of bounded size (a stated set of users against all items); each block keeps k rows a user.
    """
    import numpy as np
    import pyarrow as pa

    n_users, n_items = users.count(), items.count()
    a, b = max(1, -(-n_users // block_rows)), max(1, -(-n_items // block_rows))
    left = users.select("user", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("user"), F.lit(a)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("j"))
    right = items.select("item", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("item"), F.lit(b)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("i"))

    def meet(_, l: pa.Table, r: pa.Table) -> pa.Table:
        if not l.num_rows or not r.num_rows:
            return pa.table({"user": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = (np.array(t["v"].to_pylist(), float) for t in (l, r))
        ids, score = np.asarray(r["item"]), x @ y.T
        best = np.stack([np.lexsort((ids, -row))[:k] for row in score])
        row = np.repeat(np.arange(len(x)), best.shape[1])
        return pa.table({"user": pa.array(np.asarray(l["user"])[row], pa.int64()), "item": pa.array(ids[best.ravel()], pa.int64()), "score": pa.array(score[row, best.ravel()])})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "user long, item long, score double")
    return I.top_by(met, ["user"], [F.desc("score"), F.asc("item")], k).select("user", "rank", "item", "score")


def pruned_top(users: DataFrame, items: DataFrame, k: int = 20, levels: int = 6, block_rows: int = 4096, met: list[tuple[int, int]] | None = None) -> DataFrame:
    """As ``dot_product_top``, by levels of items from the longest vectors to the shortest.

    The first level has about 1 in 2 ** levels of the items, each further one as many as all before. A score is at most the product of both lengths,
    so a user whose k-th score is above that for all items still to come is done. ``met`` is told each level's users and items.
    """
    spark = users.sparkSession
    length = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    users, items = users.withColumn("length", length), items.withColumn("length", length)
    shares = [1 - 2.0 ** (level - levels) for level in range(levels)]
    cuts = items.agg(F.percentile_approx("length", shares, 10_000)).first()[0] or []
    best, open_users = None, users
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        part = items
        if low is not None:
            part = part.filter(F.col("length") >= low)
        if high is not None:
            part = part.filter(F.col("length") < high)
        top = part.agg(F.max("length")).first()[0]
        if top is None:
            continue
        if best is not None:
            last = best.groupBy(F.col("user").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
            # a little more than the bound, for its rounding
            may = F.col("n").isNull() | (F.col("n") < k) | (F.col("length") * (top * (1 + 1e-9)) >= F.col("kth"))
            open_users = users.join(last, F.col("user") == F.col("of"), "left").filter(may).select(users.columns)
        if met is not None:
            met.append((open_users.count(), part.count()))
        found = dot_product_top(open_users.select("user", "v"), part.select("item", "v"), k, block_rows).select("user", "item", "score")
        found = found if best is None else I.top_by(best.unionByName(found), ["user"], [F.desc("score"), F.asc("item")], k).select("user", "item", "score")
        path = shared_folder(spark, "best")
        found.write.parquet(path)
        best = spark.read.schema(found.schema).parquet(path)
    if best is None:
        return spark.createDataFrame([], "user long, rank int, item long, score double")
    return I.top_by(best, ["user"], [F.desc("score"), F.asc("item")], k).select("user", "rank", "item", "score")


#: Interactions of a block of the factorisation, on average at most.
RATED = 1 << 22


def als_top(interactions: DataFrame, k: int = 20, rank: int = 16, iterations: int = 5, seed: int = 42) -> DataFrame:
    """Implicit matrix factorisation and its top k items a user: (user, rank, item, score). interactions: (user int, item int, weight).

    A task of the fit holds a block of users or items with all their interactions, and the factors that these ask for: there are ten blocks, and more
    where they would have more than RATED interactions. With a checkpoint folder an iteration's shuffles need not stay until the fit ends.
    """
    from pyspark.ml.recommendation import ALS

    # kept, as the fit would make them once more only to log their partitions
    rows = interactions.persist(StorageLevel.DISK_ONLY)
    als = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, seed=seed, userCol="user", itemCol="item", ratingCol="weight", checkpointInterval=1)
    model = als.setNumBlocks(max(10, -(-rows.count() // RATED))).fit(rows)
    rows.unpersist()
    best = factor_top(model.userFactors, model.itemFactors, k)
    return best.select(F.col("user").cast("int").alias("user"), "rank", F.col("item").cast("int").alias("item"), "score")


#: Users of a block at most, and those and the items whose products are worked out at once.
BLOCK_USERS, TILE_USERS, TILE_ITEMS = 1 << 18, 512, 1024
_PACK = "block int, side int, top double, ids binary, vectors binary"


def _packs(side: int):
    """A batch of (block, id, features) as one row; ``top`` is the greatest length."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, x = np.asarray(batch["id"], np.int64), np.asarray(batch["features"].flatten(), np.float32)
                top = float(np.sqrt((x.reshape(len(ids), -1).astype(float) ** 2).sum(1).max()))
                yield pa.RecordBatch.from_pydict({"block": batch["block"][:1], "side": pa.array([side], pa.int32()), "top": [top], "ids": [ids.tobytes()], "vectors": [x.tobytes()]})

    return run


class _Best:
    """The k greatest products so far of each user of a block, equal ones by ascending item."""

    def __init__(self, ids, vectors, k: int):
        import numpy as np

        self.ids, self.x, self.k = ids, vectors, k
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.score, self.item = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.open = np.arange(len(ids))
        self.product, self.hit = np.empty(TILE_USERS * TILE_ITEMS, np.float32), np.zeros(TILE_USERS * TILE_ITEMS, bool)
        # for an item of length 1, above the error of a product in single precision
        self.slack = self.length * (vectors.shape[1] * 2.0**-22)

    def add(self, ids, vectors, top: float) -> None:
        """Items of no more than that length, which is at most that of the call before."""
        import numpy as np

        most = (self.length[self.open] + self.slack[self.open]) * top
        self.open = self.open[most >= self.score[self.open, -1]]
        for at in range(0, len(self.open), TILE_USERS):
            here = self.open[at : at + TILE_USERS]
            x, slack = self.x[here], self.slack[here] * top
            least, found, n = self.score[here, -1] - slack, [], 0
            for first in range(0, len(ids), TILE_ITEMS):
                y = vectors[first : first + TILE_ITEMS]
                s = np.matmul(x, y.T, out=self.product[: len(x) * len(y)].reshape(len(x), len(y)))
                if len(y) > self.k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(s, len(y) - self.k, 1)[:, -self.k] - 2 * slack)
                row, col = self._reach(s, least.astype(np.float32))
                if len(row):
                    found.append((here[row], first + col))
                    n += len(row)
                if n and (n >= self.k * len(here) or first + TILE_ITEMS >= len(ids)):
                    row, col = (np.concatenate(v) for v in zip(*found, strict=True))
                    # what single precision let through is worked out in double, the same whatever else is in the tile
                    self._merge(row, ids[col], (self.x[row].astype(float) * vectors[col]).sum(1))
                    least, found, n = self.score[here, -1] - slack, [], 0

    def _reach(self, s, least):
        """Row and column of what is not below its row's least."""
        import numpy as np

        some = np.flatnonzero(s.max(1) >= least)
        if 2 * len(some) < len(s):
            s, least = s[some], least[some]
        else:
            some = np.arange(len(s))
        # they are few: eight at a time
        n = -(-s.size // 8) * 8
        np.greater_equal(s, least[:, None], out=self.hit[: s.size].reshape(s.shape))
        self.hit[s.size : n] = False
        near = (np.flatnonzero(self.hit[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        row, col = np.divmod(near[self.hit[near]], s.shape[1])
        return some[row], col

    def _merge(self, row, item, score) -> None:
        import numpy as np

        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        item, score = np.concatenate([self.item[touched].ravel(), item]), np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((item, -score, row))
        count = np.bincount(np.searchsorted(touched, row))
        kept = order[np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) < self.k]
        self.item[touched], self.score[touched] = item[kept].reshape(-1, self.k), score[kept].reshape(-1, self.k)


def factor_top(users: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Exact top k items of each user by the product of their factors, ties to the smaller item: (user, rank, item, score). users, items: (id, features).

    A task has a block of users and meets all items in packs, longest first, of which it holds one at a time; what a task keeps are k items a user. Users
    whose k-th product no shorter item can reach are left out, one by one. The items move once a block; all pairs are otherwise multiplied, as the job is.
    """
    import numpy as np
    import pyarrow as pa

    n_users = users.count()
    n = max(1, min(24, -(-n_users // 4096)), -(-n_users // BLOCK_USERS))
    named = "block int, id long, features array<float>"
    left = users.select(F.col("id").cast("long").alias("id"), "features").repartition(n).select(F.spark_partition_id().alias("block"), "id", "features")
    length = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    right = items.withColumn("length", length).orderBy(F.desc("length")).select(F.lit(0).alias("block"), F.col("id").cast("long").alias("id"), "features")
    packs = right.to(_schema(named)).mapInArrow(_packs(1), _PACK).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    both = left.to(_schema(named)).mapInArrow(_packs(0), _PACK).unionByName(packs)

    def run(batches):
        block, held, best = None, [], None

        def done():
            if best is not None:
                found = np.isfinite(best.score)
                row, place = np.nonzero(found)
                for a in range(0, len(row), 65536):
                    r, p = row[a : a + 65536], place[a : a + 65536]
                    yield pa.RecordBatch.from_pydict({"user": best.ids[r], "rank": pa.array(p + 1, pa.int32()), "item": best.item[r, p], "score": best.score[r, p]})

        for batch in batches:
            for number, side, top, ids, vectors in zip(*(batch[c] for c in ("block", "side", "top", "ids", "vectors")), strict=True):
                if number.as_py() != block:
                    yield from done()
                    block, held, best = number.as_py(), [], None
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                vectors = np.frombuffer(vectors.as_buffer(), np.float32).reshape(len(ids), -1)
                if side.as_py() == 0:
                    held.append((ids.copy(), vectors.copy()))
                    continue
                if best is None and held:
                    best = _Best(*(np.concatenate(v) for v in zip(*held, strict=True)), k)
                if best is not None:
                    best.add(ids, vectors, top.as_py())
        yield from done()

    met = both.repartition(n, "block").sortWithinPartitions("block", "side", F.desc("top"))
    return met.mapInArrow(run, "user long, rank int, item long, score double")


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def serve(cache: DataFrame, computed: DataFrame, lengths: DataFrame, least: int = 5) -> DataFrame:
    """What a session gets: its cached list, else the computed one; and whether it is long enough to be computed anew. cache, computed: (session, items)."""
    rows = lengths.join(cache.withColumnRenamed("items", "cached"), "session", "left").join(computed.withColumnRenamed("items", "fresh"), "session", "left")
    return rows.select("session", F.coalesce("cached", "fresh", F.array().cast("array<long>")).alias("items"), F.col("cached").isNotNull().alias("from_cache"), (F.col("length") >= least).alias("recompute"))
