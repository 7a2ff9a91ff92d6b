"""Small fixtures with hand-computed results."""

import pytest

from sessionloom.functions import normalize as N
from sessionloom.operators import covisit as V
from sessionloom.operators import evaluate as E
from sessionloom.operators import interactions as N2
from sessionloom.operators import items as I
from sessionloom.operators import recommend as R
from sessionloom.operators import sessions as S
from sessionloom.operators import splits as P
from sessionloom.sources.settings import read_settings
from sessionloom.streaming import sinks as K
from sessionloom.streaming import unified as U

EVENTS = "session long, aid long, ts long, type string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_unified_bonus_and_symmetry(spark):
    e = events(spark, [(1, 1, 0, "clicks"), (1, 2, 1000, "carts"), (1, 1, 2000, "orders")])
    assert {(r.aid1, r.aid2, r.wgt) for r in V.unified_edges(e).collect()} == {(1, 2, 10), (2, 1, 10)}
    assert [(r.aid, [tuple(c) for c in r.candidates]) for r in V.adjacency(V.unified_edges(e)).orderBy("aid").collect()] == [(1, [(2, 10.0)]), (2, [(1, 10.0)])]


def test_unified_time_limit_is_strict(spark):
    at = lambda ts: V.unified_edges(events(spark, [(1, 1, 0, "clicks"), (1, 2, ts, "clicks")])).count()
    assert at(86_400_000) == 0 and at(86_399_999) == 2


def test_unified_window_and_tail(spark):
    seven = events(spark, [(1, a, a * 1000, "clicks") for a in range(7)])
    assert {r.aid2 for r in V.unified_edges(seven).filter("aid1 = 0").collect()} == {1, 2, 3, 4, 5}
    many = events(spark, [(1, a, a * 1000, "clicks") for a in range(31)])
    assert V.unified_edges(many).filter("aid1 = 0").count() == 0


def test_reciprocal_rank(spark):
    near = spark.createDataFrame([(1, [(5, 1.0), (6, 1.0), (7, 1.0)]), (2, [(6, 1.0), (8, 1.0)])], "aid long, candidates array<struct<aid2 long, wgt double>>")
    out = R.reciprocal_rank(events(spark, [(9, 1, 0, "clicks"), (9, 2, 1, "clicks")]), near).orderBy("rank").collect()
    assert [(r.aid, r.objective) for r in out] == [(6, "orders"), (5, "orders"), (8, "carts"), (7, "clicks")]
    assert [round(r.score, 6) for r in out] == [1.5, 1.0, 0.5, 0.333333]


def test_ranking_metrics(spark):
    p = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 2)], "session long, rank int, aid long")
    r = E.ranking_metrics(p, spark.createDataFrame([(1, 1), (1, 9)], "session long, aid long"), 3).first()
    assert (r.recall, r.mrr) == (0.5, 0.5) and r.ndcg == pytest.approx(0.386853, abs=1e-6)


def test_competition_recall(spark):
    truth = [(1, "clicks", 1)] + [(2, "clicks", a) for a in range(100, 125)]
    predicted = [(1, "clicks", 1, 1)] + [(2, "clicks", k + 1, 100 + k if k < 10 else k) for k in range(20)]
    out = E.competition_recall(spark.createDataFrame(predicted, "session long, type string, rank int, aid long"), spark.createDataFrame(truth, "session long, type string, aid long")).first()
    assert out.recall == pytest.approx(11 / 21)


def test_future_labels(spark):
    e = events(spark, [(1, 1, 1, "clicks"), (1, 2, 2, "carts"), (1, 3, 3, "clicks"), (1, 4, 4, "orders")])
    out = [(r.aid, r.next_click, r.later_carts, r.later_orders) for r in P.future_labels(e).orderBy("ts").collect()]
    assert out == [(1, 3, [2], [4]), (2, 3, [], [4]), (3, None, [], [4])]


def test_funnel_without_clicks(spark):
    r = S.funnel(events(spark, [(1, 1, 1, "carts")])).first()
    assert (r.click_to_cart_rate, r.cart_to_order_rate, r.click_to_order_rate) == (0.0, 0.0, 0.0)
    assert S.funnel(events(spark, [])).first().total_sessions == 0


def test_segments(spark):
    e = events(spark, [(1, 1, 1, "carts"), (1, 1, 2, "orders"), (2, 1, 1, "carts"), (3, 1, 1, "clicks")])
    assert {r.session_type: r["count"] for r in S.segments(e).collect()} == {"buyer": 1, "cart_abandoner": 1, "browse_only": 1}


def test_bot_rule(spark):
    few = events(spark, [(s, 1, 0, "clicks") for s in range(9)])
    assert S.bot_sessions(few).count() == 0 and "details" in S.bot_sessions(few).columns
    rows = [(s, 1, 0, "clicks") for s in range(10)] + [(99, 1, 0, "clicks")] * 100
    out = S.bot_sessions(events(spark, rows)).collect()
    assert [(r.session_id, r.event_count, r.batch_mean, r.batch_std) for r in out] == [(99, 100, 10.0, 29.85)]


def test_long_sessions(spark):
    e = events(spark, [(1, k, k, "clicks") for k in range(5)] + [(2, k, k, "orders" if k == 4 else "clicks") for k in range(5)] + [(3, k, k, "clicks") for k in range(6)])
    assert {r.session for r in S.long_sessions(e).collect()} == {2, 3}


def test_gap_buckets(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.001,), (10.0,), (1814400.0,), (1814401.0,)], "s double")
    from pyspark.sql import functions as F

    assert [r.b for r in df.select(N.gap_bucket(F.col("s")).alias("b")).collect()] == [0, 0, 1, 1, 14, 15]


def test_types(spark):
    df = spark.createDataFrame([("Clicks ",), ("1",), ("2",), ("foo",), (None,)], "type string")
    assert [r.c for r in df.select(N.type_code(strict=False).alias("c")).collect()] == [0, 1, 2, 0, 0]
    with pytest.raises(Exception, match="unknown event type"):
        df.select(N.type_code()).collect()
    assert {r.type for r in N.invalid_types(df).collect()} == {"foo", None}


def test_seconds(spark):
    ms = events(spark, [(1, 1, 1_700_000_000_123, "clicks")])
    assert N.to_seconds(ms).first().ts == 1_700_000_000 and N.to_seconds(N.to_seconds(ms)).first().ts == 1_700_000_000


def test_split_invariants(spark):
    day = 86_400_000
    e = events(spark, [(s, a, (s * 2 + a) * day // 2, "clicks") for s in range(12) for a in range(3)])
    train, test = P.temporal_split(e, 7)
    checks = {r.check: r.passed for r in P.split_checks(train, test).collect()}
    assert all(checks.values()) and train.count() and test.count()


def test_candidates_and_features(spark):
    e = events(spark, [(1, 1, 0, "clicks"), (1, 2, 1000, "carts"), (2, 1, 0, "clicks"), (2, 3, 5000, "orders")])
    graphs = {g: V.typed_edges(e, g) for g in R.GRAPHS}
    found = R.candidates(e, graphs, I.popular_candidates(e))
    assert found.groupBy("session", "candidate_aid").count().filter("count > 1").count() == 0
    rows = R.assemble(found, e, e)
    assert rows.count() == found.count() and rows.filter("rank_clicks is null or click_all is null").count() == 0
    labelled = R.labelled(rows, P.ground_truth(e), "clicks")
    assert R.training_rows(labelled).count() <= labelled.count()


def test_fallback_fills_up(spark):
    scored = spark.createDataFrame([(1, 5, 2.0)], "session long, candidate_aid long, score double")
    popular = spark.createDataFrame([(7, 1), (5, 2), (8, 3)], "aid long, rank int")
    out = R.with_fallback(scored, scored, popular, spark.createDataFrame([(1, 7)], "session long, aid long"), 3)
    assert [(r.aid, r.score) for r in out.orderBy("rank").collect()] == [(5, 2.0), (8, -99.0)]


def test_merge(spark):
    a, b = spark.createDataFrame([(1, 5, "x"), (2, 1, "y")], "k long, n long, s string"), spark.createDataFrame([(1, 2, "z"), (3, 9, "w")], "k long, n long, s string")
    assert sorted(map(tuple, K.merge(a, b, ["k"], ("n",)).collect())) == [(1, 7, "z"), (2, 1, "y"), (3, 9, "w")]


def test_merge_sink_is_idempotent(spark, tmp_path):
    sink = K.MergeSink(str(tmp_path / "t"), ["k"], ("n",))
    rows = lambda n: spark.createDataFrame([(1, n)], "k long, n long")
    for batch, n in ((0, 5), (1, 3), (1, 3)):
        sink.write(rows(n), batch)
    assert [tuple(r) for r in sink.read(spark).collect()] == [(1, 8)]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(s, s % 5, s * 1000, "clicks" if s % 2 else "orders", "m") for s in range(40)], EVENTS + ", model_used string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    sinks = {n: K.AppendSink(str(tmp_path / n)) for n in U.TABLES}
    U.start_compat(stream, sinks, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    for name in ("stats_items", "stats_sessions", "popular_items", "stats_hourly"):
        want = U.batch_tables(e)[name]
        got = sinks[name].read(spark).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name


def test_late_data_is_dropped(spark, tmp_path):
    hour = 3_600_000
    for k, ts in enumerate((10 * hour, 11 * hour, 9 * hour)):
        events(spark, [(1, 1, ts, "clicks")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        q = U.windowed_traffic(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    starts = [r.window_start.hour for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert 9 not in starts and 10 in starts


def test_sources_and_exports(spark, tmp_path):
    from sessionloom.sources import events as X

    nested = spark.createDataFrame([(1, [(5, 10, "clicks"), (6, 20, "carts")]), (2, [])], X.NESTED)
    nested.write.json(str(tmp_path / "j"))
    assert X.read_jsonl(spark, str(tmp_path / "j")).count() == 2 and X.read_jsonl(spark, str(tmp_path / "j"), "carts").count() == 1
    X.jsonl_to_parquet(spark, str(tmp_path / "j"), str(tmp_path / "p"))
    flat = X.read_sessions(spark, str(tmp_path / "p"))
    K.write_parquet(flat, str(tmp_path / "f"))
    assert X.read_sessions(spark, str(tmp_path / "f")).count() == 2
    K.write_interactions(flat, str(tmp_path / "t"))
    assert X.read_interactions(spark, str(tmp_path / "t")).count() == 2
    raw = spark.createDataFrame([('{"session_id": 1, "aid": 2, "type": "clicks", "ts": 3}',), ("no json",)], "value string")
    assert [r.aid for r in X.decode_messages(raw).collect()] == [2]
    assert [(r.session_id, r.ts) for r in X.replay(flat, 1, 100).orderBy("ts").collect()] == [(1, 100), (1, 101)]
    for write, name in ((K.write_atomic, "a"), (K.write_items, "i")):
        write(flat, str(tmp_path / name))
    K.save_artefacts({"flat": flat}, str(tmp_path / "art"))
    assert K.load_artefacts(spark, str(tmp_path / "art"), ("flat",))["flat"].count() == 2


def test_rank_metrics_in_bounds(spark):
    e = events(spark, [(s, a, s + a, "clicks") for s in range(5) for a in range(4)])
    assert V.typed_edges(e, "clicks").filter("rank >= 20 or rank < 0").count() == 0
    assert V.bipartite_edges(e).count() == 2 * 20


def test_interaction_matrices(spark):
    train = events(spark, [(10, 7, 0, "clicks"), (10, 7, 1, "clicks"), (10, 9, 2, "orders"), (20, 7, 0, "clicks"), (30, 8, 0, "orders"), (40, 5, 0, "orders"), (10, None, 3, "clicks"), (None, 7, 0, "clicks")])
    test = events(spark, [(40, 6, 9, "clicks"), (10, 7, 9, "clicks"), (10, 6, 10, "orders"), (10, 6, 11, "orders"), (20, 6, 9, "orders"), (40, 99, 9, "orders")])
    matrix, held_out = N2.interaction_matrices(train, test)
    # users 10, 40; items 5, 6, 7, 9
    assert sorted(map(tuple, matrix.collect())) == [("buy", 0, 3), ("buy", 1, 0), ("pv", 0, 2), ("pv", 1, 1)]
    assert sorted(map(tuple, held_out.collect())) == [(0, 1), (0, 1)]
    empty = N2.interaction_matrices(train.limit(0), test)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_samples(spark):
    e = spark.range(4000).selectExpr("id div 4 AS session", "id AS aid", "id AS ts", "'clicks' AS type")
    some = N2.session_sample(e, 0.25)
    sizes = {r["count"] for r in some.groupBy("session").count().collect()}
    assert sizes == {4} and 150 < some.count() / 4 < 350
    assert sorted(some.collect()) == sorted(N2.session_sample(e.repartition(5), 0.25).collect()) != sorted(N2.session_sample(e, 0.25, seed=1).collect())
    assert N2.sessions_by_draw(e, 30).select("session").distinct().count() == 30 and N2.sessions_by_draw(e, 9999).count() == 4000
    assert N2.session_sample(e, 1.0).count() == 4000 and N2.event_sample(e, 0.0).count() == 0 and 800 < N2.event_sample(e, 0.25).count() < 1200


def test_settings(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"a": "${HOST:local}:${PORT:1}", "b": ["${NONE}", 3, {"c": "plain"}]}')
    assert read_settings(str(path), {"PORT": "9"}) == {"a": "local:9", "b": ["", 3, {"c": "plain"}]}


def test_first_rows(spark, monkeypatch):
    from sessionloom.operators import ordered as O

    monkeypatch.setattr(O, "SORTED", 10)
    monkeypatch.setattr(O, "BINS", 8)
    rows = [(x * x % 17, x % 5 - 2, x, float(x % 3)) for x in range(300)] + [(5, 1, 1000, 0.0)] * 30
    df = spark.createDataFrame(rows, "a long, b long, c long, d double").cache()
    for order in ([("a", True), ("b", False), ("c", False)], [("d", False), ("c", True)], [("c", False)]):
        key = lambda r: tuple(-r[n] if down else r[n] for n, down in order)
        want = sorted(df.collect(), key=key)
        for n in (0, 1, 7, 150, 329, 330, 999):
            got = sorted(O.first_rows(df, order, n).collect(), key=key)
            assert [key(r) for r in got] == [key(r) for r in want[:n]], (order, n)
    assert O.first_rows(df.limit(0), [("a", True)], 5).count() == 0


def test_quantiles(spark, monkeypatch):
    import numpy as np

    from sessionloom.operators import ordered as O

    monkeypatch.setattr(O, "SORTED", 10)
    monkeypatch.setattr(O, "BINS", 8)
    values = [float(x) for x in np.random.default_rng(1).lognormal(size=500)] + [3.25] * 100 + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)
    assert O.quantiles(df, "v", shares) == pytest.approx([float(np.quantile([v for v in values if v is not None], q)) for q in shares])
    assert O.quantiles(df.filter("v is null"), "v", (0.5,)) == [None]


def test_running_sums_of_sparse_ids(spark):
    from sessionloom.operators import ordered as O

    ids = sorted({-(2**40), -3, 0, 1, 2, 65_536, 65_537, 2**33, 2**33 + 5, 2**52})
    df = spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id long, n long")
    assert {r.id: r.before for r in O.running(df, "id", "n").collect()} == {i: sum(range(1, k + 1)) for k, i in enumerate(ids)}
    two = df.withColumn("g", df["id"] % 2)
    got = {r.id: r.before for r in O.running(two, "id", "n", group=("g",)).collect()}
    n = {i: k + 1 for k, i in enumerate(ids)}
    sign = lambda i: int(i % 2) if i >= 0 else -int(-i % 2)
    assert got == {i: sum(n[j] for j in ids if j < i and sign(j) == sign(i)) for i in ids}
    assert [(r.aid, r.dense) for r in V.dense_ids(df.withColumnRenamed("id", "aid"), "aid").orderBy("aid").collect()] == [(i, k) for k, i in enumerate(ids)]


def test_merge_sink_keeps_two_versions(spark, tmp_path):
    path = tmp_path / "t"
    sink = K.MergeSink(str(path), ["k"], parts=2)
    for batch in range(5):
        sink.write(spark.createDataFrame([(k, batch) for k in range(batch + 1)], "k long, n long"), batch)
    assert {r.k: r.n for r in sink.read(spark).collect()} == dict.fromkeys(range(5), 4)
    for part in (0, 1):
        assert len(list(path.glob(f"version=*/part={part}"))) <= 2


def test_failing_sink_does_not_stop_the_others(spark, tmp_path):
    class Broken(K.Sink):
        def write(self, table, batch_id):
            raise ValueError("broken")

    e = spark.createDataFrame([(1, 1, 1, "clicks", "m")], EVENTS + ", model_used string")
    e.write.parquet(str(tmp_path / "in"))
    sinks = {"stats_items": Broken(), "stats_hourly": K.AppendSink(str(tmp_path / "h"))}
    query = U.start_compat(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), sinks, str(tmp_path / "cp"), {"availableNow": True})
    with pytest.raises(Exception, match="broken"):
        query.awaitTermination()
    assert sinks["stats_hourly"].read(spark).count() == 1


def test_buffered(spark, tmp_path):
    e = events(spark, [(s, 1, s, "clicks") for s in range(6)])
    e.write.parquet(str(tmp_path / "in"))
    sink = K.AppendSink(str(tmp_path / "out"))
    U.start_buffered(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), sink, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
    assert sink.read(spark).count() == 6


def test_progress_is_handed_on(spark, tmp_path):
    import time

    seen = []
    listener = U.ProgressListener(seen.append)
    spark.streams.addListener(listener)
    try:
        e = events(spark, [(1, 1, 1, "clicks")])
        e.write.parquet(str(tmp_path / "in"))
        U.start_buffered(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), K.AppendSink(str(tmp_path / "out")), str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
        for _ in range(50):
            if seen:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert seen and seen[0]["batch_id"] == 0 and seen[0]["batch_duration_ms"] >= 0


def test_grouped_ranker_ignores_what_a_session_shares(spark, tmp_path):
    rows = [(s, a, float(a + 100 * s), float(a % 2), int(a == 4)) for s in range(30) for a in range(5)]
    df = spark.createDataFrame(rows, "session long, candidate_aid long, x double, z double, label int")
    scorer, model = R.fit_ranker(df, ["x", "z"])
    best = R.recommend(scorer(df), 1).collect()
    assert len(best) == 30 and all(r.aid == 4 for r in best)
    K.save_artefacts({"rows": df}, str(tmp_path), {"ranker": model}, ["x", "z"])
    again = K.load_artefacts(spark, str(tmp_path), ("rows",), ("ranker",))
    assert again["features"] == ["x", "z"] and again["ranker"].transform(R.centred(df, ["x", "z"], "session")).count() == 150


def test_load_stream(spark, tmp_path):
    from sessionloom.sources import events as X

    stream = X.load_stream(spark, per_second=200, sessions=10, items=50)
    query = stream.writeStream.format("memory").queryName("load").trigger(processingTime="1 second").start()
    try:
        query.processAllAvailable()
        import time

        for _ in range(30):
            if spark.table("load").count() >= 100:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.table("load").collect()
    assert rows and all(0 <= r.session_id < 10 and 0 <= r.aid < 50 and r.type in ("clicks", "carts", "orders") for r in rows)


def test_shared_folder_is_stated(spark):
    from sessionloom.sources.folders import shared_folder

    assert shared_folder(spark, "x") != shared_folder(spark, "x") and shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_row_blocks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    # row 6 has a third of the cells, row 40 is alone in its block, rows 16 .. 31 are absent; some cells repeat
    cells = [(int(a), int(b), float(v)) for a, b, v in zip(r.integers(0, 16, 200), r.integers(0, 90, 200), r.integers(1, 9, 200), strict=True)]
    cells += [(6, k, 2.0) for k in range(100)] + [(40, 3, 5.0), (40, 3, 5.0)]
    df = spark.createDataFrame([*cells, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "row int, col long, value double").withColumn("block", F.lit("x")).withColumn("piece", F.lit(1))
    blocks = N2.row_blocks(df, rows=8, most=50)
    got, most = [], 0
    for b in blocks.collect():
        assert len(b.indptr) == 9 and b.indptr[0] == 0 and b.indptr[8] == len(b.indices) == len(b["values"])
        for k in range(8):
            part = slice(b.indptr[k], b.indptr[k + 1])
            assert b.indices[part] == sorted(b.indices[part])
            got += [(b.block * 8 + k, c, v) for c, v in zip(b.indices[part], b["values"][part], strict=True)]
        most = max(most, len(b.indices))
    assert sorted(got) == sorted(cells) and most < 100
    factor = {k: float(k % 5) for k in range(0, 45) if k != 3}
    want = {}
    for a, c, v in cells:
        want[c] = want.get(c, 0.0) + v * factor.get(a, 0.0)
    vector = spark.createDataFrame([*factor.items(), (3, None), (None, 2.0)], "row long, factor double")
    assert {x.col: x.value for x in N2.transposed_product(blocks, vector, rows=8).collect()} == want
    assert {x.value for x in N2.transposed_product(blocks, vector.limit(0), rows=8).collect()} == {0.0}
    assert N2.transposed_product(N2.row_blocks(df.limit(0)), vector).count() == 0
