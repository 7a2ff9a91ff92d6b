"""The operator queries against SQL, and the pipeline's stages against plain versions, on the smallest tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from sessionloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in found.fetchall())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for name in ("quality", "near_dedup", "personal_data", "mixing"):
        assert set(stages[name].columns) == set(corpus_pipeline.COLUMNS)


def test_quality_keeps_the_good(stages, spark):
    before, after = rows(stages["documents"]), rows(stages["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.97 * len(good) and all(after[i] == before[i] for i in after)
    assert sum(i in after for i in before if labels.get(i) == 0) <= 0.2 * sum(labels.get(i) == 0 for i in before)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_one_of_each_group_stays(stages):
    before, after = rows(stages["quality"]), rows(stages["near_dedup"])
    sets = {i: shingles(r.text) for i, r in before.items()}
    alike = lambda a, b: len(a & b) / len(a | b)
    kept = sorted(after)
    assert not [(i, j) for i in kept for j in kept if j < i and alike(sets[i], sets[j]) >= 0.9]
    # what goes has a near copy that was there
    assert all(any(j < i and alike(sets[i], sets[j]) >= 0.5 for j in before) for i in before if i not in after)


def test_personal_data_goes(stages):
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before, after = rows(stages["near_dedup"]), rows(stages["personal_data"])
    assert set(before) == set(after) and not any(mail.search(r.text or "") for r in after.values())
    assert all(after[i].text == r.text for i, r in before.items() if not re.search(r"[0-9@]", r.text or ""))
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mix_keeps_to_sizes(stages):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = rows(stages["personal_data"]), rows(stages["mixing"])
    assert all(0 < count(r.text) <= 2 * count(before[i].text) for i, r in after.items())
    assert sum(count(r.text) for r in after.values()) == pytest.approx(1.5 * sum(count(r.text) for r in before.values()), rel=0.01)


def test_packing_holds_all(stages):
    packed = stages["packing"].collect()
    assert {r.doc_id for r in packed} == set(rows(stages["mixing"]))
    by = {}
    for r in packed:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 4096 and len(by) <= -(-sum(by.values()) // 4096) + 1


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages["packing"].count()
