"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import line_runs, matroska, mih, mixing, packing, part_codes, pii, quality, ranked, simhash, substring_dedup, urlfilter, warc

#: Tokens a packed sequence, and the vocabulary.
CAPACITY, VOCABULARY = 4096, "word_bpe_49k.json"
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13, with_text=False)


def op2_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.demux(matroska.mux(_table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard", "last_shard")


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return mih.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=64, radius=4)
    return found.select("doc_id", simhash.hex64("f0").alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM ({rows}) AS t(host, path, verdict)")
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), CAPACITY, end_id=1)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compressed(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_lines(_table(spark, sf_dir, "documents"), least_length=40, least_documents=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_matroska_media, op3_source_mixing, op4_multi_index_hashing, op5_simhash_near_dedup, op6_url_filter, op7_warc_index, op8_quality_classifier, op9_best_fit_packing, op10_personal_data, op11_vector_codes, op12_ranked_search, op13_line_dedup)
    return {f.__name__: f for f in found}


def _vector_codes_sql() -> str:
    """One CTE a round: assign by least squared distance, then average."""
    nearest = """SELECT row, part, e, d FROM (
        SELECT v.row, v.part, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d, row_number() OVER (PARTITION BY v.row, v.part ORDER BY sum((v.x - b.x) * (v.x - b.x)), b.e) AS r
        FROM c AS v JOIN b{k} AS b USING (part, p) GROUP BY v.row, v.part, b.e) WHERE r = 1"""
    rounds = "".join(
        f"""a{k} AS MATERIALIZED ({nearest.format(k=k)}),
        m{k} AS (SELECT part, e, p, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{k} JOIN c USING (row, part) GROUP BY part, e, p),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, b.p, coalesce(m.x, b.x) AS x FROM b{k} AS b LEFT JOIN m{k} AS m USING (part, e, p)),
        """
        for k in range(part_codes.ROUNDS)
    )
    last = part_codes.ROUNDS
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS MATERIALIZED (SELECT row, i // (len(v) // {part_codes.PARTS}) AS part, i % (len(v) // {part_codes.PARTS}) AS p,
            CAST(floor({part_codes.SCALE} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM kept, unnest(range(0, len(v))) AS u(i)),
        b0 AS MATERIALIZED (SELECT part, row AS e, p, x FROM c WHERE row < {part_codes.ENTRIES}),
        {rounds}
        a{last} AS MATERIALIZED ({nearest.format(k=last)}),
        coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY row)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, p)) FROM b{last}) AS codebooks_sha256
        FROM kept JOIN coded USING (row)"""


def oracle_sql() -> dict[str, str]:
    word = r"[^\x20\x09-\x0D]+"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper_lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    blanks = " || ".join(f"chr({c})" for c in (0x20, *range(0x09, 0x0E)))
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op1_substring_dedup": f"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS u(i)),
            firsts AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
            hit AS (SELECT doc_id, i FROM win JOIN firsts USING (g) WHERE least < doc_id),
            covered AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(range(0, 13)) AS r(k)),
            each AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
            kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
            FROM w LEFT JOIN kept USING (doc_id)""",
        "op6_url_filter": f"""
            WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
            cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            fit AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
                FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
            SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
            FROM parts AS p LEFT JOIN (SELECT * FROM fit WHERE n = 1) AS f USING (page_id)""",
        "op7_warc_index": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM d)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
                CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
            FROM f""",
        "op11_vector_codes": _vector_codes_sql(),
        "op12_ranked_search": rf"""
            WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper_lower}), '{term}') AS ts FROM documents),
            n AS (SELECT row, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
            s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
            q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {upper_lower}), '{term}')) AS t FROM benchmark),
            tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS t FROM n) SEMI JOIN q USING (t) GROUP BY row, doc_id, n, t),
            w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
            scores AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
                FROM q JOIN tf USING (t) JOIN w USING (t), s GROUP BY item_id, row, doc_id)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
        "op13_line_dedup": f"""
            WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (SELECT doc_id, p, ls[p] AS line, translate(trim(ls[p], {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                FROM t, unnest(range(1, len(ls) + 1)) AS u(p)),
            often AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
            kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM l LEFT JOIN often USING (k)
                WHERE keeper IS NULL OR doc_id = keeper GROUP BY doc_id)
            SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
            FROM t LEFT JOIN kept USING (doc_id)""",
    }
