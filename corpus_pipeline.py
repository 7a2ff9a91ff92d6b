"""A corpus from raw documents to packed training sequences: five stages, each one of the operators in ``sessionloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Between stages the
result is written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import alike, mixing, packing, pii, quality
from sessionloom.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: word 5-gram sets of similarity 0.8 or more. At 0.8 two sets share none of 18 keys of 4 least values with the chance
#: (1 - 0.8 ** 4) ** 18, which is 8 in 100000. About 39 of 256 SimHash bits differ then (the angle whose cosine is 2 * 0.8 / 1.8), in short texts
#: up to 48, give or take 6; up to 80 the sets themselves are compared.
NEAR = {"shingle": 5, "radius": 80, "bands": 18, "rows": 4, "least_similarity": 0.8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, does not reject."""
    return quality.accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least id, null last. Rows that repeat an id are judged each by its own text."""
    return alike.one_each(docs.select(*COLUMNS), **NEAR)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    redacted = pii.redact(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each with the words that the mix takes of it (repeats included); those of which it takes none go."""
    mixed = mixing.mix(docs.select(*COLUMNS), with_text=True).filter("taken > 0")
    return mixed.select("doc_id", F.col("taken_text").alias("text"), F.col("others.lang").alias("lang"), "source", F.length("taken_text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashing, learned models and permutations are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
