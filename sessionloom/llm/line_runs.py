"""Line dedup: levelled sorted runs of line hashes, in DataFrame operations only.

The index of lines is a set of sorted runs: tables bucketed and sorted by the 128-bit hash of a line's key, one row a hash with the number of
documents that hold it and the largest doc_id among them. Documents come in batches. A batch counts its own keys, is merge-anti-joined with the
runs (a key that a run has settled, with a keeper no smaller, teaches nothing new), and what is left becomes a run of the lowest level; each time a
level has ``fan_in`` runs they are merged into one of the next level. Runs and batches have the same buckets, so the joins move no run, and a merge moves the runs it merges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.shared import input_bytes, shared_dir, written

#: Stripped at both ends of a line.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Input of a batch, and batches at least.
BATCH_BYTES, LEAST_BATCHES = 1 << 40, 5
KEY = ["low", "high"]


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _row_key() -> Column:
    """With doc_id, tells rows of different texts apart."""
    return F.xxhash64("doc_id", _text())


def line_entries(docs: DataFrame, least_length: int) -> DataFrame:
    """(doc_id, row_key, place, low, high) for each line whose key has ``least_length`` code points or more; low and high hash the key."""
    lines = docs.select("doc_id", _row_key().alias("row_key"), F.posexplode(F.split(_text(), "\n", -1)).alias("place", "line"))
    stripped = F.trim(F.col("line"), F.lit(BLANKS))
    long = lines.filter(F.length(stripped) >= least_length)
    keyed = long.withColumn("line", F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return keyed.select("doc_id", "row_key", "place", F.xxhash64("line").alias("low"), F.xxhash64(F.lit(1), "line").alias("high"))


class LineRuns:
    """Sorted runs by level. ``settled_at``: documents from which a key's lines go, but for the keeper's."""

    def __init__(self, spark: SparkSession, settled_at: int, fan_in: int = 4):
        self.spark, self.settled_at, self.fan_in = spark, settled_at, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        sink = rows.write.format("parquet").option("compression", "zstd").option("path", self._path(name))
        sink.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # one scan of their files: a union of bucketed tables passes for co-partitioned, and Spark 4.1.2 then gave several rows a key
        runs = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(self._path(name) for name in names))
        return runs.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.max("keeper").alias("keeper"))

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def counted(self) -> DataFrame:
        """(low, high, documents, keeper) of all keys added; a run at least must be there."""
        return self._merged(self.names())

    def fresh(self, entries: DataFrame) -> DataFrame:
        """What a batch of entries adds: its keys, counted, less those that a run has settled with a keeper no smaller.

        Each document must be in one batch; entries without doc_id count for none.
        """
        held = entries.filter("doc_id is not null").select(*KEY, "doc_id").distinct()
        batch = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
        for name in self.names():
            known = self.spark.table(name).filter(F.col("documents") >= self.settled_at)
            known = known.select(F.col("low").alias("known_low"), F.col("high").alias("known_high"), F.col("keeper").alias("known_keeper"))
            same = (F.col("low") == F.col("known_low")) & (F.col("high") == F.col("known_high")) & (F.col("keeper") <= F.col("known_keeper"))
            batch = batch.join(known.hint("merge"), same, "left_anti")
        return batch

    def add(self, entries: DataFrame) -> None:
        self.levels[0].append(self._write(self.fresh(entries)))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fan_in:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(runs)))
            self._drop(runs)
            self.levels[level] = []

    def forget(self) -> None:
        """Take the runs out of the catalogue."""
        self._drop(self.names())
        self.levels = [[]]


def drop_lines(docs: DataFrame, least_length: int = 40, least_documents: int = 5, batches: int | None = None, fan_in: int = 4) -> DataFrame:
    """Per row doc_id, n_lines, n_dropped and kept_text: the text less lines that many documents hold.

    Takes doc_id and text; other columns are ignored. A text is split at ``\\n`` (null or empty: one empty line). A line's key is the line without
    blanks at both ends, A-Z lower-cased. A key of ``least_length`` code points or more that ``least_documents`` doc_ids or more hold loses all
    its lines but those of the largest doc_id that holds it. Rows that repeat a doc_id are one document, each with its own result. Rows
    without doc_id count for no document, are no keepers, and lose what others lose. No rows give no rows.

    Keys are told apart by 128 bits of hash. The texts are read twice and moved once, to meet the places of their dropped lines.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    batches = batches or max(LEAST_BATCHES, -(-input_bytes(docs) // BATCH_BYTES) if input_bytes(docs) < 1 << 55 else 1)
    entries = written(line_entries(docs, least_length), "lines")
    index = LineRuns(spark, least_documents, fan_in)
    for k in range(batches):
        index.add(entries.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    # written plain: a key that a third of all documents hold can then be split in the join
    gone = index.counted().filter(F.col("documents") >= least_documents)
    gone = written(gone.select(F.col("low").alias("gone_low"), F.col("high").alias("gone_high"), "keeper"), "gone")
    index.forget()
    lost = F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper"))
    hits = entries.join(gone.hint("shuffle_merge"), (F.col("low") == F.col("gone_low")) & (F.col("high") == F.col("gone_high"))).filter(lost)
    places = hits.groupBy(F.col("doc_id").alias("of_doc"), F.col("row_key").alias("of_row")).agg(F.collect_set("place").alias("places"))
    places = written(places, "places")
    rows = docs.withColumn("row_key", _row_key())
    met = rows.join(places.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row_key") == F.col("of_row")), "left")
    # a column of its own: lambdas would split the text for each place
    met = met.select("doc_id", _text().alias("text"), "places", F.split(_text(), "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))
    dropped = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept_text"))
