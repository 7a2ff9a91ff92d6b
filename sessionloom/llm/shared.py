"""What the operators share: the cluster's shared folder, written intermediate tables, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is set once per session, if all runs on this machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a cut in the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input size, at most 2**60 (it is unbounded where nothing is known)."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 60)


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each holds about ``bytes_each`` of input, and no fewer than the session shuffles to."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, -(-size // bytes_each)) if size < 1 << 55 else least
