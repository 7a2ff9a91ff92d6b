"""Readers that give flat events: session long, aid long, ts long (milliseconds), type string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = T.StructType([
    T.StructField("session", T.LongType()),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField("aid", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("type", T.StringType())]))),
])
FLAT = T.StructType([T.StructField("session", T.LongType()), T.StructField("aid", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("type", T.StringType())])
MESSAGE = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("aid", T.LongType()), T.StructField("type", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("model_used", T.StringType())])


def flatten(nested: DataFrame) -> DataFrame:
    """One row an event of nested sessions; sessions without events give none."""
    return nested.select("session", F.explode("events").alias("event")).select("session", "event.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of nested or of flat sessions, told apart by their columns."""
    rows = spark.read.parquet(path)
    return flatten(rows) if "events" in rows.columns else rows.select("session", "aid", "ts", "type")


def read_flat(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """The four columns of flat sessions; with ``parts`` dealt to so many partitions by session."""
    rows = spark.read.parquet(path).select("session", "aid", "ts", "type")
    return rows if parts is None else rows.repartition(parts, "session")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A text table of a stated schema."""
    return spark.read.option("sep", sep).option("header", header).schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """JSON lines of nested sessions, with a fixed schema; ``only`` keeps one event type."""
    rows = flatten(spark.read.schema(NESTED).json(path))
    return rows if only is None else rows.filter(F.col("type") == only)


def jsonl_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    spark.read.schema(NESTED).json(source).write.mode("overwrite").option("compression", "zstd").parquet(target)


def read_interactions(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Tab-separated user and item ids."""
    return spark.read.option("sep", "\t").option("header", header).schema("user int, item int").csv(path)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of a folder that match a glob, as one table."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_trigger: int = 10_000) -> DataFrame:
    """The raw stream of a topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_trigger).load()


def decode_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON payloads as columns; what cannot be decoded is dropped."""
    parsed = raw.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("data"))
    # a payload that is no JSON object decodes to nulls throughout
    return parsed.filter("data is not null").select("data.*").filter("coalesce(cast(session_id as string), cast(aid as string), type, cast(ts as string), model_used) is not null")


def load_stream(spark: SparkSession, per_second: int = 50, sessions: int = 2000, items: int = 1_850_000, seed: int = 1) -> DataFrame:
    """Random events for load tests: uniform sessions, items and types."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    pick = lambda salt, n: F.pmod(F.xxhash64("value", F.lit(seed), F.lit(salt)), F.lit(n))
    kind = F.element_at(F.array(F.lit("clicks"), F.lit("carts"), F.lit("orders")), (pick(3, 3) + 1).cast("int"))
    return rows.select(pick(1, sessions).alias("session_id"), pick(2, items).alias("aid"), kind.alias("type"), F.unix_millis("timestamp").alias("ts"), F.lit(None).cast("string").alias("model_used"))


def replay(sessions: DataFrame, first: int, now_ms: int) -> DataFrame:
    """The first so many sessions as messages, their timestamps replaced by the time of sending, in event order."""
    chosen = sessions.select("session").distinct().orderBy("session").limit(first)
    return sessions.join(F.broadcast(chosen) if first <= 100_000 else chosen, "session", "left_semi").select(
        F.col("session").alias("session_id"), "aid", "type", (F.lit(now_ms) + F.row_number().over(_by_time()) - 1).alias("ts"), F.lit(None).cast("string").alias("model_used")
    )


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("session").orderBy("ts", "aid", "type")


# ---- the driver's test tables as events


def micros(column: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: users are sessions, the JSON property k is the item; view and click are clicks, signup a cart, purchase an order; errors are left out."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type in ('view', 'click', 'signup', 'purchase')")
    kind = F.when(F.col("event_type").isin("view", "click"), "clicks").when(F.col("event_type") == "signup", "carts").otherwise("orders")
    return rows.select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("aid"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ts"), kind.alias("type"))


#: The same in DuckDB, as a common table expression named ev.
WEB_SQL = """ev AS (SELECT user_id AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS aid, epoch_us(ts) // 1000 AS ts,
    CASE WHEN event_type IN ('view', 'click') THEN 'clicks' WHEN event_type = 'signup' THEN 'carts' ELSE 'orders' END AS type
    FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))"""


#: Rows that a task of a join or sort takes at most.
TASK_ROWS = 1 << 19


def parts_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """The session's shuffle partitions, more of them where a part would have more than ``each`` rows: what a task sorts stays in its memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def purchase_rows(spark: SparkSession, sf_dir: str) -> int:
    """How many rows ``purchase_events`` has at most; the files' footers tell it."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with ``orders``: customers are sessions, parts items, the return flag N a click, A a cart, R an order. Also line, to break ties."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("l_returnflag") == "N", "clicks").when(F.col("l_returnflag") == "A", "carts").otherwise("orders")
    n = parts_for(spark, purchase_rows(spark, sf_dir))
    if n > parts_for(spark, 0):
        lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("session"), F.col("l_partkey").alias("aid"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) div 1000").alias("ts"), kind.alias("type"))


PURCHASE_SQL = """ev AS (SELECT o_custkey AS session, l_partkey AS aid, epoch_us(l_shipdate) // 1000 AS ts,
    CASE l_returnflag WHEN 'N' THEN 'clicks' WHEN 'A' THEN 'carts' ELSE 'orders' END AS type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
