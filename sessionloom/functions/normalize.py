"""Column functions that bring types, times and ids into one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import constants as C


def type_code(column: str = "type", strict: bool = True) -> Column:
    """0, 1, 2 for clicks, carts, orders. Strict: anything else raises; otherwise names are trimmed and lower-cased, digits accepted, and the unknown is 0."""
    name = F.col(column).cast("string") if strict else F.lower(F.trim(F.col(column).cast("string")))
    code = F.when(name == C.CLICK, 0).when(name == C.CART, 1).when(name == C.ORDER, 2)
    if strict:
        return code.otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(name, F.lit("null")))).cast("int"))
    return code.when(name.isin("0", "1", "2"), F.try_to_number(name, F.lit("9")).cast("int")).otherwise(0)


def type_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, C.EVENT_TYPES)), code + 1)


def invalid_types(events: DataFrame, column: str = "type") -> DataFrame:
    """The distinct values of the type column that no event type is called."""
    known = F.lower(F.trim(F.col(column).cast("string"))).isin(*C.EVENT_TYPES, "0", "1", "2")
    return events.filter(~F.coalesce(known, F.lit(False))).select(column).distinct()


def to_seconds(events: DataFrame, column: str = "ts") -> DataFrame:
    """Epoch seconds, whole: a table whose greatest time is above 1e12 is in milliseconds."""
    top = events.agg(F.max(column).alias("top"))
    unit = F.when(F.col("top") > 10**12, 1000).otherwise(1)
    return events.crossJoin(F.broadcast(top)).withColumn(column, F.floor(F.col(column) / unit).cast("long")).drop("top")


def known_keys(events: DataFrame) -> DataFrame:
    """Events that have an item and a type."""
    return events.filter("aid is not null and type is not null")


def shifted(column: str) -> Column:
    """Ids from 1, so that 0 can stand for padding."""
    return F.col(column) + 1


def unshifted(column: str) -> Column:
    return F.col(column) - 1


def event_time(column: str = "ts", offset_hours: int = 0) -> Column:
    """Timestamp of epoch milliseconds, moved by whole hours where a local clock is wanted."""
    return F.timestamp_millis(F.col(column) + F.lit(offset_hours * 3_600_000))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0 or null."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def gap_bucket(seconds: Column) -> Column:
    """Number of breakpoints below the gap: buckets are open to the left."""
    return sum(((seconds > b).cast("int") for b in C.GAP_BREAKS), F.lit(0))


def bounded_types(events: DataFrame) -> DataFrame:
    """Narrow columns for storage: item int, type byte."""
    return events.withColumn("aid", F.col("aid").cast("int")).withColumn("type", type_code().cast("byte"))
