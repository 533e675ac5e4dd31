"""Column expressions of the event log, with the arithmetic of the relational database that its rules were written for."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Separates the names of a path.
DELIMITER = "/"
#: Partition numbers of a topic lie below this.
PARTITIONS_LIMIT = 1 << 16


def any_null(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, (c.isNull() for c in columns))


def greatest(*columns: Column) -> Column:
    """Null if any is null, where Spark's own skips nulls."""
    return F.when(~any_null(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    return F.when(~any_null(columns), F.least(*columns))


def to_integer(c: Column) -> Column:
    """A double handed over as an integer: rounded half to even."""
    return F.bround(c, 0).cast("long")


def quotient(a: Column, b: Column) -> Column:
    """a / b in double precision; null if b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return (ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def path_hash(path: Column) -> Column:
    return F.unhex(F.md5(path.cast("binary")))


def partition_id(topic_id: Column, number: Column) -> Column:
    """The topic's id and the number in one; a number out of range is an error, a null gives null."""
    packed = F.call_function("shiftleft", topic_id.cast("long"), F.lit(16)) + number.cast("long")
    bad = (number < 0) | (number >= PARTITIONS_LIMIT)
    return F.when(bad, F.raise_error(F.lit("partition number out of range")).cast("long")).otherwise(packed)


def routed_number(key: Column, partitions: Column) -> Column:
    """The partition number of a key."""
    return (F.crc32(key.cast("binary")) % partitions).cast("int")


def random_key(seed: Column) -> Column:
    """An integer of 32 bits that only depends on the seed."""
    return (F.crc32(seed.cast("string").cast("binary")) - F.lit(1 << 31)).cast("int")


def name_of(path: Column) -> Column:
    return F.substring_index(path, DELIMITER, -1)


def parent_of(path: Column) -> Column:
    """The path without its last name; null at the root. A path that begins with the delimiter has the parent ''."""
    return F.when(F.instr(path, DELIMITER) > 0, F.left(path, F.char_length(path) - F.char_length(name_of(path)) - 1))


def numbered(df: DataFrame, order: list[str], first: int, column: str) -> DataFrame:
    """df with consecutive numbers from first in the given order. For a bounded batch: the numbering runs in one task."""
    return df.withColumn(column, F.row_number().over(Window.orderBy(*order)).cast("long") + F.lit(first - 1))


def numbered_in_bulk(df: DataFrame, order: str, first: int, column: str) -> DataFrame:
    """The same for any number of rows, in two passes: rows are dealt by ranges of the order and sorted, each partition counts
    its rows, and running sums of the counts (one for each partition) turn places within partitions into numbers."""
    from ..state import written

    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbering")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(column, F.col("_before") + F.col("_at") + F.lit(first)).drop("_part", "_at", "_before")
