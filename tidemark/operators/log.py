"""The event log: routing, publishing, sequencing with high-watermarks, fetching and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotFoundError
from ..functions import greatest, numbered, numbered_in_bulk, partition_id, routed_number
from ..state import State, written
from .catalog import resolved_topics
from .relops import updated

#: The JSON form of a batch of events. A payload that is no string stays JSON text.
BATCH = "array<struct<path:string,topic:string,key:string,data:string>>"


def routed(events: DataFrame, topics: DataFrame) -> DataFrame:
    """events(path, topic, key, ...) with topic_id, partition_number and partition_id; events of unknown topics get nulls."""
    known = topics.select("path", "topic", "topic_id", "partitions")
    number = routed_number(F.col("key"), F.col("partitions"))
    out = events.join(known, ["path", "topic"], "left").withColumn("partition_number", number)
    return out.withColumn("partition_id", partition_id(F.col("topic_id"), F.col("partition_number"))).drop("partitions")


def batch_events(batches: DataFrame, column: str = "batch") -> DataFrame:
    """JSON arrays of events -> one row for each, with pos, its place in the array. Other columns are kept."""
    kept = [c for c in batches.columns if c != column]
    rows = batches.select(*kept, F.posexplode(F.from_json(column, BATCH)).alias("pos", "event"))
    return rows.select(*kept, "pos", "event.*")


def publish(state: State, events: DataFrame, order: list[str]) -> State:
    """Append events(path, topic, key, data) in the given order; nothing is written if one can't be routed."""
    rows = routed(events, resolved_topics(state))
    if not rows.filter(F.col("partition_id").isNull()).isEmpty():
        raise NotFoundError("an event has an unknown topic or no key")
    return publish_to(state, rows, order)


def publish_to(state: State, events: DataFrame, order: list[str]) -> State:
    """Append events(partition_id, data). The partition isn't looked up. Payloads are written once to be numbered and once, with the
    state, to stay."""
    first = state.next_id("events")
    column = order[0] if len(order) == 1 else "_order"
    keyed = events if len(order) == 1 else events.withColumn("_order", F.struct(*order))
    rows = numbered_in_bulk(keyed.select(column, "partition_id", F.col("data").cast("binary").alias("data")), column, first, "id")
    return state.appending(events=rows.select("id", "data"), unprocessed_events=rows.select("id", "partition_id")).counting(events=first + rows.count())


def claimed(queue: DataFrame, batch_size: int | None) -> DataFrame:
    """The oldest events of the queue; all of them without a batch size."""
    return queue if batch_size is None else queue.orderBy("id").limit(batch_size)


def sequenced(claim: DataFrame, first: int, bounded: bool) -> DataFrame:
    """(sequence, partition_id, event_id) in order of the events' ids."""
    rows = numbered(claim, ["id"], first, "sequence") if bounded else numbered_in_bulk(claim, "id", first, "sequence")
    return rows.select("sequence", "partition_id", F.col("id").alias("event_id"))


def lifted(partitions: DataFrame, sequences: DataFrame) -> DataFrame:
    """partitions with high-watermarks raised to their largest new sequence; they never fall."""
    top = sequences.groupBy(F.col("partition_id").alias("id")).agg(F.max("sequence").alias("top"))
    new = partitions.join(top, "id").select("id", greatest(F.col("high_watermark"), F.col("top")).alias("high_watermark"))
    return updated(partitions, new, ["id"], ["high_watermark"])


def sequence(state: State, batch_size: int | None = None) -> tuple[State, int]:
    """Give the oldest unsequenced events their place in the log. Returns the new state and how many they were."""
    first = state.next_id("sequences")
    rows = written(sequenced(claimed(state["unprocessed_events"], batch_size), first, batch_size is not None), "sequenced")
    found = rows.agg(F.count("*").alias("n"), F.max("event_id").alias("last")).first()
    if found.n:  # the oldest events were taken, so the queue goes on after the last of them
        state = state.past("unprocessed_events", found.last).appending(sequences=rows).having(partitions=lifted(state["partitions"], rows))
    return state.counting(sequences=first + found.n), found.n


def first_rows(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each key, the rows of the smallest sequences."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("sequence"))).filter(F.col("_rank") <= most).drop("_rank")


def delivered(sequences: DataFrame, cursors: DataFrame, events: DataFrame) -> DataFrame:
    """(cursor_id, sequence, event_id, data) of what comes after each cursor's position. An event that any cursor wants meets its
    payload once, before it is handed to all of them, so that what is sorted doesn't grow with the cursors of a partition."""
    at = cursors.select(F.col("id").alias("cursor_id"), "partition_id", "position")
    rows = sequences.join(at.groupBy("partition_id").agg(F.min("position").alias("floor")), "partition_id").filter("sequence > floor").drop("floor")
    rows = rows.join(events.select(F.col("id").alias("event_id"), "data"), "event_id")
    return rows.join(at, "partition_id").filter("sequence > position").select("cursor_id", "sequence", "event_id", "data")


def fetch(state: State, cursors: DataFrame, most: int | None = None) -> DataFrame:
    """(cursor_id, sequence, event_id, data) of the events after each cursor's position, at most so many for each."""
    if most is None:
        return delivered(state["sequences"], cursors, state["events"])
    at = cursors.select(F.col("id").alias("cursor_id"), "partition_id", "position")
    # A cursor's first events are among the first after each position of its partition, up to the next; these are few, and an
    # event lies in one such span, so no sort meets it once for each cursor.
    following = F.lead("position").over(Window.partitionBy("partition_id").orderBy("position"))
    spans = at.select("partition_id", "position").distinct().withColumn("next", following)
    near = state["sequences"].join(spans, "partition_id").filter("sequence > position and (next is null or sequence <= next)")
    near = first_rows(near, ["partition_id", "position"], most).select("sequence", "partition_id", "event_id")
    rows = near.join(at, "partition_id").filter("sequence > position").select("cursor_id", "sequence", "event_id")
    rows = first_rows(rows, ["cursor_id"], most)
    return rows.join(state["events"].select(F.col("id").alias("event_id"), "data"), "event_id").select("cursor_id", "sequence", "event_id", "data")


def lag(state: State) -> DataFrame:
    """(cursor_id, consumer_id, lag) of each lease: how many sequence numbers its cursor is behind."""
    positions = state["cursors"].select(F.col("id").alias("cursor_id"), "position")
    marks = state["partitions"].select(F.col("id").alias("partition_id"), "high_watermark")
    rows = state["leases"].join(positions, "cursor_id").join(marks, "partition_id")
    return rows.select("cursor_id", "consumer_id", (F.col("high_watermark") - F.col("position")).alias("lag"))
