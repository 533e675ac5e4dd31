"""Leases: which cursors are free, which are held, and how they change hands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plus_seconds
from ..state import State
from .liveness import working_cursors
from .relops import updated, without


def unleased_cursors(state: State, as_of: Column | None = None) -> DataFrame:
    """Cursors with work that are free: without a lease, or, as built, with one whose holder was detected before its deadline.

    With as_of, as documented: without a lease, or with one whose holder's deadline has passed.
    """
    held = state["leases"].select(F.col("cursor_id").alias("id"), "consumer_id")
    holders = state["consumers"].select(F.col("id").alias("consumer_id"), "heartbeat_detected_at", "heartbeat_deadline")
    rows = working_cursors(state).join(held, "id", "left").join(holders, "consumer_id", "left")
    lapsed = F.col("heartbeat_detected_at") < F.col("heartbeat_deadline") if as_of is None else as_of >= F.col("heartbeat_deadline")
    return rows.filter(F.col("consumer_id").isNull() | lapsed).select(*state["cursors"].columns)


def leased_cursors(state: State) -> DataFrame:
    """Cursors under active leases of consumers detected before their deadline, with consumer_id, lease_id and acquired_at."""
    holders = state["consumers"].filter("heartbeat_detected_at < heartbeat_deadline").select(F.col("id").alias("consumer_id"))
    held = state["leases"].filter("state = 'ACTIVE'").select("consumer_id", F.col("cursor_id").alias("id"), F.col("cursor_id").alias("lease_id"), "acquired_at")
    rows = state["cursors"].join(held, "id").join(holders, "consumer_id")
    return rows.select(*state["cursors"].columns, "consumer_id", "lease_id", "acquired_at")


def acquirable(state: State, wanted: DataFrame, pivot: int) -> DataFrame:
    """wanted(consumer_id, subscription_id, n) -> free cursors (consumer_id, cursor columns, turn) of the topics chosen.

    Each consumer takes them from the pivot of random keys on, round to the start, n at most, on this state by itself. As the
    order is the same for all, of a topic only as many cursors as its keenest consumer wants meet its consumers.
    """
    chosen = state["consumer_subscriptions"].join(wanted, "consumer_id").select("consumer_id", "subscription_id", "topic_id", "n").distinct()
    order = (F.col("random_key") < pivot, F.col("random_key"), F.col("id"))
    keenest = chosen.groupBy("subscription_id", "topic_id").agg(F.max("n").alias("most"))
    free = unleased_cursors(state).join(keenest, ["subscription_id", "topic_id"])
    free = free.withColumn("_place", F.row_number().over(Window.partitionBy("subscription_id", "topic_id").orderBy(*order))).filter("_place <= most").drop("_place", "most")
    rows = free.join(chosen, ["subscription_id", "topic_id"])
    turn = F.row_number().over(Window.partitionBy("consumer_id", "subscription_id").orderBy(*order))
    return rows.withColumn("turn", turn.cast("long")).filter("turn <= n").select("consumer_id", *state["cursors"].columns, "turn")


def taken_over(state: State, rows: DataFrame, as_of: Column) -> State:
    """rows(id, subscription_id, topic_id, partition_id, consumer_id): active leases, new ones or with one version more.

    A lease that is taken over keeps the time it was first acquired and its release deadline.
    """
    old = state["leases"].select(F.col("cursor_id").alias("id"), F.col("version").alias("_version"), F.col("acquired_at").alias("_acquired"), "release_deadline")
    new = rows.join(old, "id", "left").select(
        F.col("id").alias("cursor_id"), "subscription_id", "topic_id", "partition_id", "consumer_id", (F.coalesce("_version", F.lit(0)) + 1).alias("version"),
        F.coalesce("_acquired", as_of).alias("acquired_at"), F.lit(None).cast("timestamp_ntz").alias("released_at"), "release_deadline", F.lit("ACTIVE").alias("state"),
    )
    return state.having(leases=without(state["leases"], new, ["cursor_id"]).unionByName(new))


def acquire(state: State, consumer: str, subscription_id: int, n: int, pivot: int, as_of: Column) -> State:
    wanted = state.spark.range(1).select(F.lit(consumer).alias("consumer_id"), F.lit(subscription_id).cast("long").alias("subscription_id"), F.lit(n).alias("n"))
    return taken_over(state, acquirable(state, wanted, pivot), as_of)


def excess(state: State, wanted: DataFrame) -> DataFrame:
    """wanted(consumer_id, subscription_id, n) -> (cursor_id, consumer_id): active leases to let go, n at most for each.

    Of the half with the least work left, the most recently acquired ones.
    """
    positions = state["cursors"].select(F.col("id").alias("cursor_id"), "position")
    marks = state["partitions"].select(F.col("id").alias("partition_id"), "high_watermark")
    rows = state["leases"].filter("state = 'ACTIVE'").join(wanted, ["consumer_id", "subscription_id"])
    rows = rows.join(positions, "cursor_id").join(marks, "partition_id")
    holder = Window.partitionBy("consumer_id", "subscription_id")
    rows = rows.withColumn("_place", F.row_number().over(holder.orderBy(F.col("high_watermark") - F.col("position"), "cursor_id")))
    rows = rows.withColumn("_all", F.count("*").over(holder)).filter(F.col("_place") <= F.ceil(F.col("_all") * F.lit(0.5)))
    rows = rows.withColumn("_turn", F.row_number().over(holder.orderBy(F.desc("acquired_at"), "cursor_id")))
    return rows.filter(F.col("_turn") <= F.col("n")).select("cursor_id", "consumer_id")


def releasing(state: State, cursors: DataFrame, as_of: Column) -> State:
    """cursors(cursor_id): their leases go into release, with a deadline by the policy."""
    policy = F.broadcast(state["lease_policies"].select("lease_release_period"))
    rows = cursors.select("cursor_id").distinct().crossJoin(policy)
    new = rows.select("cursor_id", F.lit("RELEASING").alias("state"), as_of.alias("released_at"), plus_seconds(as_of, F.col("lease_release_period")).alias("release_deadline"))
    return state.having(leases=updated(state["leases"], new, ["cursor_id"], ["state", "released_at", "release_deadline"]))


def release_excess(state: State, consumer: str, subscription_id: int, n: int, as_of: Column) -> State:
    wanted = state.spark.range(1).select(F.lit(consumer).alias("consumer_id"), F.lit(subscription_id).cast("long").alias("subscription_id"), F.lit(n).alias("n"))
    return releasing(state, excess(state, wanted), as_of)


def release(state: State, cursor_id: int, consumer: str, as_of: Column) -> State:
    """Only the holder can release, and only an active lease."""
    own = state["leases"].filter((F.col("cursor_id") == cursor_id) & (F.col("consumer_id") == consumer) & (F.col("state") == "ACTIVE"))
    return releasing(state, own, as_of)
