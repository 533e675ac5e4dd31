"""Metrics of subscriptions and consumers, heartbeats with admission, and the removal of what has expired.

Everything is computed for all subscriptions or consumers at once; the forms for one are filters on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LogError
from ..functions import greatest, least, plus_seconds, quotient
from ..state import State
from .relops import cascaded, insert, updated

METRICS = ["active_consumers", "active_consumers_weight", "active_partitions", "heartbeat_interval"]


def working_cursors(state: State) -> DataFrame:
    """Cursors with events before their partition's high-watermark."""
    marks = state["partitions"].select(F.col("id").alias("partition_id"), "high_watermark")
    return state["cursors"].join(marks, "partition_id").filter("position < high_watermark").select(*state["cursors"].columns)


def subscription_metrics(state: State, as_of: Column) -> DataFrame:
    """subscription_topics(id) with METRICS: live consumers, their weight, partitions with work, and the interval between heartbeats."""
    live = state["consumers"].filter(as_of < F.col("heartbeat_deadline")).select(F.col("id").alias("consumer_id"), "weight")
    people = state["consumer_subscriptions"].join(live, "consumer_id").groupBy(F.col("subscription_topic_id").alias("id"))
    people = people.agg(F.count("consumer_id").cast("int").alias("active_consumers"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("active_consumers_weight"))
    work = working_cursors(state).groupBy(F.col("subscription_topic_id").alias("id")).agg(F.count("*").cast("int").alias("active_partitions"))
    rows = state["subscription_topics"].select("id", "subscription_id").join(people, "id", "left").join(work, "id", "left").crossJoin(F.broadcast(state["heartbeat_policies"].drop("id")))
    n = F.coalesce("active_consumers", F.lit(0))
    interval = least(greatest(F.col("interval_baseline"), quotient(n, F.col("target_qps"))), F.col("interval_limit"))
    return rows.select(
        "id", "subscription_id", n.alias("active_consumers"), F.coalesce("active_consumers_weight", F.lit(0.0)).alias("active_consumers_weight"),
        F.coalesce("active_partitions", F.lit(0)).alias("active_partitions"), interval.alias("heartbeat_interval"),
    )


def refresh_subscription_metrics(state: State, as_of: Column, subscription_id: int | None = None) -> State:
    if state["heartbeat_policies"].filter("target_qps <> 0").isEmpty():
        raise LogError("there is no heartbeat policy with a target rate")
    rows = subscription_metrics(state, as_of)
    if subscription_id is not None:
        rows = rows.filter(F.col("subscription_id") == subscription_id)
    return state.having(subscription_topics=updated(state["subscription_topics"], rows, ["id"], METRICS, as_of))


def consumer_intervals(state: State, as_of: Column) -> DataFrame:
    """consumers(id) with the interval, detection and deadline that a check-in at as_of gives them."""
    links = state["subscription_topics"].select("topic_id", "subscription_id", "heartbeat_interval")
    theirs = state["consumers"].select("id", "subscription_id").join(state["consumer_subscriptions"].select(F.col("consumer_id").alias("id"), "topic_id"), "id")
    widest = theirs.join(links, ["topic_id", "subscription_id"]).groupBy("id").agg(F.max("heartbeat_interval").alias("widest"))
    policy = F.broadcast(state["heartbeat_policies"].select("deadline_multiplier", "interval_baseline"))
    rows = state["consumers"].select("id").join(widest, "id", "left").crossJoin(policy)
    interval = F.coalesce("widest", "interval_baseline")
    timeout = greatest(F.lit(1).cast("long"), F.ceil(interval * F.col("deadline_multiplier")))
    return rows.select("id", interval.alias("heartbeat_interval"), as_of.alias("heartbeat_detected_at"), plus_seconds(as_of, timeout).alias("heartbeat_deadline"))


def refresh_consumer_metrics(state: State, as_of: Column, consumer: str | None = None) -> State:
    rows = consumer_intervals(state, as_of)
    if consumer is not None:
        rows = rows.filter(F.col("id") == consumer)
    return state.having(consumers=updated(state["consumers"], rows, ["id"], ["heartbeat_interval", "heartbeat_detected_at", "heartbeat_deadline"]))


def admissions(state: State, arrivals: DataFrame, as_of: Column) -> DataFrame:
    """arrivals(id, subscription_id, weight) -> the same with known and status. Each is judged on this state by itself.

    A known consumer is accepted; a new one if its subscription's busiest topic has fewer consumers than the limit.
    """
    known = state["consumers"].select("id", F.lit(True).alias("known"))
    busy = state["subscription_topics"].groupBy("subscription_id").agg(F.max("active_consumers").alias("busiest"))
    rows = arrivals.join(known, "id", "left").join(busy, "subscription_id", "left").crossJoin(F.broadcast(state["lease_policies"].select("active_consumers_limit")))
    is_known = F.coalesce("known", F.lit(False))
    accepted = is_known | (F.coalesce("busiest", F.lit(0)) < F.col("active_consumers_limit"))
    return rows.select("id", "subscription_id", "weight", is_known.alias("known"), F.when(accepted, "ACCEPTED").otherwise("REJECTED").alias("status"))


def heartbeat(state: State, consumer: str, subscription_id: int, weight: float, as_of: Column) -> tuple[State, str]:
    """A known consumer's weight and time of detection are renewed, not its deadline; a new one gets a second to check in."""
    arrival = state.spark.range(1).select(F.lit(consumer).alias("id"), F.lit(subscription_id).cast("long").alias("subscription_id"), F.lit(float(weight)).alias("weight"))
    row = admissions(state, arrival, as_of).first()
    if row.known:
        new = arrival.select("id", "weight", as_of.alias("heartbeat_detected_at"))
        return state.having(consumers=updated(state["consumers"], new, ["id"], ["weight", "heartbeat_detected_at"])), row.status
    if row.status == "ACCEPTED":
        policy = state["heartbeat_policies"].select(F.col("interval_baseline").alias("heartbeat_interval"))
        new = arrival.crossJoin(F.broadcast(policy)).withColumn("heartbeat_detected_at", as_of).withColumn("heartbeat_deadline", plus_seconds(as_of, F.lit(1)))
        state = insert(state, "consumers", new)
    return state, row.status


def expired_leases(state: State, as_of: Column) -> DataFrame:
    """Leases of consumers past their deadline, and those past their release deadline."""
    deadlines = state["consumers"].select(F.col("id").alias("consumer_id"), "heartbeat_deadline")
    rows = state["leases"].join(deadlines, "consumer_id")
    return rows.filter((as_of >= F.col("heartbeat_deadline")) | ((F.col("state") == "RELEASING") & (as_of >= F.col("release_deadline")))).select(*state["leases"].columns)


def expired_consumers(state: State, as_of: Column) -> DataFrame:
    return state["consumers"].filter(as_of >= F.col("heartbeat_deadline"))


def collect_garbage(state: State, as_of: Column, subscription_id: int | None = None) -> State:
    own = lambda df: df if subscription_id is None else df.filter(F.col("subscription_id") == subscription_id)
    gone = own(expired_leases(state, as_of)).select("cursor_id")
    late = own(expired_consumers(state, as_of)).select("id")
    return cascaded(state.having(leases=state["leases"].join(gone, "cursor_id", "left_anti")), "consumers", late)


def delete_consumer(state: State, consumer: str) -> State:
    """With its leases and its choice of topics."""
    return cascaded(state, "consumers", state["consumers"].filter(F.col("id") == consumer).select("id"))


#: A consumer that shuts down leaves as one that is deleted does: its leases go with it.
shut_down_consumer = delete_consumer
