"""The check-in of a consumer, and the same decisions for all consumers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import least, quotient, to_integer
from ..state import State, written
from . import leases, liveness

#: How far above its target a consumer's number of leases may be.
SLACK = 1.1


def active_leases(state: State) -> DataFrame:
    """(consumer_id, subscription_id, active) of consumers with active leases."""
    return state["leases"].filter("state = 'ACTIVE'").groupBy("consumer_id", "subscription_id").agg(F.count("*").alias("active"))


def lease_targets(state: State) -> DataFrame:
    """(consumer_id, subscription_id, target, active_partitions): its share, by weight, of the partitions with work."""
    links = state["subscription_topics"].select("topic_id", "subscription_id", "active_consumers_weight", "active_partitions")
    people = state["consumers"].select(F.col("id").alias("consumer_id"), "subscription_id", "weight")
    theirs = state["consumer_subscriptions"].select("consumer_id", "topic_id").join(people, "consumer_id").join(links, ["topic_id", "subscription_id"])
    sums = theirs.groupBy("consumer_id", "subscription_id").agg(F.max("active_consumers_weight").alias("w"), F.sum("active_partitions").alias("p"))
    rows = people.join(sums, ["consumer_id", "subscription_id"], "left")
    target = F.coalesce(quotient(F.col("weight"), F.col("w")) * F.col("p"), F.lit(0.0))
    return rows.select("consumer_id", "subscription_id", target.alias("target"), F.coalesce("p", F.lit(0)).cast("long").alias("active_partitions"))


def decisions(state: State) -> DataFrame:
    """(consumer_id, subscription_id, active, target, decision, n) for each consumer: release, acquire or none."""
    rows = lease_targets(state).join(active_leases(state), ["consumer_id", "subscription_id"], "left").withColumn("active", F.coalesce("active", F.lit(0)).cast("long"))
    most = least(F.ceil(F.col("target") * F.lit(SLACK)), F.col("active_partitions"))
    decision = F.when(F.col("active") > most, "release").when(F.col("active") < F.col("target"), "acquire").otherwise("none")
    n = F.when(F.col("active") > most, F.col("active") - most).when(F.col("active") < F.col("target"), to_integer(F.col("target") - F.col("active"))).otherwise(F.lit(0))
    return rows.select("consumer_id", "subscription_id", "active", "target", decision.alias("decision"), n.cast("long").alias("n"))


def prepared(state: State, as_of: Column) -> State:
    """What every check-in does first, for all: expired leases and consumers go, metrics are renewed."""
    return liveness.refresh_subscription_metrics(liveness.collect_garbage(state, as_of), as_of)


def check_in_all(state: State, as_of: Column) -> DataFrame:
    """Check-ins of all live consumers on one state, each by itself: heartbeat, deadline, decision and number of leases."""
    state = prepared(state, as_of)
    times = liveness.consumer_intervals(state, as_of).select(F.col("id").alias("consumer_id"), "heartbeat_interval", "heartbeat_deadline")
    return decisions(state).join(times, "consumer_id").withColumn("status", F.lit("ACCEPTED"))


def rebalance(state: State, as_of: Column, pivot: int) -> State:
    """Excess leases of all consumers go into release; free cursors go to consumers that want them, the first by id if several do."""
    state = prepared(state, as_of).checkpointed("consumers", "leases", "subscription_topics", "consumer_subscriptions")
    found = written(decisions(state), "decisions")  # read three times
    turns = leases.acquirable(state, found.filter("decision = 'acquire' and n > 0").select("consumer_id", "subscription_id", "n"), pivot)
    first = turns.groupBy("id").agg(F.min("consumer_id").alias("consumer_id"))
    takes = turns.join(first, ["id", "consumer_id"], "left_semi")
    gone = leases.excess(state, found.filter("decision = 'release'").select("consumer_id", "subscription_id", "n"))
    return leases.releasing(leases.taken_over(state, takes, as_of), gone, as_of)


def check_in(state: State, consumer: str, subscription_id: int, weight: float, as_of: Column, pivot: int) -> tuple[State, DataFrame, DataFrame]:
    """One consumer's check-in: the new state, a row (heartbeat_interval, heartbeat_deadline, status), and its leased cursors.

    A consumer that is late is removed and, if there's room, comes back without its topics.
    """
    state, status = liveness.heartbeat(state, consumer, subscription_id, weight, as_of)
    state = liveness.collect_garbage(state, as_of, subscription_id)
    state = liveness.refresh_subscription_metrics(state, as_of, subscription_id)
    # Written before it is read by all that follows, which else would plan and compute it anew each time.
    state = state.checkpointed("consumers", "leases", "subscription_topics", "consumer_subscriptions")
    if status == "ACCEPTED":
        state = liveness.refresh_consumer_metrics(state, as_of, consumer)
        state, status = liveness.heartbeat(state, consumer, subscription_id, weight, as_of)
        state = state.checkpointed("consumers")
        row = decisions(state).filter(F.col("consumer_id") == consumer).first()
        if row is not None and row.decision == "release":
            state = leases.release_excess(state, consumer, subscription_id, row.n, as_of)
        elif row is not None and row.decision == "acquire" and row.n > 0:
            state = leases.acquire(state, consumer, subscription_id, row.n, pivot, as_of)
        state = state.checkpointed("leases")
    result = state.spark.range(1).select(F.lit(consumer).alias("id"), F.lit(status).alias("status")).join(state["consumers"], "id", "left")
    return state, result.select("heartbeat_interval", "heartbeat_deadline", "status"), leases.leased_cursors(state).filter(F.col("consumer_id") == consumer).orderBy("id")
