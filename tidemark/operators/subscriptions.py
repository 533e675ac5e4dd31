"""Subscriptions, their topics and cursors, and consumers' choice of topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFoundError
from ..functions import numbered, random_key
from ..state import State
from .catalog import find_topic
from .relops import cascaded, insert, single, updated, without


def create_subscription(state: State, name: str, as_of: Column) -> tuple[State, int]:
    new = state.next_id("subscriptions")
    return insert(state, "subscriptions", state.spark.range(1).select(F.lit(new).alias("id"), F.lit(name).alias("name")), as_of).counting(subscriptions=new + 1), new


def find_subscription(state: State, name: str) -> DataFrame:
    return state["subscriptions"].filter(F.col("name") == name)


def delete_subscription(state: State, name: str) -> State:
    """With its topics, cursors and leases; refused while it has consumers."""
    return cascaded(state, "subscriptions", find_subscription(state, name).select("id"))


def new_cursors(links: DataFrame, partitions: DataFrame, first: int) -> DataFrame:
    """links(id, subscription_id, topic_id) -> one cursor at position 0 for each partition of each link's topic."""
    rows = links.select(F.col("id").alias("subscription_topic_id"), "subscription_id", "topic_id").join(partitions.select("topic_id", F.col("id").alias("partition_id")), "topic_id")
    rows = numbered(rows, ["subscription_topic_id", "partition_id"], first, "id")
    return rows.select("id", "subscription_id", "subscription_topic_id", "topic_id", "partition_id", random_key(F.col("id")).alias("random_key"), F.lit(0).cast("long").alias("position"))


def subscribe(state: State, subscription: str, path: str, topic: str, as_of: Column) -> tuple[State, int]:
    s, t = single(find_subscription(state, subscription), subscription), single(find_topic(state, path, topic), topic)
    if s is None or t is None:
        raise NotFoundError(f"subscription {subscription!r} or topic {path}/{topic} does not exist")
    new, first = state.next_id("subscription_topics"), state.next_id("cursors")
    link = state.spark.range(1).select(F.lit(new).alias("id"), F.lit(s.id).alias("subscription_id"), F.lit(t.id).alias("topic_id"))
    state = insert(state, "subscription_topics", link, as_of)
    rows = new_cursors(link, state["partitions"].filter(F.col("topic_id") == t.id), first)
    return insert(state, "cursors", rows, check=False).counting(subscription_topics=new + 1, cursors=first + rows.count()), new


def find_link(state: State, subscription: str, path: str, topic: str) -> DataFrame:
    s, t = find_subscription(state, subscription).select(F.col("id").alias("subscription_id")), find_topic(state, path, topic).select(F.col("id").alias("topic_id"))
    return state["subscription_topics"].join(F.broadcast(s), "subscription_id").join(F.broadcast(t), "topic_id").select(*state["subscription_topics"].columns)


def unsubscribe(state: State, subscription: str, path: str, topic: str) -> State:
    """The link goes with its cursors, their leases, and consumers' choice of it."""
    return cascaded(state, "subscription_topics", find_link(state, subscription, path, topic).select("id"))


def commit(state: State, commits: DataFrame) -> State:
    """commits(id, position): cursors move forward to the largest position committed, never back."""
    top = commits.groupBy("id").agg(F.max("position").alias("new"))
    ahead = state["cursors"].join(top, "id").filter("position < new").select("id", F.col("new").alias("position"))
    return state.having(cursors=updated(state["cursors"], ahead, ["id"], ["position"]))


def chosen_links(state: State, consumers: DataFrame, topics: DataFrame) -> DataFrame:
    """consumers(id, subscription_id), topics(topic_id) -> consumer_subscriptions rows of the links they have."""
    links = state["subscription_topics"].join(topics.select("topic_id").distinct(), "topic_id").select(F.col("id").alias("subscription_topic_id"), "subscription_id", "topic_id")
    return links.join(consumers.select(F.col("id").alias("consumer_id"), "subscription_id"), "subscription_id").select("consumer_id", "subscription_topic_id", "topic_id")


def consumer_subscribe(state: State, consumer: str, path: str, topic: str) -> State:
    rows = chosen_links(state, state["consumers"].filter(F.col("id") == consumer), find_topic(state, path, topic).select(F.col("id").alias("topic_id")))
    if rows.isEmpty():
        raise NotFoundError(f"consumer {consumer!r}'s subscription has no topic {path}/{topic}")
    table = state["consumer_subscriptions"]
    return state.having(consumer_subscriptions=without(table, rows, ["consumer_id", "subscription_topic_id"]).unionByName(rows))


def consumer_unsubscribe(state: State, consumer: str, path: str, topic: str) -> State:
    """The consumer's leases stay until it lets them go."""
    gone = find_topic(state, path, topic).select(F.col("id").alias("topic_id"), F.lit(consumer).alias("consumer_id"))
    return state.having(consumer_subscriptions=without(state["consumer_subscriptions"], gone, ["consumer_id", "topic_id"]))
