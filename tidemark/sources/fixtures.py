"""An event log derived from the driver's tables: the state that the registered queries run on.

It is built once for each folder and session and written as tables, as a log's state would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import DELIMITER, numbered_in_bulk, path_hash, plus_seconds, random_key
from ..operators.catalog import closure_of, generated_partitions
from ..operators.log import lifted, routed
from ..operators.subscriptions import chosen_links
from ..state import State, bootstrap, written

AS_OF = "2024-01-31 00:00:00"
#: Partitions of a topic, and the part of all events that is sequenced.
PARTITIONS, SEQUENCED = 16, (9, 10)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _ago(seconds: Column) -> Column:
    return plus_seconds(as_of(), -seconds)


def _ranked(names: DataFrame, column: str) -> DataFrame:
    """The distinct names with a number by order."""
    return names.select(F.col(column).alias("name")).distinct().withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))


def namespaces(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    top = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.col("r_name").alias("path"))

    def below(rows: DataFrame, above: DataFrame, number: Column, parent: Column, name: str) -> DataFrame:
        own = rows.select(number.cast("long").alias("id"), parent.cast("long").alias("parent_id"), F.col(name).alias("name"))
        return own.join(above.select(F.col("id").alias("parent_id"), F.col("path").alias("_above")), "parent_id").select("id", "parent_id", "name", F.concat_ws(DELIMITER, "_above", "name").alias("path"))

    middle = below(nation, top, F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, "n_name")
    leaf = below(supplier, middle, F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, "s_name")
    rows = top.unionByName(middle).unionByName(leaf)
    return rows.withColumn("path_hash", path_hash(F.col("path"))).withColumn("created_at", as_of()).withColumn("last_modified_at", as_of())


def keyed_events(events: DataFrame) -> DataFrame:
    """(id, path, topic, key, data) of the driver's events: the topic is the type, the key the user."""
    return events.select((F.col("event_id") + 1).alias("id"), F.lit("log").alias("path"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("data"))


def derived(spark: SparkSession, sf_dir: str) -> State:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Every customer is a consumer; those of one market segment and nation share a subscription.
    events, customer = read("events"), read("customer").select("c_custkey", "c_nationkey", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("market"))
    state = bootstrap(spark)
    state = state.having(namespaces=written(namespaces(read("region"), read("nation"), read("supplier")), "namespaces"))
    state = state.having(namespace_closures=closure_of(state["namespaces"]))
    topics = _ranked(events, "event_type").select("id", F.col("id").alias("namespace_id"), "name", F.lit(PARTITIONS).alias("partitions"), as_of().alias("created_at"), as_of().alias("last_modified_at"))
    state = state.having(topics=written(topics, "topics"))
    log = keyed_events(events)
    known = state["topics"].select(F.lit("log").alias("path"), F.col("name").alias("topic"), F.col("id").alias("topic_id"), "partitions")
    rows = routed(log, known).select("id", "partition_id", F.col("data").cast("binary").alias("data"))
    share, whole = SEQUENCED
    placed = written(numbered_in_bulk(rows, "id", 1, "sequence"), "log")
    n = placed.count() * share // whole
    state = state.having(
        events=placed.select("id", "data"), sequences=placed.filter(F.col("sequence") <= n).select("sequence", "partition_id", F.col("id").alias("event_id")),
        unprocessed_events=placed.filter(F.col("sequence") > n).select("id", "partition_id"),
    )
    state = state.having(partitions=written(lifted(generated_partitions(state["topics"]), state["sequences"]), "partitions"))
    markets = _ranked(customer, "market")
    state = state.having(subscriptions=written(markets.select("id", "name", as_of().alias("last_modified_at")), "subscriptions"))
    # Subscriptions and topics whose numbers are both even or both odd.
    parity = lambda c: (F.col(c) % 2).alias("parity")
    links = markets.select(F.col("id").alias("subscription_id"), parity("id")).join(state["topics"].select(F.col("id").alias("topic_id"), parity("id")), "parity").drop("parity")
    links = links.withColumn("id", F.row_number().over(Window.orderBy("subscription_id", "topic_id")).cast("long"))
    links = links.select("id", "subscription_id", "topic_id", F.lit(15.0).alias("heartbeat_interval"), F.lit(0).alias("active_partitions"), F.lit(0).alias("active_consumers"), F.lit(0.0).alias("active_consumers_weight"), as_of().alias("created_at"), as_of().alias("last_modified_at"))
    state = state.having(subscription_topics=written(links, "links"))
    parts = state["partitions"].select(F.col("id").alias("partition_id"), "topic_id", F.col("high_watermark").alias("hw"))
    cursors = state["subscription_topics"].select(F.col("id").alias("subscription_topic_id"), "subscription_id", "topic_id").join(parts, "topic_id")
    cursors = cursors.withColumn("id", F.row_number().over(Window.orderBy("subscription_topic_id", "partition_id")).cast("long"))
    position = F.least("hw", F.expr("hw * (id % 5) div 4"))
    cursors = cursors.select("id", "subscription_id", "subscription_topic_id", "topic_id", "partition_id", random_key(F.col("id")).alias("random_key"), position.alias("position"))
    state = state.having(cursors=written(cursors, "cursors"))
    key = F.col("c_custkey")
    seen = _ago(key % 20)
    people = customer.join(markets.select(F.col("name").alias("market"), F.col("id").alias("subscription_id")), "market")
    people = people.select(
        F.concat(F.lit("c-"), key.cast("string")).alias("id"), "subscription_id", (1 + F.col("c_nationkey") % 3).cast("double").alias("weight"),
        seen.alias("heartbeat_detected_at"), F.lit(3.0).alias("heartbeat_interval"), plus_seconds(seen, F.when(key % 7 == 0, -1).otherwise(15)).alias("heartbeat_deadline"),
    )
    state = state.having(consumers=written(people, "consumers"))
    state = state.having(consumer_subscriptions=chosen_links(state, state["consumers"], state["topics"].select(F.col("id").alias("topic_id"))))
    places = Window.partitionBy("subscription_id")
    holders = state["consumers"].select("subscription_id", F.col("id").alias("consumer_id"), (F.row_number().over(places.orderBy("id")) - 1).alias("place"), F.count("*").over(places).alias("people"))
    held = state["cursors"].filter("id % 3 <> 1").join(holders, "subscription_id").filter("place = (id * id) % people")
    going = F.col("id") % 6 == 0
    leases = held.select(
        F.col("id").alias("cursor_id"), "subscription_id", "topic_id", "partition_id", "consumer_id", F.lit(1).alias("version"), _ago(F.col("id")).alias("acquired_at"),
        F.when(going, _ago(F.col("id") % 20)).alias("released_at"), F.when(going, plus_seconds(_ago(F.col("id") % 20), F.lit(10))).alias("release_deadline"),
        F.when(going, "RELEASING").otherwise("ACTIVE").alias("state"),
    )
    return state.having(leases=leases).checkpointed("namespace_closures", "consumer_subscriptions", "leases")


_states: dict[tuple[str, str], State] = {}


def state_of(spark: SparkSession, sf_dir: str) -> State:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _states:
        _states[key] = derived(spark, sf_dir)
    return _states[key]
