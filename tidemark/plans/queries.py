"""One query for each operation of the event log, on the state derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LogError
from ..functions import name_of, parent_of, path_hash
from ..operators import catalog, checkin, leases, liveness, log, policies, subscriptions
from ..operators.relops import insert
from ..schemas import TABLES
from ..sources.fixtures import as_of, keyed_events, state_of
from ..state import shared_folder
from ..streaming.sequencer import Sequencer, fetch_stream, read_sequences, sequence_stream, watermark_stream, watermarks

#: Fixed values of the queries: the pivot of random keys and the size of a sequenced batch.
PIVOT, BATCH_SIZE = 0, 100

_QUERIES: dict = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_QUERIES)


def _hex(c: str):
    return F.hex(c).alias(c)


def _topics(state) -> DataFrame:
    return state["topics"].select(F.lit("log").alias("path"), F.col("name").alias("topic"), F.col("id").alias("topic_id"), "partitions")


# --- the log


@query
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.routed(keyed_events(spark.read.parquet(f"{sf_dir}/events.parquet")), _topics(state_of(spark, sf_dir)))
    return rows.select("id", "topic_id", "partition_number", "partition_id")


@query
def publish_multi_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = keyed_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    one = F.struct("id", F.to_json(F.struct("path", "topic", "key", "data")).alias("json"))
    # A batch holds a hundred events by id, so no batch grows with the log.
    batches = events.groupBy(F.floor(F.col("id") / 100).alias("batch_no")).agg(F.sort_array(F.collect_list(one)).alias("found"))
    batches = batches.select("batch_no", F.concat(F.lit("["), F.array_join("found.json", ","), F.lit("]")).alias("batch"))
    rows = log.routed(log.batch_events(batches), _topics(state_of(spark, sf_dir)))
    return rows.select("batch_no", F.col("pos").cast("long").alias("pos"), "topic", "key", "data", "partition_id")


@query
def sequence_batch(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return log.sequenced(log.claimed(s["unprocessed_events"], BATCH_SIZE), s.next_id("sequences"), bounded=True)


@query
def sequence_all(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return log.sequenced(s["unprocessed_events"], s.next_id("sequences"), bounded=False)


@query
def unprocessed_remaining(spark, sf_dir):
    return log.sequence(state_of(spark, sf_dir), BATCH_SIZE)[0]["unprocessed_events"]


@query
def partition_high_watermark(spark, sf_dir):
    return log.sequence(state_of(spark, sf_dir), BATCH_SIZE)[0]["partitions"]


@query
def fetch_after_position(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return log.fetch(s, s["cursors"], most=10).select("cursor_id", "sequence", "event_id", F.col("data").cast("string").alias("data"))


@query
def consumer_lag(spark, sf_dir):
    return log.lag(state_of(spark, sf_dir))


def _streamed(spark, sf_dir) -> tuple[str, Sequencer]:
    """The driver's events, sequenced as a stream of two micro-batches, and one event of an unknown topic."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{root}/source"
    events = keyed_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    half = events.agg(F.floor(F.max("id") / 2)).first()[0] or 0
    stray = events.limit(1).withColumn("topic", F.lit("unknown"))
    for part in (events.filter(F.col("id") <= half).unionByName(stray), events.filter(F.col("id") > half)):  # files come in the order of their times
        part.repartitionByRange(2, "id").write.mode("append").parquet(source)
    sequencer = Sequencer(spark, root, _topics(state_of(spark, sf_dir)))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    sequence_stream(stream, sequencer, f"{root}/checkpoint").awaitTermination()
    return root, sequencer


@query
def stream_sequence_watermark(spark, sf_dir):
    root, _ = _streamed(spark, sf_dir)
    watermark_stream(read_sequences(spark, root), f"{root}/tops", f"{root}/checkpoint-tops").awaitTermination()
    return watermarks(spark, f"{root}/tops").select("partition_id", F.col("high_watermark").alias("last_sequence"))


@query
def stream_refused(spark, sf_dir):
    _, sequencer = _streamed(spark, sf_dir)
    return sequencer.refused("id long, path string, topic string, key string, data string").groupBy("topic").agg(F.count("*").alias("n"))


@query
def stream_fetch(spark, sf_dir):
    """Every cursor follows the stream from its position on."""
    s = state_of(spark, sf_dir)
    root, _ = _streamed(spark, sf_dir)
    fetch_stream(read_sequences(spark, root), s["cursors"], s["events"], f"{root}/fetched", f"{root}/checkpoint-fetched").awaitTermination()
    rows = spark.read.schema("cursor_id long, sequence long, event_id long, data binary, batch long").parquet(f"{root}/fetched")
    return rows.groupBy("cursor_id").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.sum(F.length("data")).alias("bytes"))


@query
def publish_to_partition(spark, sf_dir):
    """Events that name their partition are appended without a look at it."""
    s = state_of(spark, sf_dir)
    events = log.routed(keyed_events(spark.read.parquet(f"{sf_dir}/events.parquet")), _topics(s)).select("id", "partition_id", "data")
    return log.publish_to(s, events, ["id"])["unprocessed_events"].select("id", "partition_id")


@query
def publish_then_sequence(spark, sf_dir):
    """All events once more by path, topic and key, then one batch sequenced: the log's sizes and positions after both."""
    s = state_of(spark, sf_dir)
    names = catalog.resolved_topics(s).select(F.col("path").alias("home"), F.col("topic"))
    events = keyed_events(spark.read.parquet(f"{sf_dir}/events.parquet")).join(names, "topic").select("id", F.col("home").alias("path"), "topic", "key", "data")
    after, n = log.sequence(log.publish(s, events, ["id"]).checkpointed("events", "unprocessed_events"), BATCH_SIZE)
    count = lambda t: after[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.max(TABLES[t].key[0]).alias("last_id"))
    return count("events").unionByName(count("unprocessed_events")).unionByName(count("sequences"))


# --- cursors and leases


@query
def unleased_cursors(spark, sf_dir):
    return leases.unleased_cursors(state_of(spark, sf_dir))


@query
def unleased_cursors_documented(spark, sf_dir):
    return leases.unleased_cursors(state_of(spark, sf_dir), as_of())


@query
def leased_cursors(spark, sf_dir):
    return leases.leased_cursors(state_of(spark, sf_dir))


@query
def cursor_commit(spark, sf_dir):
    s = state_of(spark, sf_dir)
    # Each cursor is committed twice: to half its position, which is ignored, and, for every other one, beyond it.
    low = s["cursors"].select("id", F.expr("position div 2").alias("position"))
    high = s["cursors"].filter("id % 2 = 0").select("id", (F.col("position") + F.col("id")).alias("position"))
    return subscriptions.commit(s, low.unionByName(high))["cursors"].select("id", "position")


@query
def acquire_candidates(spark, sf_dir):
    s = state_of(spark, sf_dir)
    wanted = s["consumers"].select(F.col("id").alias("consumer_id"), "subscription_id", F.lit(3).alias("n"))
    return leases.acquirable(s, wanted, PIVOT).select("consumer_id", F.col("id").alias("cursor_id"), "turn")


@query
def acquire_upsert_result(spark, sf_dir):
    return leases.acquire(state_of(spark, sf_dir), "c-1", _subscription(spark, sf_dir, "c-1"), 20, PIVOT, as_of())["leases"]


def _subscription(spark, sf_dir, consumer: str) -> int:
    return state_of(spark, sf_dir)["consumers"].filter(F.col("id") == consumer).first().subscription_id


@query
def release_excess_candidates(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return leases.excess(s, s["consumers"].select(F.col("id").alias("consumer_id"), "subscription_id", F.lit(2).alias("n")))


@query
def lease_release_excess(spark, sf_dir):
    return leases.release_excess(state_of(spark, sf_dir), "c-1", _subscription(spark, sf_dir, "c-1"), 2, as_of())["leases"].filter("state = 'RELEASING'")


@query
def lease_release(spark, sf_dir):
    s = state_of(spark, sf_dir)
    row = s["leases"].filter("state = 'ACTIVE'").orderBy("cursor_id").first()
    return leases.release(s, row.cursor_id, row.consumer_id, as_of())["leases"].filter("state = 'RELEASING'")


# --- metrics, liveness, fair shares


@query
def subscription_topic_metrics(spark, sf_dir):
    return liveness.subscription_metrics(state_of(spark, sf_dir), as_of())


@query
def lease_counts_by_consumer(spark, sf_dir):
    return checkin.active_leases(state_of(spark, sf_dir))


@query
def gc_leases(spark, sf_dir):
    return liveness.expired_leases(state_of(spark, sf_dir), as_of()).select("cursor_id", "consumer_id", "state")


@query
def gc_consumers(spark, sf_dir):
    return liveness.collect_garbage(state_of(spark, sf_dir), as_of())["consumers"].select("id", "subscription_id", "weight")


@query
def gc_remaining_leases(spark, sf_dir):
    return liveness.collect_garbage(state_of(spark, sf_dir), as_of())["leases"].select("cursor_id", "consumer_id", "state")


@query
def heartbeat_admission(spark, sf_dir):
    s = policies.update_policy(liveness.refresh_subscription_metrics(state_of(spark, sf_dir), as_of()), "lease_policies", active_consumers_limit=5)
    known = s["consumers"].select("id", "subscription_id", "weight")
    new = s["subscriptions"].select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("subscription_id"), F.lit(1.0).alias("weight"))
    return liveness.admissions(s, known.unionByName(new), as_of())


@query
def consumer_heartbeat_deadline(spark, sf_dir):
    return liveness.consumer_intervals(liveness.refresh_subscription_metrics(state_of(spark, sf_dir), as_of()), as_of())


@query
def consumer_lease_target(spark, sf_dir):
    return checkin.lease_targets(liveness.refresh_subscription_metrics(state_of(spark, sf_dir), as_of()))


@query
def rebalance_decision(spark, sf_dir):
    return checkin.decisions(checkin.prepared(state_of(spark, sf_dir), as_of()))


@query
def rebalance_leases(spark, sf_dir):
    return checkin.rebalance(state_of(spark, sf_dir), as_of(), PIVOT)["leases"].select("cursor_id", "consumer_id", "version", "state")


@query
def check_in_all(spark, sf_dir):
    return checkin.check_in_all(state_of(spark, sf_dir), as_of()).select("consumer_id", "status", "heartbeat_interval", "heartbeat_deadline", "decision", "n")


@query
def check_in_one(spark, sf_dir):
    return checkin.check_in(state_of(spark, sf_dir), "c-1", _subscription(spark, sf_dir, "c-1"), 1.0, as_of(), PIVOT)[2].select("id", "consumer_id", "lease_id")


# --- the catalogue


@query
def namespace_closure(spark, sf_dir):
    return catalog.closure_of(state_of(spark, sf_dir)["namespaces"])


@query
def namespace_descendants(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.descendants(s["namespace_closures"], s["namespaces"].filter("parent_id is null").select("id"))


@query
def namespace_ancestors(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.ancestors(s["namespace_closures"], s["namespaces"].select("id"))


def _first_paths(s) -> tuple[str, str]:
    """A nation's path, and the path of a region that is not above it."""
    nation = s["namespaces"].filter("id >= 100 and id < 1000").orderBy("id").first()
    other = s["namespaces"].filter((F.col("parent_id").isNull()) & (F.col("id") != nation.parent_id)).orderBy("id").first()
    return nation.path, other.path


@query
def namespace_rename(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.rename_namespace(s, _first_paths(s)[0], "renamed", as_of())["namespaces"].select("id", "parent_id", "name", "path", _hex("path_hash"))


@query
def namespace_move_paths(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.move_namespace(s, *_first_paths(s), as_of())["namespaces"].select("id", "parent_id", "name", "path")


@query
def namespace_move_closures(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.move_namespace(s, *_first_paths(s), as_of())["namespace_closures"]


@query
def namespace_delete_survivors(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.delete_namespace(s, _first_paths(s)[0])["namespaces"].select("id", "path")


@query
def namespace_create(spark, sf_dir):
    s = state_of(spark, sf_dir)
    path, _ = _first_paths(s)
    return catalog.create_namespace(s, f"{path}/added", as_of())[0]["namespace_closures"]


@query
def namespace_create_as_given(spark, sf_dir):
    """Blanks around a name are part of it."""
    s = catalog.create_namespace(state_of(spark, sf_dir), " added ", as_of())[0]
    return s["namespaces"].select("id", "name", "path", _hex("path_hash"))


@query
def constraint_outcomes(spark, sf_dir):
    """What the constraints refuse, each tried on the same state: duplicates, rows that are held, references to nothing, bad values."""
    s = state_of(spark, sf_dir)
    path, _ = _first_paths(s)
    top = s["topics"].orderBy("id").first()
    home = s["namespaces"].filter(F.col("id") == top.namespace_id).first().path
    name = s["subscriptions"].orderBy("id").first().name
    row = lambda **v: spark.range(1).select(*(F.lit(x).alias(c) for c, x in v.items()))
    tries = {
        "namespace_again": lambda: catalog.create_namespace(s, path, as_of()),
        "namespace_below_nothing": lambda: catalog.create_namespace(s, "nowhere/x", as_of()),
        "namespace_blank": lambda: catalog.create_namespace(s, "  ", as_of()),
        "namespace_with_topic_deleted": lambda: catalog.delete_namespace(s, home),
        "topic_again": lambda: catalog.create_topic(s, home, top.name, 1, as_of()),
        "topic_with_partitions_deleted": lambda: catalog.delete_topic(s, home, top.name),
        "subscription_again": lambda: subscriptions.create_subscription(s, name, as_of()),
        "subscription_with_consumers_deleted": lambda: subscriptions.delete_subscription(s, name),
        "consumer_of_nothing": lambda: insert(s, "consumers", row(id="x", subscription_id=-1, weight=1.0, heartbeat_interval=1.0), as_of()),
        "lease_in_no_state": lambda: insert(s, "leases", s["leases"].limit(1).withColumn("state", F.lit("LOST"))),
        "namespace_moved_below_itself": lambda: catalog.move_namespace(s, path, path, as_of()),
        "namespace_added": lambda: catalog.create_namespace(s, f"{path}/added", as_of()),
    }

    def outcome(attempt) -> str:
        try:
            attempt()
        except LogError as error:
            return type(error).__name__
        return "done"

    return spark.createDataFrame([(n, outcome(f)) for n, f in tries.items()], "attempt string, outcome string")


@query
def namespace_lookup(spark, sf_dir):
    s = state_of(spark, sf_dir)["namespaces"]
    wanted = s.select(path_hash(F.col("path")).alias("path_hash"), "path")
    return s.select("id", "path", "path_hash").join(wanted, ["path_hash", "path"]).select("id", "path", _hex("path_hash"))


@query
def path_parse(spark, sf_dir):
    return state_of(spark, sf_dir)["namespaces"].select("path", name_of(F.col("path")).alias("name"), parent_of(F.col("path")).alias("parent"))


@query
def topic_partitions_generate(spark, sf_dir):
    return catalog.generated_partitions(state_of(spark, sf_dir)["topics"])


@query
def topic_create(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return catalog.create_topic(s, _first_paths(s)[0], "added", 3, as_of())[0]["partitions"].select("id", "topic_id", "partition_number")


@query
def topic_delete(spark, sf_dir):
    s = state_of(spark, sf_dir)
    top = s["topics"].orderBy("id").first()
    path = s["namespaces"].filter(F.col("id") == top.namespace_id).first().path
    return catalog.delete_topic(s, path, top.name, cascade=True)["cursors"].select("id", "topic_id")


@query
def topic_lookup(spark, sf_dir):
    return catalog.resolved_topics(state_of(spark, sf_dir))


@query
def partition_lookup(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return s["partitions"].join(catalog.resolved_topics(s), "topic_id").select("path", "topic", "partition_number", "id", "high_watermark")


# --- subscriptions and consumers


@query
def subscribe_cursors(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return subscriptions.new_cursors(s["subscription_topics"].select("id", "subscription_id", "topic_id"), s["partitions"], 1)


def _some_link(s) -> tuple[str, str, str]:
    link = s["subscription_topics"].orderBy("id").first()
    topic = s["topics"].filter(F.col("id") == link.topic_id).first()
    return s["subscriptions"].filter(F.col("id") == link.subscription_id).first().name, s["namespaces"].filter(F.col("id") == topic.namespace_id).first().path, topic.name


@query
def unsubscribe_cascade(spark, sf_dir):
    s = state_of(spark, sf_dir)
    after = subscriptions.unsubscribe(s, *_some_link(s))
    counts = [after[t].select(F.lit(t).alias("table_name"), F.lit(1).alias("one")) for t in ("subscription_topics", "cursors", "leases", "consumer_subscriptions")]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return rows.groupBy("table_name").agg(F.count("*").alias("left_rows"))


@query
def subscription_topic_lookup(spark, sf_dir):
    s = state_of(spark, sf_dir)
    names = s["subscriptions"].select(F.col("id").alias("subscription_id"), F.col("name").alias("subscription"))
    topics = s["topics"].select(F.col("id").alias("topic_id"), F.col("name").alias("topic"))
    return s["subscription_topics"].join(names, "subscription_id").join(topics, "topic_id").select("id", "subscription", "topic", "heartbeat_interval")


@query
def consumer_topic_subscribe(spark, sf_dir):
    s = state_of(spark, sf_dir)
    return subscriptions.chosen_links(s, s["consumers"], s["topics"].select(F.col("id").alias("topic_id")))


@query
def consumer_topic_unsubscribe(spark, sf_dir):
    s = state_of(spark, sf_dir)
    _, path, topic = _some_link(s)
    return subscriptions.consumer_unsubscribe(s, "c-1", path, topic)["consumer_subscriptions"]


@query
def subscription_create(spark, sf_dir):
    return subscriptions.create_subscription(state_of(spark, sf_dir), "added", as_of())[0]["subscriptions"].select("id", "name")


@query
def subscription_delete_cascade(spark, sf_dir):
    """A subscription whose consumers have gone takes its topics, cursors and leases with it."""
    s = state_of(spark, sf_dir)
    first = s["subscriptions"].orderBy("id").first()
    s = s.having(consumers=s["consumers"].filter(F.col("subscription_id") != first.id))
    after = subscriptions.delete_subscription(s, first.name)
    rows = [after[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("left_rows")) for t in ("subscriptions", "subscription_topics", "cursors", "leases")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query
def consumer_shutdown(spark, sf_dir):
    after = liveness.shut_down_consumer(state_of(spark, sf_dir), "c-1")
    rows = [after[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("left_rows")) for t in ("consumers", "consumer_subscriptions", "leases")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def consumer_delete_cascade(spark, sf_dir):
    after = liveness.delete_consumer(state_of(spark, sf_dir), "c-1")
    return after["leases"].select("cursor_id", "consumer_id")


@query
def subscriptions_page(spark, sf_dir):
    return state_of(spark, sf_dir)["subscriptions"].orderBy("id").offset(1).limit(3).select("id", "name")


@query
def consumers_page(spark, sf_dir):
    return state_of(spark, sf_dir)["consumers"].orderBy("id").offset(10).limit(10).select("id", "subscription_id", "weight")


@query
def leasable_page(spark, sf_dir):
    return leases.unleased_cursors(state_of(spark, sf_dir)).orderBy("id").offset(5).limit(20).select("id", "subscription_id", "partition_id", "position")


@query
def policy_update(spark, sf_dir):
    s = policies.update_policy(state_of(spark, sf_dir), "heartbeat_policies", deadline_multiplier=4.0, interval_baseline=2.0, interval_limit=30.0, target_qps=5.0)
    s = policies.update_policy(s, "lease_policies", active_consumers_limit=8, lease_release_period=20)
    s = policies.update_policy(s, "metrics_policies", metrics_refresh_interval=7)
    return s["heartbeat_policies"].join(s["lease_policies"], "id").join(s["metrics_policies"], "id")


