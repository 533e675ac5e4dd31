"""Behaviours of the client's calls, from an empty log."""

from datetime import datetime, timedelta

import pytest

from tidemark.api import ACCEPTED, REJECTED, EventLog
from tidemark.errors import ConflictError, ConstraintError, LogError, NotFoundError
from tidemark.sources.store import Store


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 31)

    def __call__(self):
        return self.now


@pytest.fixture
def log(spark):
    return EventLog(spark, clock=Clock(), pivot=lambda: 0)


@pytest.fixture
def small(log):
    """ns-a with topic-a of 4 partitions, sub-a on it."""
    log.namespaces.create("ns-a")
    log.topics.create("ns-a", "topic-a", 4)
    log.subscriptions.create("sub-a")
    log.subscriptions.subscribe("sub-a", "ns-a", "topic-a")
    return log


def paths(log):
    return {r.path for r in log.state["namespaces"].collect()}


def test_rename_reaches_descendants(log):
    for p in ("a", "a/b", "a/b/c"):
        log.namespaces.create(p)
    log.namespaces.rename("a/b", "x")
    assert paths(log) == {"a", "a/x", "a/x/c"}
    assert log.namespaces.find("a/b") is None
    log.namespaces.rename("missing", "y")  # left alone
    log.namespaces.create("a/y")
    with pytest.raises(ConstraintError):
        log.namespaces.rename("a/y", "x")


def test_move_reaches_descendants_and_links(log):
    for p in ("p1", "p1/child", "p1/child/grand", "p2"):
        log.namespaces.create(p)
    log.namespaces.move("p1/child", "p2")
    assert paths(log) == {"p1", "p2", "p2/child", "p2/child/grand"}
    ids = {r.path: r.id for r in log.state["namespaces"].collect()}
    links = {(r.ancestor_id, r.descendant_id): r.depth for r in log.state["namespace_closures"].collect()}
    assert links == {
        **{(i, i): 0 for i in ids.values()},
        (ids["p2"], ids["p2/child"]): 1,
        (ids["p2"], ids["p2/child/grand"]): 2,
        (ids["p2/child"], ids["p2/child/grand"]): 1,
    }
    with pytest.raises(LogError):
        log.namespaces.move("p2", "p2/child")
    log.namespaces.move("p2/child", None)
    assert "child/grand" in paths(log)


def test_delete_takes_descendants(log):
    for p in ("root", "root/child", "root/child/grand", "other"):
        log.namespaces.create(p)
    log.namespaces.delete("root")
    assert paths(log) == {"other"}
    assert log.state["namespace_closures"].count() == 1
    with pytest.raises(NotFoundError):
        log.namespaces.delete("root")
    assert log.namespaces.create("again") > 4  # ids aren't given out twice


@pytest.mark.parametrize("path", ["", "  ", "a/", "/a", "missing/a"])
def test_bad_paths(log, path):
    with pytest.raises(LogError):
        log.namespaces.create(path)


def test_topic_has_partitions_and_is_held_by_them(small):
    part = small.partitions.find("ns-a", "topic-a", 3)
    topic = small.topics.find("ns-a", "topic-a")
    assert part.id == (topic.id << 16) + 3 and part.high_watermark == 0
    with pytest.raises(ConstraintError):
        small.topics.delete("ns-a", "topic-a")
    with pytest.raises(ConstraintError):
        small.namespaces.delete("ns-a")
    with pytest.raises(ConstraintError):
        small.topics.create("ns-a", "topic-a", 1)
    small.topics.create("ns-a", "none", 0)
    assert small.partitions.find("ns-a", "none", 0) is not None
    small.topics.delete("ns-a", "topic-a", cascade=True)
    assert small.topics.find("ns-a", "topic-a") is None and small.state["cursors"].isEmpty()


def test_commit_only_moves_forward(small):
    cursor = small.state["cursors"].first().id
    for position, expected in ((100, 100), (101, 101), (10, 101), (101, 101), (102, 102)):
        small.cursors.commit(cursor, position)
        assert small.cursors.find(cursor).position == expected


def test_published_events_show_after_sequencing(small):
    small.events.publish("ns-a", "topic-a", "partitionKey", '{"key": "value"}\n')
    assert small.cursors.find_leasable(10).isEmpty()
    assert small.events.sequence(100) == 1
    row = small.cursors.find_leasable(10).first()
    assert row.position == 0 and row.subscription_topic_id == small.subscription_topics.find("sub-a", "ns-a", "topic-a").id
    assert [bytes(r.data) for r in small.events.fetch(row.id, 10).collect()] == [b'{"key": "value"}\n']
    small.cursors.commit(row.id, 1)
    assert small.cursors.find_leasable(10).isEmpty()


def test_batches_keep_order_and_refuse_unknown_topics(small):
    small.events.publish_json('[{"path":"ns-a","topic":"topic-a","key":"k","data":{"n":1}},{"path":"ns-a","topic":"topic-a","key":"k","data":{"n":2}}]')
    small.events.publish_to(small.partitions.find("ns-a", "topic-a", 0).id, b"x")
    assert small.events.sequence(2) == 2 and small.events.sequence() == 1 and small.events.sequence() == 0
    rows = small.state["sequences"].join(small.state["events"].withColumnRenamed("id", "event_id"), "event_id").orderBy("sequence").collect()
    assert [bytes(r.data) for r in rows] == [b'{"n":1}', b'{"n":2}', b"x"]
    with pytest.raises(NotFoundError):
        small.events.publish("ns-a", "nothing", "k", b"")
    assert small.state["events"].count() == 3


def test_subscriptions(small):
    for name in ("sub-b", "sub-c", "sub-d"):
        small.subscriptions.create(name)
    assert small.subscriptions.find("sub-b").name == "sub-b" and small.subscriptions.find("none") is None
    assert [r.name for r in small.subscriptions.find_all(2, 1).collect()] == ["sub-b", "sub-c"]
    with pytest.raises(ConstraintError):
        small.subscriptions.create("sub-b")
    small.subscriptions.delete("sub-d")
    assert small.subscriptions.find("sub-d") is None
    small.subscriptions.subscribe("sub-b", "ns-a", "topic-a")
    assert small.subscription_topics.find_all(10).count() == 2
    small.subscriptions.unsubscribe("sub-a", "ns-a", "topic-a")
    assert small.state["cursors"].select("subscription_id").distinct().count() == 1


def publish_everywhere(log, partitions=4):
    for n in range(partitions):
        log.events.publish_to(log.partitions.find("ns-a", "topic-a", n).id, b"x")
    log.events.sequence()


def test_check_in_shares_by_weight_and_hands_over(small):
    publish_everywhere(small)
    first = small.consumers.check_in("one", "sub-a")
    assert first.status == ACCEPTED and first.cursors.isEmpty()  # no topics yet
    small.consumer_subscriptions.subscribe("one", "ns-a", "topic-a")
    small.log_clock = small.clock
    assert small.consumers.check_in("one", "sub-a").cursors.count() == 4
    lease = small.state["leases"].first()
    assert lease.version == 1 and lease.state == "ACTIVE"
    small.leases.release(lease.cursor_id, "other")  # not the holder's
    assert small.leases.find(lease.cursor_id).state == "ACTIVE"
    small.leases.release(lease.cursor_id, "one")
    assert small.leases.find(lease.cursor_id).state == "RELEASING"
    small.clock.now += timedelta(seconds=10)
    small.consumers.check_in("one", "sub-a")  # the release has run out: gone, and free to take again
    assert small.leases.find(lease.cursor_id).version == 1
    small.consumers.check_in("two", "sub-a", 3.0)
    small.consumer_subscriptions.subscribe("two", "ns-a", "topic-a")
    small.consumers.check_in("two", "sub-a", 3.0)  # wants three of four, and takes them over
    assert small.state["leases"].filter("consumer_id = 'two'").count() == 3
    assert small.state["leases"].filter("version = 2").count() == 3
    small.consumers.shutdown("two")
    assert small.state["leases"].filter("consumer_id = 'two'").isEmpty()
    small.consumers.delete("one")
    assert small.state["leases"].isEmpty() and small.state["consumer_subscriptions"].isEmpty()


def test_late_consumer_comes_back_without_topics(small):
    publish_everywhere(small)
    small.consumers.check_in("one", "sub-a")
    small.consumer_subscriptions.subscribe("one", "ns-a", "topic-a")
    small.consumers.check_in("one", "sub-a")
    small.clock.now += timedelta(hours=1)
    late = small.consumers.check_in("one", "sub-a")
    assert late.status == ACCEPTED and late.cursors.isEmpty()
    assert small.consumer_subscriptions.find_all("one").isEmpty()


def test_rejected_at_the_limit(small):
    small.lease_policy.update(active_consumers_limit=1)
    small.consumers.check_in("one", "sub-a")
    small.consumer_subscriptions.subscribe("one", "ns-a", "topic-a")
    small.consumers.check_in("one", "sub-a")
    second = small.consumers.check_in("two", "sub-a")
    assert second.status == REJECTED and second.heartbeat_deadline is None
    with pytest.raises(ConstraintError):
        small.subscriptions.delete("sub-a")  # its consumer holds it


def test_policies(log):
    log.heartbeat_policy.update(deadline_multiplier=4.0, target_qps=5.0)
    assert log.heartbeat_policy.get().asDict() == {"id": 1, "deadline_multiplier": 4.0, "interval_baseline": 3.0, "interval_limit": 60.0, "target_qps": 5.0}
    log.lease_policy.update(lease_release_period=20)
    assert log.lease_policy.get().lease_release_period == 20
    log.metrics_policy.update(metrics_refresh_interval=9)
    assert log.metrics_policy.get().metrics_refresh_interval == 9
    with pytest.raises(ValueError):
        log.metrics_policy.update(id=2)


def test_store_refuses_the_second_writer(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    one = EventLog(spark, store=Store(spark, root), clock=Clock())
    one.namespaces.create("a")
    two = EventLog(spark, store=Store(spark, root), clock=Clock())
    assert two.namespaces.find("a") is not None
    two.namespaces.create("b")
    with pytest.raises(ConflictError):
        one.namespaces.create("c")
    assert paths(EventLog(spark, store=Store(spark, root))) == {"a", "b"}


def files(root):
    return {p.relative_to(root) for p in root.rglob("*.parquet")}


def test_store_appends_what_is_published(spark, tmp_path):
    """A publish writes the new events, not the log; a sequenced batch neither the queue nor the log."""
    root = tmp_path / "log"
    log = EventLog(spark, store=Store(spark, f"file://{root}"), clock=Clock())
    log.namespaces.create("a")
    log.topics.create("a", "t", 2)
    rows = spark.range(500).selectExpr("id as pos", "'a' as path", "'t' as topic", "cast(id as string) as key", "cast(cast(id as string) as binary) as data")
    log.events.publish_all(rows, ["pos"])
    before = files(root)
    log.events.publish("a", "t", "one more", b"x")
    new = files(root) - before
    assert {p.parts[1] for p in new} == {"events", "unprocessed_events"}
    assert sum(spark.read.parquet(str(root / p)).count() for p in new) == 2
    before = files(root)
    assert log.events.sequence(100) == 100
    new = files(root) - before
    assert {p.parts[1] for p in new} == {"sequences", "partitions"}
    assert log.state["unprocessed_events"].count() == 401
    # Another reader sees the same, and goes on from there.
    other = EventLog(spark, store=Store(spark, f"file://{root}"), clock=Clock())
    assert (other.state["events"].count(), other.state["unprocessed_events"].count(), other.state["sequences"].count()) == (501, 401, 100)
    assert other.events.sequence() == 401 and other.state["unprocessed_events"].isEmpty()
    assert [r.sequence for r in other.state["sequences"].orderBy("sequence").collect()] == list(range(1, 502))
    assert other.state["sequences"].filter("sequence <> event_id").isEmpty()


def test_many_folders_become_one(spark, tmp_path, monkeypatch):
    from tidemark import state as state_module

    monkeypatch.setattr(state_module, "MOST_PARTS", 2)
    log = EventLog(spark, store=Store(spark, f"file://{tmp_path}/log"), clock=Clock())
    log.namespaces.create("a")
    log.topics.create("a", "t", 1)
    for i in range(5):
        log.events.publish("a", "t", "k", str(i))
        if i == 2:
            log.events.sequence(2)
    assert len(log.state.parts["events"]) <= 3
    assert [bytes(r.data) for r in log.state["events"].orderBy("id").collect()] == [b"0", b"1", b"2", b"3", b"4"]
    assert sorted(r.id for r in log.state["unprocessed_events"].collect()) == [3, 4, 5]


def test_paths_are_stored_as_given(log):
    log.namespaces.create(" a ")
    assert paths(log) == {" a "} and log.namespaces.find("a") is None
    log.namespaces.create("\ta")  # only blanks are no name
    with pytest.raises(LogError):
        log.namespaces.create(" a /  ")
