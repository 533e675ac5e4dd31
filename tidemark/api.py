"""The client's view: an EventLog holds a current state, and each of its parts has the calls on one kind of row.

Lookups return rows (or None), listings return DataFrames in order, changes replace the log's state. With a store, every
change is published as a new version; a change that another writer was faster with is refused and leaves the log as it was.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import NotFoundError
from .operators import catalog, checkin, leases, liveness, log, policies, subscriptions
from .operators.relops import single
from .sources.store import Store
from .state import State, bootstrap

ACCEPTED, REJECTED = "ACCEPTED", "REJECTED"


@dataclass(frozen=True)
class CheckIn:
    """What a check-in gives: the time between heartbeats, the deadline (null if rejected), and the leased cursors."""

    status: str
    heartbeat_interval: float | None
    heartbeat_deadline: datetime | None
    cursors: DataFrame


def _now() -> datetime:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


class EventLog:
    def __init__(self, spark: SparkSession, state: State | None = None, store: Store | None = None, clock: Callable[[], datetime] = _now, pivot: Callable[[], int] | None = None):
        """clock gives the time of a call, pivot the random key that an acquisition starts from."""
        self.spark, self.store, self.clock = spark, store, clock
        self.pivot = pivot or (lambda: random.randint(-(1 << 31), (1 << 31) - 1))
        self.version = 0
        if store is not None and state is None and store.versions():
            state, self.version = store.load()
        self.state = state or bootstrap(spark)
        self.namespaces, self.topics, self.partitions, self.events = Namespaces(self), Topics(self), Partitions(self), Events(self)
        self.subscriptions, self.subscription_topics, self.cursors = Subscriptions(self), SubscriptionTopics(self), Cursors(self)
        self.consumers, self.consumer_subscriptions, self.leases = Consumers(self), ConsumerSubscriptions(self), Leases(self)
        self.heartbeat_policy, self.lease_policy, self.metrics_policy = Policy(self, "heartbeat_policies"), Policy(self, "lease_policies"), Policy(self, "metrics_policies")

    @property
    def as_of(self) -> Column:
        return F.lit(self.clock()).cast("timestamp_ntz")

    def commit(self, state: State) -> None:
        changed = [n for n, df in state.tables.items() if df is not self.state.tables[n]]
        if self.store is not None:
            self.state, self.version = self.store.save(state, self.version + 1), self.version + 1
        else:
            self.state = state.checkpointed(*changed) if changed else state


class _Part:
    def __init__(self, owner: EventLog):
        self._log = owner

    @property
    def _state(self) -> State:
        return self._log.state

    def _page(self, df: DataFrame, limit: int, offset: int) -> DataFrame:
        return df.orderBy("id").offset(offset).limit(limit)


class Namespaces(_Part):
    def create(self, path: str) -> int:
        state, new = catalog.create_namespace(self._state, path, self._log.as_of)
        self._log.commit(state)
        return new

    def delete(self, path: str) -> None:
        self._log.commit(catalog.delete_namespace(self._state, path))

    def rename(self, path: str, name: str) -> None:
        self._log.commit(catalog.rename_namespace(self._state, path, name, self._log.as_of))

    def move(self, path: str, parent_path: str | None) -> None:
        self._log.commit(catalog.move_namespace(self._state, path, parent_path, self._log.as_of))

    def find(self, path: str) -> Row | None:
        return single(catalog.find_namespace(self._state, path), path)


class Topics(_Part):
    def create(self, path: str, name: str, partitions: int = 1) -> int:
        state, new = catalog.create_topic(self._state, path, name, partitions, self._log.as_of)
        self._log.commit(state)
        return new

    def find(self, path: str, name: str) -> Row | None:
        return single(catalog.find_topic(self._state, path, name), name)

    def delete(self, path: str, name: str, cascade: bool = False) -> None:
        self._log.commit(catalog.delete_topic(self._state, path, name, cascade))


class Partitions(_Part):
    def find(self, path: str, topic: str, number: int) -> Row | None:
        return single(catalog.find_partition(self._state, path, topic, number), topic)


class Events(_Part):
    def publish(self, path: str, topic: str, key: str, data: bytes | str) -> None:
        raw = data.encode() if isinstance(data, str) else bytes(data)
        self.publish_all(self._log.spark.createDataFrame([(0, path, topic, key, raw)], "pos long, path string, topic string, key string, data binary"), ["pos"])

    def publish_all(self, events: DataFrame, order: list[str]) -> None:
        """events(path, topic, key, data), appended in the given order."""
        self._log.commit(log.publish(self._state, events, order))

    def publish_json(self, batch: str) -> None:
        """A JSON array of objects with path, topic, key and data."""
        rows = self._log.spark.createDataFrame([(batch,)], "batch string")
        self.publish_all(log.batch_events(rows), ["pos"])

    def publish_to(self, partition_id: int, data: bytes | str) -> None:
        raw = data.encode() if isinstance(data, str) else bytes(data)
        self._log.commit(log.publish_to(self._state, self._log.spark.createDataFrame([(0, partition_id, raw)], "pos long, partition_id long, data binary"), ["pos"]))

    def sequence(self, batch_size: int | None = None) -> int:
        state, n = log.sequence(self._state, batch_size)
        self._log.commit(state)
        return n

    def fetch(self, cursor_id: int, limit: int) -> DataFrame:
        return log.fetch(self._state, self._state["cursors"].filter(F.col("id") == cursor_id), limit).orderBy("sequence")


class Subscriptions(_Part):
    def create(self, name: str) -> int:
        state, new = subscriptions.create_subscription(self._state, name, self._log.as_of)
        self._log.commit(state)
        return new

    def delete(self, name: str) -> None:
        self._log.commit(subscriptions.delete_subscription(self._state, name))

    def subscribe(self, name: str, path: str, topic: str) -> int:
        state, new = subscriptions.subscribe(self._state, name, path, topic, self._log.as_of)
        self._log.commit(state)
        return new

    def unsubscribe(self, name: str, path: str, topic: str) -> None:
        self._log.commit(subscriptions.unsubscribe(self._state, name, path, topic))

    def find(self, name: str) -> Row | None:
        return single(subscriptions.find_subscription(self._state, name), name)

    def find_all(self, limit: int, offset: int = 0) -> DataFrame:
        return self._page(self._state["subscriptions"], limit, offset)


class SubscriptionTopics(_Part):
    def find(self, subscription: str, path: str, topic: str) -> Row | None:
        return single(subscriptions.find_link(self._state, subscription, path, topic), topic)

    def find_all(self, limit: int, offset: int = 0) -> DataFrame:
        return self._page(self._state["subscription_topics"], limit, offset)


class Cursors(_Part):
    def commit(self, cursor_id: int, position: int) -> None:
        self._log.commit(subscriptions.commit(self._state, self._log.spark.createDataFrame([(cursor_id, position)], "id long, position long")))

    def find(self, cursor_id: int) -> Row | None:
        return single(self._state["cursors"].filter(F.col("id") == cursor_id), "cursor")

    def find_of(self, subscription_id: int, partition_id: int) -> Row | None:
        return single(self._state["cursors"].filter((F.col("subscription_id") == subscription_id) & (F.col("partition_id") == partition_id)), "cursor")

    def find_all(self, subscription_id: int) -> DataFrame:
        return self._state["cursors"].filter(F.col("subscription_id") == subscription_id).orderBy("id")

    def find_leasable(self, limit: int, offset: int = 0, subscription_id: int | None = None) -> DataFrame:
        rows = leases.unleased_cursors(self._state)
        return self._page(rows if subscription_id is None else rows.filter(F.col("subscription_id") == subscription_id), limit, offset)


class Consumers(_Part):
    def find(self, consumer: str) -> Row | None:
        return single(self._state["consumers"].filter(F.col("id") == consumer), consumer)

    def find_all(self, limit: int, offset: int = 0) -> DataFrame:
        return self._page(self._state["consumers"], limit, offset)

    def check_in(self, consumer: str, subscription: str, weight: float = 1.0) -> CheckIn:
        found = single(subscriptions.find_subscription(self._state, subscription), subscription)
        if found is None:
            raise NotFoundError(f"subscription {subscription!r} does not exist")
        state, status, _ = checkin.check_in(self._state, consumer, found.id, weight, self._log.as_of, self._log.pivot())
        row = status.first()
        self._log.commit(state)
        cursors = leases.leased_cursors(self._state).filter(F.col("consumer_id") == consumer).orderBy("id")
        return CheckIn(row.status, row.heartbeat_interval, row.heartbeat_deadline, cursors)

    def delete(self, consumer: str) -> None:
        self._log.commit(liveness.delete_consumer(self._state, consumer))

    def shutdown(self, consumer: str) -> None:
        self._log.commit(liveness.shut_down_consumer(self._state, consumer))


class ConsumerSubscriptions(_Part):
    def subscribe(self, consumer: str, path: str, topic: str) -> None:
        self._log.commit(subscriptions.consumer_subscribe(self._state, consumer, path, topic))

    def unsubscribe(self, consumer: str, path: str, topic: str) -> None:
        self._log.commit(subscriptions.consumer_unsubscribe(self._state, consumer, path, topic))

    def find_all(self, consumer: str) -> DataFrame:
        return self._state["consumer_subscriptions"].filter(F.col("consumer_id") == consumer).orderBy("subscription_topic_id")


class Leases(_Part):
    def find(self, cursor_id: int) -> Row | None:
        return single(self._state["leases"].filter(F.col("cursor_id") == cursor_id), "lease")

    def release(self, cursor_id: int, consumer: str) -> None:
        self._log.commit(leases.release(self._state, cursor_id, consumer, self._log.as_of))


class Policy(_Part):
    def __init__(self, owner: EventLog, name: str):
        super().__init__(owner)
        self._name = name

    def get(self) -> Row:
        return self._state[self._name].first()

    def update(self, **values) -> None:
        self._log.commit(policies.update_policy(self._state, self._name, **values))
