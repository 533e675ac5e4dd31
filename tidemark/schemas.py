"""Tables of the event log: types, keys, generated columns, defaults and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_L, _I, _D, _S, _B, _TS = "bigint", "int", "double", "string", "binary", "timestamp_ntz"


@dataclass(frozen=True)
class Reference:
    """column points at table.id; a deletion there cascades, or is refused while rows point at it."""

    column: str
    table: str
    cascade: bool


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    nullable: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    lengths: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    counted: bool = False  # ids are given out by the table
    touched: bool = False  # last_modified_at follows changes

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in self.columns))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]


# Names, types, keys, limits and defaults of the data model.
_STAMPS = (("created_at", _TS), ("last_modified_at", _TS))
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("namespaces", (("id", _L), ("parent_id", _L), ("name", _S), ("path", _S), ("path_hash", _B), *_STAMPS), ("id",),
              unique=(("parent_id", "name"),), references=(Reference("parent_id", "namespaces", True),), nullable=("parent_id",), lengths={"name": 500, "path": 4000}, counted=True, touched=True),
        Table("namespace_closures", (("ancestor_id", _L), ("descendant_id", _L), ("depth", _I)), ("ancestor_id", "descendant_id"),
              references=(Reference("ancestor_id", "namespaces", True), Reference("descendant_id", "namespaces", True))),
        Table("topics", (("id", _L), ("namespace_id", _L), ("name", _S), ("partitions", _I), *_STAMPS), ("id",),
              unique=(("namespace_id", "name"),), references=(Reference("namespace_id", "namespaces", False),), defaults={"partitions": 1}, lengths={"name": 500}, counted=True, touched=True),
        Table("partitions", (("id", _L), ("topic_id", _L), ("partition_number", _I), ("high_watermark", _L)), ("id",),
              unique=(("topic_id", "partition_number"),), references=(Reference("topic_id", "topics", False),), defaults={"high_watermark": 0}),
        Table("heartbeat_policies", (("id", _I), ("deadline_multiplier", _D), ("interval_baseline", _D), ("interval_limit", _D), ("target_qps", _D)), ("id",),
              defaults={"id": 1, "deadline_multiplier": 5.0, "interval_baseline": 3.0, "interval_limit": 60.0, "target_qps": 10.0}),
        Table("lease_policies", (("id", _I), ("active_consumers_limit", _I), ("lease_release_period", _I)), ("id",),
              defaults={"id": 1, "active_consumers_limit": 16, "lease_release_period": 10}),
        Table("metrics_policies", (("id", _I), ("metrics_refresh_interval", _I)), ("id",), defaults={"id": 1, "metrics_refresh_interval": 3}),
        Table("subscriptions", (("id", _L), ("name", _S), ("last_modified_at", _TS)), ("id",), unique=(("name",),), lengths={"name": 500}, counted=True, touched=True),
        Table("subscription_topics", (("id", _L), ("subscription_id", _L), ("topic_id", _L), ("heartbeat_interval", _D), ("active_partitions", _I), ("active_consumers", _I), ("active_consumers_weight", _D), *_STAMPS), ("id",),
              unique=(("subscription_id", "topic_id"),), references=(Reference("subscription_id", "subscriptions", True), Reference("topic_id", "topics", True)),
              defaults={"heartbeat_interval": 15.0, "active_partitions": 0, "active_consumers": 0, "active_consumers_weight": 0.0}, counted=True, touched=True),
        Table("cursors", (("id", _L), ("subscription_id", _L), ("subscription_topic_id", _L), ("topic_id", _L), ("partition_id", _L), ("random_key", _I), ("position", _L)), ("id",),
              unique=(("subscription_topic_id", "partition_id"),),
              references=(Reference("subscription_id", "subscriptions", True), Reference("subscription_topic_id", "subscription_topics", True), Reference("topic_id", "topics", True), Reference("partition_id", "partitions", True)),
              defaults={"position": 0}, counted=True),
        Table("consumers", (("id", _S), ("subscription_id", _L), ("weight", _D), ("heartbeat_detected_at", _TS), ("heartbeat_interval", _D), ("heartbeat_deadline", _TS)), ("id",),
              references=(Reference("subscription_id", "subscriptions", False),), defaults={"weight": 1.0}, lengths={"id": 36}),
        Table("consumer_subscriptions", (("consumer_id", _S), ("subscription_topic_id", _L), ("topic_id", _L)), ("consumer_id", "subscription_topic_id"),
              references=(Reference("consumer_id", "consumers", True), Reference("subscription_topic_id", "subscription_topics", True), Reference("topic_id", "topics", True))),
        Table("leases", (("cursor_id", _L), ("subscription_id", _L), ("topic_id", _L), ("partition_id", _L), ("consumer_id", _S), ("version", _L), ("acquired_at", _TS), ("released_at", _TS), ("release_deadline", _TS), ("state", _S)), ("cursor_id",),
              references=(Reference("cursor_id", "cursors", True), Reference("subscription_id", "subscriptions", True), Reference("topic_id", "topics", True), Reference("partition_id", "partitions", True), Reference("consumer_id", "consumers", True)),
              nullable=("released_at", "release_deadline"), defaults={"version": 1, "state": "ACTIVE"}, domains={"state": ("ACTIVE", "RELEASING")}),
        Table("unprocessed_events", (("id", _L), ("partition_id", _L)), ("id",)),
        Table("sequences", (("sequence", _L), ("partition_id", _L), ("event_id", _L)), ("sequence", "partition_id", "event_id"), counted=True),
        Table("events", (("id", _L), ("data", _B)), ("id",), counted=True),
    )
}
POLICIES = ("heartbeat_policies", "lease_policies", "metrics_policies")
