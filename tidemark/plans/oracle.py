"""DuckDB SQL for the queries: one shared prefix that derives the state from the driver's tables, and a select for each."""

from __future__ import annotations

from ..sources.fixtures import AS_OF, PARTITIONS, SEQUENCED
from .queries import BATCH_SIZE, PIVOT

_NOW = f"timestamp '{AS_OF}'"


def crc32(k: str) -> str:
    """The checksum of a VARCHAR expression, bit by bit over its bytes."""
    return f"""xor(list_reduce(list_prepend(4294967295::ubigint,
      list_transform(range(1, (length(hex(encode({k}))) // 2) + 1), lambda i: ('0x' || substr(hex(encode({k})), (2 * i - 1)::bigint, 2))::ubigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint for _ in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::ubigint))),
    4294967295::ubigint)::bigint"""



_PREFIX = f"""
with recursive namespaces as (
  select (r_regionkey + 1)::bigint as id, null::bigint as parent_id, r_name as name, r_name as path from region
  union all select 100 + n_nationkey, n_regionkey + 1, n_name, r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
  union all select 1000 + s_suppkey, 100 + s_nationkey, s_name, r_name || '/' || n_name || '/' || s_name
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
closures as (
  select id as ancestor_id, id as descendant_id, 0 as depth from namespaces
  union all select n.parent_id, c.descendant_id, c.depth + 1 from closures c join namespaces n on c.ancestor_id = n.id where n.parent_id is not null),
topics as (
  select dense_rank() over (order by event_type)::bigint as id, dense_rank() over (order by event_type)::bigint as namespace_id, event_type as name, {PARTITIONS} as partitions
  from (select distinct event_type from events)),
users as (select u, {crc32("u")} as crc from (select distinct user_id::varchar as u from events)),
routed as (
  select e.event_id + 1 as id, t.id as topic_id, (crc % {PARTITIONS})::int as partition_number, (t.id << 16) + crc % {PARTITIONS} as partition_id, e.event_type, e.user_id, e.props
  from events e join topics t on e.event_type = t.name join users on u = e.user_id::varchar),
numbered as (select *, row_number() over (order by id) as sequence from routed),
split as (select count(*) * {SEQUENCED[0]} // {SEQUENCED[1]} as n from routed),
sequences as (select sequence, partition_id, id as event_id from numbered, split where sequence <= n),
unprocessed as (select id, partition_id from numbered, split where sequence > n),
partitions as (
  select (t.id << 16) + k.n as id, t.id as topic_id, k.n::int as partition_number, coalesce(h.top, 0)::bigint as high_watermark
  from topics t cross join (select range as n from range({PARTITIONS})) k left join (select partition_id, max(sequence) as top from sequences group by 1) h on h.partition_id = (t.id << 16) + k.n),
subscriptions as (select dense_rank() over (order by name)::bigint as id, name from (select distinct c_mktsegment || '-' || c_nationkey as name from customer)),
links as (
  select row_number() over (order by s.id, t.id)::bigint as id, s.id as subscription_id, t.id as topic_id from subscriptions s, topics t where (s.id + t.id) % 2 = 0),
cursors0 as (
  select row_number() over (order by l.id, p.id)::bigint as id, l.subscription_id, l.id as subscription_topic_id, l.topic_id, p.id as partition_id, p.high_watermark as hw
  from links l join partitions p on l.topic_id = p.topic_id),
cursors as (
  select id, subscription_id, subscription_topic_id, topic_id, partition_id, ({crc32("id::varchar")} - 2147483648)::int as random_key,
         least(hw, (hw * (id % 5)) // 4)::bigint as position from cursors0),
consumers as (
  select 'c-' || c_custkey as id, s.id as subscription_id, (1 + c_nationkey % 3)::double as weight, {_NOW} - to_seconds(c_custkey % 20) as heartbeat_detected_at, 3.0::double as heartbeat_interval,
         {_NOW} - to_seconds(c_custkey % 20) + to_seconds(case when c_custkey % 7 = 0 then -1 else 15 end) as heartbeat_deadline
  from customer join subscriptions s on s.name = c_mktsegment || '-' || c_nationkey),
choices as (select c.id as consumer_id, l.id as subscription_topic_id, l.topic_id from consumers c join links l on c.subscription_id = l.subscription_id),
holders as (select id, subscription_id, row_number() over (partition by subscription_id order by id) - 1 as place, count(*) over (partition by subscription_id) as people from consumers),
leases as (
  select c.id as cursor_id, c.subscription_id, c.topic_id, c.partition_id, h.id as consumer_id, 1::bigint as version, {_NOW} - to_seconds(c.id) as acquired_at,
         case when c.id % 6 = 0 then {_NOW} - to_seconds(c.id % 20) end as released_at,
         case when c.id % 6 = 0 then {_NOW} - to_seconds(c.id % 20) + to_seconds(10) end as release_deadline,
         case when c.id % 6 = 0 then 'RELEASING' else 'ACTIVE' end as state
  from cursors c join holders h on c.subscription_id = h.subscription_id and h.place = (c.id * c.id) % h.people where c.id % 3 <> 1),
working as (select c.* from cursors c join partitions p on c.partition_id = p.id where c.position < p.high_watermark),
unleased as (
  select c.* from working c left join leases l on c.id = l.cursor_id left join consumers w on l.consumer_id = w.id
  where l.cursor_id is null or w.heartbeat_detected_at < w.heartbeat_deadline),
expired as (
  select l.* from leases l join consumers w on w.id = l.consumer_id
  where {_NOW} >= w.heartbeat_deadline or (l.state = 'RELEASING' and {_NOW} >= l.release_deadline)),
live as (select * from consumers where {_NOW} < heartbeat_deadline),
live_choices as (select c.* from choices c join live w on w.id = c.consumer_id),
kept as (select * from leases where cursor_id not in (select cursor_id from expired)),
metrics as (
  select l.id, l.subscription_id, l.topic_id, coalesce(p.n, 0)::int as active_consumers, coalesce(p.w, 0)::double as active_consumers_weight, coalesce(a.n, 0)::int as active_partitions,
         least(greatest(3.0::double, coalesce(p.n, 0)::double / 10.0::double), 60.0::double) as heartbeat_interval
  from links l left join (select subscription_topic_id, count(*) as n, sum(weight) as w from choices c join live w on w.id = c.consumer_id group by 1) p on p.subscription_topic_id = l.id
  left join (select subscription_topic_id, count(*) as n from working group by 1) a on a.subscription_topic_id = l.id),
intervals as (
  select w.id, coalesce(max(m.heartbeat_interval), 3.0::double) as heartbeat_interval from consumers w left join choices c on c.consumer_id = w.id
  left join metrics m on m.topic_id = c.topic_id and m.subscription_id = w.subscription_id group by w.id),
deadlines as (
  select id, heartbeat_interval, {_NOW} as heartbeat_detected_at, {_NOW} + to_seconds(greatest(1, ceil(heartbeat_interval * 5.0::double))::bigint) as heartbeat_deadline from intervals),
targets as (
  select w.id as consumer_id, w.subscription_id, coalesce(w.weight / nullif(s.w, 0) * s.p, 0)::double as target, coalesce(s.p, 0)::bigint as active_partitions
  from consumers w left join (select c.consumer_id, m.subscription_id, max(m.active_consumers_weight) as w, sum(m.active_partitions) as p
    from choices c join consumers x on x.id = c.consumer_id join metrics m on m.topic_id = c.topic_id and m.subscription_id = x.subscription_id group by 1, 2) s
  on s.consumer_id = w.id and s.subscription_id = w.subscription_id),
decided as (
  select t.consumer_id, t.subscription_id, coalesce(a.n, 0)::bigint as active, t.target, least(ceil(t.target * 1.1::double), t.active_partitions)::bigint as most
  from targets t join live w on w.id = t.consumer_id left join (select consumer_id, subscription_id, count(*) as n from kept where state = 'ACTIVE' group by 1, 2) a
  on a.consumer_id = t.consumer_id and a.subscription_id = t.subscription_id),
decisions as (
  select consumer_id, subscription_id, active, target, case when active > most then 'release' when active < target then 'acquire' else 'none' end as decision,
         (case when active > most then active - most when active < target then round_even(target - active, 0) else 0 end)::bigint as n from decided),
excess as (
  select cursor_id, consumer_id, subscription_id, row_number() over (partition by consumer_id, subscription_id order by acquired_at desc, cursor_id) as turn
  from (select l.*, row_number() over (partition by l.consumer_id, l.subscription_id order by p.high_watermark - c.position, l.cursor_id) as place,
               count(*) over (partition by l.consumer_id, l.subscription_id) as n
        from leases l join cursors c on c.id = l.cursor_id join partitions p on p.id = l.partition_id where l.state = 'ACTIVE') where place <= ceil(n * 0.5)),
turns as (
  select c.consumer_id, u.*, row_number() over (partition by c.consumer_id order by u.random_key < {PIVOT}, u.random_key, u.id) as turn
  from unleased u join choices c on c.topic_id = u.topic_id join consumers w on w.id = c.consumer_id and w.subscription_id = u.subscription_id),
nation0 as (select * from namespaces where id >= 100 and id < 1000 order by id limit 1),
region0 as (select n.* from namespaces n, nation0 o where n.parent_id is null and n.id <> o.parent_id order by n.id limit 1),
below0 as (select descendant_id as id, depth from closures where ancestor_id = (select id from nation0)),
link0 as (select * from links order by id limit 1)
"""

_LEASES = "cursor_id, subscription_id, topic_id, partition_id, consumer_id, version, acquired_at, released_at, release_deadline, state"
_CURSORS = "id, subscription_id, subscription_topic_id, topic_id, partition_id, random_key, position"
_TAKEN = "(select * from turns where consumer_id = 'c-1' and turn <= 20)"


def _released(chosen: str) -> str:
    return f"""select cursor_id, subscription_id, topic_id, partition_id, consumer_id, version, acquired_at,
  case when cursor_id in ({chosen}) then {_NOW} else released_at end as released_at,
  case when cursor_id in ({chosen}) then {_NOW} + to_seconds(10) else release_deadline end as release_deadline, 'RELEASING' as state
  from leases where state = 'RELEASING' or cursor_id in ({chosen})"""


_SELECTS = {
    "event_routing": "select id, topic_id, partition_number, partition_id from routed",
    "publish_multi_json": "select id // 100 as batch_no, row_number() over (partition by id // 100 order by id) - 1 as pos, event_type as topic, user_id::varchar as key, props as data, partition_id from routed",
    "sequence_batch": f"select sequence, partition_id, id as event_id from numbered, split where sequence > n and sequence <= n + {BATCH_SIZE}",
    "sequence_all": "select sequence, partition_id, id as event_id from numbered, split where sequence > n",
    "unprocessed_remaining": f"select id, partition_id from numbered, split where sequence > n + {BATCH_SIZE}",
    "partition_high_watermark": f"""select p.id, p.topic_id, p.partition_number, greatest(p.high_watermark, coalesce(h.top, 0))::bigint as high_watermark from partitions p
      left join (select partition_id, max(sequence) as top from numbered, split where sequence <= n + {BATCH_SIZE} group by 1) h on h.partition_id = p.id""",
    "fetch_after_position": """select c.id as cursor_id, s.sequence, s.event_id, n.props as data from cursors c join sequences s on s.partition_id = c.partition_id and s.sequence > c.position
      join numbered n on n.id = s.event_id qualify row_number() over (partition by c.id order by s.sequence) <= 10""",
    "consumer_lag": "select l.cursor_id, l.consumer_id, p.high_watermark - c.position as lag from leases l join cursors c on c.id = l.cursor_id join partitions p on p.id = l.partition_id",
    "stream_sequence_watermark": "select partition_id, max(sequence) as last_sequence from numbered group by 1",
    "stream_refused": "select 'unknown' as topic, 1::bigint as n",
    "stream_fetch": """select c.id as cursor_id, count(*) as n, min(s.sequence) as first_sequence, max(s.sequence) as last_sequence, sum(octet_length(encode(s.props)))::bigint as bytes
      from cursors c join numbered s on s.partition_id = c.partition_id and s.sequence > c.position group by 1""",
    "publish_to_partition": """select id, partition_id from unprocessed
      union all select (select max(id) from routed) + row_number() over (order by id), partition_id from routed""",
    "publish_then_sequence": f"""select 'events' as table_name, 2 * count(*) as n, max(id) + count(*) as last_id from routed
      union all select 'unprocessed_events', (select count(*) from unprocessed) + count(*) - {BATCH_SIZE}, max(id) + count(*) from routed
      union all select 'sequences', n + {BATCH_SIZE}, n + {BATCH_SIZE} from split""",
    "unleased_cursors": f"select {_CURSORS} from unleased",
    "unleased_cursors_documented": f"""select c.* from working c left join leases l on c.id = l.cursor_id left join consumers w on l.consumer_id = w.id
      where l.cursor_id is null or {_NOW} >= w.heartbeat_deadline""",
    "leased_cursors": """select c.*, w.id as consumer_id, l.cursor_id as lease_id, l.acquired_at from consumers w join leases l on w.id = l.consumer_id join cursors c on l.cursor_id = c.id
      where w.heartbeat_detected_at < w.heartbeat_deadline and l.state = 'ACTIVE'""",
    "cursor_commit": "select id, case when id % 2 = 0 then position + id else position end as position from cursors",
    "acquire_candidates": "select consumer_id, id as cursor_id, turn from turns where turn <= 3",
    "acquire_upsert_result": f"""select {_LEASES} from leases where cursor_id not in (select id from {_TAKEN})
      union all select t.id, t.subscription_id, t.topic_id, t.partition_id, t.consumer_id, coalesce(l.version, 0) + 1, coalesce(l.acquired_at, {_NOW}), null, l.release_deadline, 'ACTIVE'
      from {_TAKEN} t left join leases l on l.cursor_id = t.id""",
    "release_excess_candidates": "select cursor_id, consumer_id from excess where turn <= 2",
    "lease_release_excess": _released("select cursor_id from excess where consumer_id = 'c-1' and turn <= 2"),
    "lease_release": _released("select min(cursor_id) from leases where state = 'ACTIVE'"),
    "subscription_topic_metrics": "select id, subscription_id, active_consumers, active_consumers_weight, active_partitions, heartbeat_interval from metrics",
    "lease_counts_by_consumer": "select consumer_id, subscription_id, count(*) as active from leases where state = 'ACTIVE' group by 1, 2",
    "gc_leases": "select cursor_id, consumer_id, state from expired",
    "gc_consumers": "select id, subscription_id, weight from live",
    "gc_remaining_leases": "select cursor_id, consumer_id, state from kept",
    "heartbeat_admission": """select id, subscription_id, weight, true as known, 'ACCEPTED' as status from consumers
      union all select 'new-' || s.id, s.id, 1.0::double, false, case when coalesce(b.n, 0) < 5 then 'ACCEPTED' else 'REJECTED' end from subscriptions s
      left join (select subscription_id, max(active_consumers) as n from metrics group by 1) b on b.subscription_id = s.id""",
    "consumer_heartbeat_deadline": "select id, heartbeat_interval, heartbeat_detected_at, heartbeat_deadline from deadlines",
    "consumer_lease_target": "select consumer_id, subscription_id, target, active_partitions from targets",
    "rebalance_decision": "select consumer_id, subscription_id, active, target, decision, n from decisions",
    "rebalance_leases": f"""with free as (select c.* from working c left join kept l on c.id = l.cursor_id left join live w on l.consumer_id = w.id
        where l.cursor_id is null or w.heartbeat_detected_at < w.heartbeat_deadline),
      wish as (select * from (select c.consumer_id, f.*, d.n, row_number() over (partition by c.consumer_id order by f.random_key < {PIVOT}, f.random_key, f.id) as turn
        from free f join live_choices c on c.topic_id = f.topic_id join decisions d on d.consumer_id = c.consumer_id and d.subscription_id = f.subscription_id where d.decision = 'acquire') where turn <= n),
      takes as (select id, min(consumer_id) as consumer_id from wish group by 1),
      half as (select l.*, row_number() over (partition by l.consumer_id, l.subscription_id order by p.high_watermark - c.position, l.cursor_id) as place, count(*) over (partition by l.consumer_id, l.subscription_id) as held
        from kept l join cursors c on c.id = l.cursor_id join partitions p on p.id = l.partition_id where l.state = 'ACTIVE'),
      gone as (select h.cursor_id from (select *, row_number() over (partition by consumer_id, subscription_id order by acquired_at desc, cursor_id) as turn from half where place <= ceil(held * 0.5)) h
        join decisions d on d.consumer_id = h.consumer_id and d.subscription_id = h.subscription_id where d.decision = 'release' and h.turn <= d.n),
      after as (select cursor_id, consumer_id, version, state from kept where cursor_id not in (select id from takes)
        union all select t.id, t.consumer_id, coalesce(k.version, 0) + 1, 'ACTIVE' from takes t left join kept k on k.cursor_id = t.id)
      select cursor_id, consumer_id, version, case when cursor_id in (select cursor_id from gone) then 'RELEASING' else state end as state from after""",
    "check_in_all": """select d.consumer_id, 'ACCEPTED' as status, t.heartbeat_interval, t.heartbeat_deadline, d.decision, d.n from decisions d join deadlines t on t.id = d.consumer_id""",
    "check_in_one": f"""with me as (select subscription_id from consumers where id = 'c-1'),
      weighed as (select c.subscription_topic_id, sum(case when w.id = 'c-1' then 1.0 else w.weight end) as w from choices c join live w on w.id = c.consumer_id group by 1),
      share as (select coalesce(1.0 / nullif(max(coalesce(g.w, 0)), 0) * sum(m.active_partitions), 0)::double as target, coalesce(sum(m.active_partitions), 0) as p
        from choices c join metrics m on m.id = c.subscription_topic_id left join weighed g on g.subscription_topic_id = m.id where c.consumer_id = 'c-1'),
      held as (select count(*) as n from kept where consumer_id = 'c-1' and state = 'ACTIVE'),
      plan as (select case when h.n > least(ceil(s.target * 1.1::double), s.p) then h.n - least(ceil(s.target * 1.1::double), s.p) else 0 end as gone,
                      case when h.n > least(ceil(s.target * 1.1::double), s.p) then 0 when h.n < s.target then round_even(s.target - h.n, 0) else 0 end as wanted from share s, held h),
      free as (select c.* from working c left join kept l on c.id = l.cursor_id left join live w on l.consumer_id = w.id
        where c.subscription_id = (select subscription_id from me) and (l.cursor_id is null or w.heartbeat_detected_at < w.heartbeat_deadline)),
      taken as (select id from (select f.id, row_number() over (order by f.random_key < {PIVOT}, f.random_key, f.id) as turn from free f join choices c on c.consumer_id = 'c-1' and c.topic_id = f.topic_id), plan where turn <= wanted),
      half as (select l.cursor_id, l.acquired_at, row_number() over (order by p.high_watermark - c.position, l.cursor_id) as place, count(*) over () as n
        from kept l join cursors c on c.id = l.cursor_id join partitions p on p.id = l.partition_id where l.state = 'ACTIVE' and l.consumer_id = 'c-1'),
      dropped as (select cursor_id from (select *, row_number() over (order by acquired_at desc, cursor_id) as turn from half where place <= ceil(n * 0.5)), plan where turn <= gone)
      select id, 'c-1' as consumer_id, id as lease_id from (
        select cursor_id as id from kept where consumer_id = 'c-1' and state = 'ACTIVE' and cursor_id not in (select cursor_id from dropped) union select id from taken)""",
    "namespace_closure": "select ancestor_id, descendant_id, depth from closures",
    "namespace_descendants": "select ancestor_id as root_id, descendant_id as id, depth from closures where ancestor_id in (select id from namespaces where parent_id is null)",
    "namespace_ancestors": "select descendant_id as id, ancestor_id, depth from closures",
    "namespace_rename": """select n.id, n.parent_id, case when n.id = o.id then 'renamed' else n.name end as name, p.path, upper(md5(p.path)) as path_hash from namespaces n cross join nation0 o
      cross join lateral (select case when n.id in (select id from below0) then (select path from namespaces where id = o.parent_id) || '/renamed' || substr(n.path, length(o.path) + 1) else n.path end as path) p""",
    "namespace_move_paths": """select n.id, case when n.id = o.id then r.id else n.parent_id end as parent_id, n.name,
      case when n.id in (select id from below0) then r.path || '/' || o.name || substr(n.path, length(o.path) + 1) else n.path end as path from namespaces n, nation0 o, region0 r""",
    "namespace_move_closures": """select ancestor_id, descendant_id, depth from closures where descendant_id not in (select id from below0) or ancestor_id in (select id from below0)
      union all select a.ancestor_id, b.id, a.depth + b.depth + 1 from closures a, below0 b where a.descendant_id = (select id from region0)""",
    "namespace_delete_survivors": "select id, path from namespaces where id not in (select id from below0)",
    "namespace_create": """select ancestor_id, descendant_id, depth from closures union all select m.id, m.id, 0 from (select max(id) + 1 as id from namespaces) m
      union all select c.ancestor_id, m.id, c.depth + 1 from closures c, (select max(id) + 1 as id from namespaces) m where c.descendant_id = (select id from nation0)""",
    "namespace_create_as_given": """select id, name, path, upper(md5(path)) as path_hash from namespaces
      union all select max(id) + 1, ' added ', ' added ', upper(md5(' added ')) from namespaces""",
    "constraint_outcomes": """select * from (values ('namespace_again', 'ConstraintError'), ('namespace_below_nothing', 'NotFoundError'), ('namespace_blank', 'LogError'),
      ('namespace_with_topic_deleted', 'ConstraintError'), ('topic_again', 'ConstraintError'), ('topic_with_partitions_deleted', 'ConstraintError'), ('subscription_again', 'ConstraintError'),
      ('subscription_with_consumers_deleted', 'ConstraintError'), ('consumer_of_nothing', 'ConstraintError'), ('lease_in_no_state', 'ConstraintError'), ('namespace_moved_below_itself', 'LogError'),
      ('namespace_added', 'done')) t(attempt, outcome)""",
    "namespace_lookup": "select id, path, upper(md5(path)) as path_hash from namespaces",
    "path_parse": "select path, split_part(path, '/', -1) as name, case when contains(path, '/') then left(path, length(path) - length(split_part(path, '/', -1)) - 1) end as parent from namespaces",
    "topic_partitions_generate": "select id, topic_id, partition_number, 0::bigint as high_watermark from partitions",
    "topic_create": """select id, topic_id, partition_number from partitions union all select (m.id << 16) + n, m.id, n::int from (select max(id) + 1 as id from topics) m, (select range as n from range(3))""",
    "topic_delete": "select id, topic_id from cursors where topic_id <> (select min(id) from topics)",
    "topic_lookup": "select n.path, t.name as topic, t.id as topic_id, t.partitions from topics t join namespaces n on n.id = t.namespace_id",
    "partition_lookup": """select n.path, t.name as topic, p.partition_number, p.id, p.high_watermark from partitions p join topics t on t.id = p.topic_id join namespaces n on n.id = t.namespace_id""",
    "subscribe_cursors": f"select {_CURSORS.replace('position', '0::bigint as position')} from cursors",
    "unsubscribe_cascade": """select 'subscription_topics' as table_name, count(*) as left_rows from links where id <> (select id from link0)
      union all select 'cursors', count(*) from cursors where subscription_topic_id <> (select id from link0)
      union all select 'leases', count(*) from leases where cursor_id in (select id from cursors where subscription_topic_id <> (select id from link0))
      union all select 'consumer_subscriptions', count(*) from choices where subscription_topic_id <> (select id from link0)""",
    "subscription_topic_lookup": "select l.id, s.name as subscription, t.name as topic, 15.0::double as heartbeat_interval from links l join subscriptions s on s.id = l.subscription_id join topics t on t.id = l.topic_id",
    "consumer_topic_subscribe": "select consumer_id, subscription_topic_id, topic_id from choices",
    "consumer_topic_unsubscribe": "select consumer_id, subscription_topic_id, topic_id from choices where not (consumer_id = 'c-1' and topic_id = (select topic_id from link0))",
    "subscription_create": "select id, name from subscriptions union all select max(id) + 1, 'added' from subscriptions",
    "subscription_delete_cascade": """select 'subscriptions' as table_name, count(*) as left_rows from subscriptions where id <> 1
      union all select 'subscription_topics', count(*) from links where subscription_id <> 1
      union all select 'cursors', count(*) from cursors where subscription_id <> 1
      union all select 'leases', count(*) from leases where subscription_id <> 1""",
    "consumer_shutdown": """select 'consumers' as table_name, count(*) as left_rows from consumers where id <> 'c-1'
      union all select 'consumer_subscriptions', count(*) from choices where consumer_id <> 'c-1'
      union all select 'leases', count(*) from leases where consumer_id <> 'c-1'""",
    "consumer_delete_cascade": "select cursor_id, consumer_id from leases where consumer_id <> 'c-1'",
    "subscriptions_page": "select id, name from subscriptions order by id limit 3 offset 1",
    "consumers_page": "select id, subscription_id, weight from consumers order by id limit 10 offset 10",
    "leasable_page": "select id, subscription_id, partition_id, position from unleased order by id limit 20 offset 5",
    "policy_update": """select 1::int as id, 4.0::double as deadline_multiplier, 2.0::double as interval_baseline, 30.0::double as interval_limit, 5.0::double as target_qps,
      8::int as active_consumers_limit, 20::int as lease_release_period, 7::int as metrics_refresh_interval""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _PREFIX + (", " + select[5:] if select.startswith("with ") else select) for name, select in _SELECTS.items()}
