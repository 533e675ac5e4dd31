"""The sequencer as foreachBatch calls it: batches that run again, events without a topic, and how little it keeps."""

import os

import pytest

from tidemark.operators.log import fetch
from tidemark.state import bootstrap
from tidemark.streaming.sequencer import Sequencer, fetch_stream, read_sequences


def topics(spark):
    return spark.createDataFrame([("log", "t", 1, 4)], "path string, topic string, topic_id long, partitions int")


def events(spark, first, n, topic="t", key="k"):
    return spark.createDataFrame([(i, "log", topic, key, f"data {i}") for i in range(first, first + n)], "id long, path string, topic string, key string, data string")


def test_a_batch_that_runs_again_is_sequenced_once(spark, tmp_path):
    s = Sequencer(spark, f"file://{tmp_path}", topics(spark))
    s(events(spark, 1, 10), 0)
    s(events(spark, 11, 5), 1)
    s(events(spark, 11, 5), 1)  # again, after its pointer
    s(events(spark, 1, 10), 0)
    # Written, but the writer was lost before the pointer: the batch is written anew.
    events(spark, 99, 3).selectExpr("1L as sequence", "1L as partition_id", "id as event_id").write.parquet(f"{tmp_path}/sequences/batch=2")
    s(events(spark, 16, 2), 2)
    rows = sorted((r.sequence, r.event_id) for r in s.sequences().collect())
    assert rows == [(i, i) for i in range(1, 18)]
    assert len([f for f in os.listdir(tmp_path / "done") if not f.startswith(".")]) <= 2


def test_events_without_a_topic_are_set_aside(spark, tmp_path):
    s = Sequencer(spark, f"file://{tmp_path}", topics(spark))
    schema = "id long, path string, topic string, key string, data string"
    assert s.refused(schema).isEmpty()
    s(events(spark, 1, 3).unionByName(events(spark, 4, 1, topic="none")).unionByName(events(spark, 5, 1, key=None)), 0)
    s(events(spark, 6, 0), 1)  # a batch without events
    s(events(spark, 6, 1), 2)
    assert sorted(r.event_id for r in s.sequences().collect()) == [1, 2, 3, 6]
    assert sorted(r.id for r in s.refused(schema).collect()) == [4, 5]


def test_readers_follow_the_stream(spark, tmp_path):
    s = Sequencer(spark, f"file://{tmp_path}", topics(spark))
    log = events(spark, 1, 6).unionByName(events(spark, 7, 6))
    s(events(spark, 1, 6), 0)
    partition = s.sequences().first().partition_id
    cursors = spark.createDataFrame([(1, partition, 4), (2, partition, 0), (3, partition + 1, 0)], "id long, partition_id long, position long")
    payload = log.selectExpr("id", "cast(data as binary) as data")
    follow = lambda: fetch_stream(read_sequences(spark, f"file://{tmp_path}"), cursors, payload, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    read = lambda: sorted((r.cursor_id, r.sequence, bytes(r.data)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    follow()
    assert read() == sorted([(1, i, f"data {i}".encode()) for i in (5, 6)] + [(2, i, f"data {i}".encode()) for i in range(1, 7)])
    s(events(spark, 7, 6), 1)
    follow()
    assert len(read()) == 8 + 12


def shuffled(spark, f) -> int:
    """The rows that are dealt over in what f runs."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, threshold = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # every side is dealt over, as large ones are
    try:
        f()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return total() - before


def test_an_event_meets_its_payload_once_for_all_readers(spark, tmp_path):
    n, readers = 2000, 40
    log = spark.range(1, n + 1).selectExpr("id", "id % 2 as partition_id")
    log.selectExpr("id as sequence", "partition_id", "id as event_id").write.parquet(f"{tmp_path}/sequences/batch=0")
    spark.range(readers).selectExpr("id", "0L as partition_id", "id * 10 as position").write.parquet(f"{tmp_path}/cursors")  # nobody reads partition 1
    log.selectExpr("id", "cast(concat('data ', id) as binary) as data").write.parquet(f"{tmp_path}/events")
    cursors, payload = spark.read.parquet(f"{tmp_path}/cursors"), spark.read.parquet(f"{tmp_path}/events")
    rows = shuffled(spark, lambda: fetch_stream(read_sequences(spark, f"file://{tmp_path}"), cursors, payload, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination())
    found = sorted((r.cursor_id, r.sequence, r.event_id, bytes(r.data)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(c, i, i, f"data {i}".encode()) for c in range(readers) for i in range(c * 10 + 1, n + 1) if i % 2 == 0]
    assert len(found) > 30_000 and rows < 5 * n


@pytest.mark.parametrize("most", [None, 3])
def test_a_fetch_for_many_cursors_deals_each_event_once(spark, tmp_path, most):
    n, readers = 2000, 40
    log = spark.range(1, n + 1).selectExpr("id", "id % 2 as partition_id")
    log.selectExpr("id as sequence", "partition_id", "id as event_id").write.parquet(f"{tmp_path}/sequences")
    log.selectExpr("id", "cast(concat('data ', id) as binary) as data").write.parquet(f"{tmp_path}/events")
    # Two cursors at each position, with no event, one or five between positions, and two near the end.
    at = {c: [0, 1, 2, 3, 13, n - 3, n][c // 2 % 7] for c in range(readers)}
    spark.createDataFrame(list(at.items()), "id long, position long").selectExpr("id", "0L as partition_id", "position").write.parquet(f"{tmp_path}/cursors")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    state = bootstrap(spark).having(sequences=read("sequences"), events=read("events"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "-1")  # all that is ranked is dealt
    try:
        rows = shuffled(spark, lambda: fetch(state, read("cursors"), most).write.parquet(f"{tmp_path}/out"))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    found = sorted((r.cursor_id, r.sequence, r.event_id, bytes(r.data)) for r in read("out").collect())
    assert found == [(c, i, i, f"data {i}".encode()) for c in at for i in [i for i in range(at[c] + 1, n + 1) if i % 2 == 0][:most]]
    assert rows < 5 * n
