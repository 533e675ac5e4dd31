"""Streaming ingest: micro-batches of events are routed, numbered and appended to the log; watermarks and readers follow.

A batch is written under its own id before the pointer that makes it part of the log, and a batch whose pointer exists is left
out: so a batch that runs again after a failure is sequenced once. Events that no topic takes (unknown topic, null key) are
refused by a publisher; in a stream, where there is nobody to refuse them to, they are set aside with their batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbered_in_bulk
from ..operators.log import delivered, routed

SEQUENCES = "sequence long, partition_id long, event_id long"


class Sequencer:
    """Appends sequenced events to root/sequences/batch=N; the next sequence follows from the batch before."""

    def __init__(self, spark: SparkSession, root: str, topics: DataFrame):
        self.spark, self.root, self.topics = spark, root.rstrip("/"), topics
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self) -> tuple[int, int]:
        """The last batch and the last sequence, from the name of its pointer; (-1, 0) at the start."""
        folder = self._path(f"{self.root}/done")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((tuple(map(int, n.split("-"))) for n in names), default=(-1, 0))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self._done()
        if batch_id <= before[0]:
            return
        rows = routed(batch, self.topics)
        refused = rows.filter("partition_id is null").select(*batch.columns)
        rows = numbered_in_bulk(rows.filter("partition_id is not null").select("id", "partition_id"), "id", before[1] + 1, "sequence")
        rows = rows.select("sequence", "partition_id", F.col("id").alias("event_id"))
        path = f"{self.root}/sequences/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        last = self.spark.read.schema(SEQUENCES).parquet(path).agg(F.max("sequence")).first()[0] or before[1]
        if not refused.isEmpty():
            refused.write.mode("overwrite").parquet(f"{self.root}/refused/batch={batch_id}")
        self._fs.create(self._path(f"{self.root}/done/{batch_id}-{last}"), True).close()
        # The pointer before stays until there is a later one; what lies before it says nothing new.
        if before[0] >= 0:
            self._fs.delete(self._path(f"{self.root}/done/{before[0]}-{before[1]}"), False)

    def sequences(self) -> DataFrame:
        return self.spark.read.schema(SEQUENCES + ", batch long").parquet(f"{self.root}/sequences").select("sequence", "partition_id", "event_id")

    def refused(self, schema: str) -> DataFrame:
        """The events that were set aside."""
        path = f"{self.root}/refused"
        if not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch long").parquet(path).drop("batch")


def sequence_stream(events: DataFrame, sequencer: Sequencer, checkpoint: str):
    """Start sequencing a stream of events(id, path, topic, key); what is there now is worked off and the query ends."""
    return events.writeStream.foreachBatch(sequencer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sequences(spark: SparkSession, root: str) -> DataFrame:
    """The log as a stream of its sequences."""
    return spark.readStream.schema(SEQUENCES + ", batch long").parquet(f"{root}/sequences").select("sequence", "partition_id", "event_id")


def _batches(path: str):
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def watermark_stream(sequences: DataFrame, path: str, checkpoint: str):
    """Start keeping each partition's high-watermark over a stream of sequences. Each batch writes the marks that it has raised."""
    tops = sequences.groupBy("partition_id").agg(F.max("sequence").alias("high_watermark"))
    return tops.writeStream.outputMode("update").foreachBatch(_batches(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("partition_id long, high_watermark long, batch long").parquet(path)
    return rows.groupBy("partition_id").agg(F.max("high_watermark").alias("high_watermark"))


def fetch_stream(sequences: DataFrame, cursors: DataFrame, events: DataFrame, path: str, checkpoint: str):
    """Start following a stream of sequences for cursors(id, partition_id, position): what comes after a cursor's position is
    written with its payload, as (cursor_id, sequence, event_id, data)."""
    rows = delivered(sequences, cursors, events)
    return rows.writeStream.foreachBatch(_batches(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
