"""Helpers that the training-data operators share: table reading, text passes, materialised intermediates."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D, nothing else.
WORD_BREAKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a lookup table may have to be broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files and splits than there are cores, dealt to all of them by rows: so at most one split for each core
    is shuffled. Other scans are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores:
        return df.repartition(cores)
    return df


def small(rows: DataFrame) -> DataFrame:
    """rows, of a few columns of fixed width, broadcast if they are few by count."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone, and its scratch folder with it
        pass


#: The DataFrames that materialize() gave and where they lie, by identity.
_folders: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and survives the loss of executors.

    The files are removed by release(), or when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    atexit.register(_delete, spark, path)
    _folders[id(found)] = found, path
    return found


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that materialize() gave and that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, _folders.pop(id(df))[1])


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], prepare: Callable[[], object] | None = None
) -> DataFrame:
    """mapInArrow over tuples of df's columns; rows turns an iterator of tuples into one of output tuples.

    prepare, if given, is called once a task and its result handed to rows as a second argument.
    """
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        state = (prepare(),) if prepare else ()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = list(rows(zip(*(c.to_pylist() for c in part.columns)), *state))
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_schema.types)], schema=out_schema)
        pa.default_memory_pool().release_unused()  # a worker lives on, for other operators' tasks too

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str, group: Callable[[tuple, pa.Table], list | None]) -> DataFrame:
    """Groups of df by integer keys, dealt by hash and sorted, streamed through Python: group(key, table) gives output columns.

    For many small groups: they share Arrow batches, and nothing is built for each group but a slice.
    """
    spark = df.sparkSession
    out_schema = _arrow_schema(spark, schema)
    places = [df.columns.index(k) for k in keys]

    def run(batches):
        held: list[pa.RecordBatch] = []
        found: list[list] = []
        size, last = 0, None

        def close():
            nonlocal held, size
            result = group(last, pa.Table.from_batches(held))
            held = []
            if result is not None and len(result[0]):
                found.append(result)
                size += len(result[0])

        def flush():
            nonlocal found, size
            parts = [pa.concat_arrays([pa.array(f[k], t) for f in found]) for k, t in enumerate(out_schema.types)]
            found, size = [], 0
            return pa.RecordBatch.from_arrays(parts, schema=out_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([batch.column(p).to_numpy(zero_copy_only=False) for p in places])
            starts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                key = tuple(columns[:, a].tolist())
                if held and key != last:
                    close()
                    if size >= 20_000:
                        yield flush()
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            close()
        if found:
            yield flush()
        pa.default_memory_pool().release_unused()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
