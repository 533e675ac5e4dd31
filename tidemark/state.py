"""The state of an event log: an immutable set of DataFrames. Calls return a new state; nothing is changed in place.

A table that lies in folders is known by them. Appending to it adds a folder, and a queue that is worked off from its start
gets a floor below which its rows are gone: neither writes again what was there before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import POLICIES, TABLES

#: Folders of a table from which on they are made one again.
MOST_PARTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone
        pass


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files are removed when the interpreter ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and it survives the loss of executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def typed(name: str, df: DataFrame) -> DataFrame:
    """df with the table's columns in order and cast to their types."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in TABLES[name].columns))


@dataclass(frozen=True)
class State:
    spark: SparkSession
    tables: dict[str, DataFrame]
    #: For tables that give out ids, the next one; where it is missing, it follows the largest id.
    next_ids: dict[str, int]
    #: Of tables that lie in folders: these, the rows that were appended since, and the id up to which rows are gone.
    parts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)
    floors: dict[str, int] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def having(self, **tables: DataFrame) -> State:
        """With some tables replaced; their columns are put in order and cast to their types."""
        kept = lambda d: {n: x for n, x in d.items() if n not in tables}
        new = {n: typed(n, df) for n, df in tables.items()}
        return replace(self, tables=self.tables | new, parts=kept(self.parts), added=kept(self.added), floors=kept(self.floors))

    def appending(self, **rows: DataFrame) -> State:
        """With rows added to some tables."""
        new = {n: typed(n, df) for n, df in rows.items()}
        more = {n: self.added[n].unionByName(df) if n in self.added else df for n, df in new.items()}
        return replace(self, tables=self.tables | {n: self.tables[n].unionByName(df) for n, df in new.items()}, added=self.added | more)

    def past(self, name: str, floor: int) -> State:
        """Without the rows of a table up to an id."""
        return replace(self, tables=self.tables | {name: self.tables[name].filter(F.col("id") > floor)}, floors=self.floors | {name: floor})

    def counting(self, **ids: int) -> State:
        return replace(self, next_ids=self.next_ids | ids)

    def read(self, name: str, paths: Iterable[str]) -> DataFrame:
        rows = self.spark.read.schema(TABLES[name].schema).parquet(*paths)
        return rows.filter(F.col("id") > self.floors[name]) if name in self.floors else rows

    def settled(self, folder: Callable[[str], str], names: Iterable[str]) -> State:
        """With tables lying in folders: of those that do already, only what was appended is written."""
        tables, parts, floors = dict(self.tables), dict(self.parts), dict(self.floors)
        for n in names:
            known = parts.get(n, ())
            if not known or len(known) > MOST_PARTS:
                rows, known = self.tables[n], ()
                floors.pop(n, None)
            else:
                rows = self.added.get(n)
            if rows is not None:
                path = folder(n)
                rows.write.parquet(path)
                known = (*known, path)
            parts[n] = known
        done = replace(self, parts=parts, added={n: df for n, df in self.added.items() if n not in parts}, floors=floors)
        return replace(done, tables=tables | {n: done.read(n, parts[n]) for n in names})

    def checkpointed(self, *names: str) -> State:
        """With tables (all by default) written, so that plans don't grow from call to call."""
        return self.settled(lambda n: fresh_folder(self.spark, n), names or tuple(self.tables))

    def next_id(self, name: str) -> int:
        """The id that the table's next row gets. Ids of deleted rows aren't given out again within this state's history."""
        if name in self.next_ids:
            return self.next_ids[name]
        column = TABLES[name].key[0]
        return (self.tables[name].agg(F.max(column)).first()[0] or 0) + 1


def bootstrap(spark: SparkSession) -> State:
    """Empty tables, and policies of one row with their defaults."""
    tables = {n: spark.createDataFrame([], t.schema) for n, t in TABLES.items()}
    for n in POLICIES:
        tables[n] = spark.createDataFrame([tuple(TABLES[n].defaults[c] for c in TABLES[n].names)], TABLES[n].schema)
    return State(spark, tables, {})
