"""Versions of a state: one small pointer file each, which lists the folders of its tables.

A version shares the folders of the one it was made from and adds what is new, so publishing events writes these events and not
the log. A version's pointer is created only if it doesn't exist, so of two writers that start from one version the second is
refused and nothing of the current version changes.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import SparkSession

from ..errors import ConflictError, NotFoundError
from ..schemas import TABLES
from ..state import State


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        pointers = self._path(f"{self.root}/versions")
        if not self._fs.exists(pointers):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(pointers) if f.getPath().getName().isdigit())

    def load(self, version: int | None = None) -> tuple[State, int]:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise NotFoundError(f"no version {version if version is not None else ''} in {self.root}")
        version = known[-1] if version is None else version
        meta = json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/versions/{version}").collect()))
        state = State(self.spark, {}, meta["next_ids"], parts={n: tuple(f"{self.root}/{p}" for p in paths) for n, paths in meta["parts"].items()}, floors=meta["floors"])
        return replace(state, tables={n: state.read(n, state.parts[n]) for n in TABLES}), version

    def save(self, state: State, version: int) -> State:
        """Publish state as the given version, one after the version it was made from. Returns it as it lies in the store."""
        pointer = self._path(f"{self.root}/versions/{version}")
        if self._fs.exists(pointer):
            raise ConflictError(f"version {version} exists already")
        folder = f"v{version}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
        # Folders elsewhere, as those of a state without a store, don't last: such tables are written whole.
        ours = {n: paths for n, paths in state.parts.items() if all(p.startswith(f"{self.root}/") for p in paths)}
        state = replace(state, parts=ours).counting(**{n: state.next_id(n) for n, t in TABLES.items() if t.counted})
        state = state.settled(lambda n: f"{self.root}/{folder}/{n}", TABLES)
        parts = {n: [p[len(self.root) + 1 :] for p in paths] for n, paths in state.parts.items()}
        try:
            out = self._fs.create(pointer, False)
        except Exception as error:
            raise ConflictError(f"version {version} exists already") from error
        out.write(bytearray(json.dumps({"parts": parts, "floors": state.floors, "next_ids": state.next_ids}).encode()))
        out.close()
        return state
