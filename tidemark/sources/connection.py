"""Where an engine finds its data: settings from the environment, and tables of a relational database through JDBC."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Kinds of databases with their URL schemes and default ports.
KINDS = {"mysql": ("jdbc:mysql", "3306"), "postgresql": ("jdbc:postgresql", "5432")}


@dataclass(frozen=True)
class Connection:
    kind: str
    host: str
    port: str
    name: str
    user: str
    password: str

    @staticmethod
    def from_environment(env: dict[str, str] | None = None) -> Connection:
        """DB_TYPE, DB_HOST, DB_PORT, DB_NAME, DB_USER and DB_PASSWORD."""
        env = dict(os.environ) if env is None else env
        kind = env.get("DB_TYPE", "mysql").lower()
        if kind not in KINDS:
            raise ValueError(f"unknown kind of database: {kind}")
        return Connection(kind, env.get("DB_HOST", "localhost"), env.get("DB_PORT", KINDS[kind][1]), env.get("DB_NAME", ""), env.get("DB_USER", ""), env.get("DB_PASSWORD", ""))

    @property
    def url(self) -> str:
        return f"{KINDS[self.kind][0]}://{self.host}:{self.port}/{self.name}"

    def read(self, spark: SparkSession, table: str, split: tuple[str, int, int, int] | None = None) -> DataFrame:
        """A table, in parallel if split gives a column, its bounds and the number of partitions. The driver's jar must be there."""
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", table).option("user", self.user).option("password", self.password)
        if split:
            for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), split):
                reader = reader.option(k, v)
        return reader.load()


def select(spark: SparkSession, query: str, **values) -> DataFrame:
    """A query with named parameters, bound as values and never spliced into its text."""
    return spark.sql(query, args=values)
