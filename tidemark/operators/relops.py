"""Insert, delete, update and upsert on immutable tables, and the constraints that guard them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError
from ..schemas import TABLES
from ..state import State


def single(df: DataFrame, what: str):
    """The only row of a lookup by key, or None. what names it in the error if there are several."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ConstraintError(f"{what} is ambiguous")
    return rows[0] if rows else None


def completed(name: str, rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """rows with defaults and stamps for the columns that they lack."""
    t = TABLES[name]
    for column, kind in t.columns:
        if column not in rows.columns:
            stamp = column in ("created_at", "last_modified_at") and as_of is not None
            rows = rows.withColumn(column, (as_of if stamp else F.lit(t.defaults.get(column))).cast(kind))
    return rows.select(*(F.col(c).cast(k).alias(c) for c, k in t.columns))


def check_rows(state: State, name: str, rows: DataFrame, references: bool = True) -> None:
    """Raise unless new rows keep nulls, lengths, domains, keys and references."""
    t = TABLES[name]
    bad = [(f"{c} is null", F.col(c).isNull()) for c in t.names if c not in t.nullable]
    bad += [(f"{c} is longer than {n}", F.char_length(c) > n) for c, n in t.lengths.items()]
    bad += [(f"{c} is none of {', '.join(v)}", ~F.col(c).isin(*v)) for c, v in t.domains.items()]
    found = rows.agg(*(F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias(f"c{i}") for i, (_, cond) in enumerate(bad))).first()
    for i, (text, _) in enumerate(bad):
        if found[i]:
            raise ConstraintError(f"{name}: {text}")
    for key in (t.key, *t.unique):
        cols = list(key)
        full = rows.na.drop(subset=cols)  # a null in a key equals nothing
        again = full.groupBy(*cols).count().filter("count > 1").select(*cols).unionByName(full.select(*cols).join(state[name].select(*cols), cols, "left_semi"))
        if not again.isEmpty():
            raise ConstraintError(f"{name}: {', '.join(cols)} exists already")
    for r in t.references if references else ():
        there = state[r.table].select(F.col("id").alias(r.column))
        if not rows.filter(F.col(r.column).isNotNull()).join(there, r.column, "left_anti").isEmpty():
            raise ConstraintError(f"{name}: {r.column} points at no row of {r.table}")


def insert(state: State, name: str, rows: DataFrame, as_of: Column | None = None, check: bool = True) -> State:
    rows = completed(name, rows, as_of)
    if check:
        check_rows(state, name, rows)
    return state.having(**{name: state[name].unionByName(rows)})


def without(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def updated(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], touch: Column | None = None) -> DataFrame:
    """table with columns taken from changes, one row for each key, where there is one; touch stamps changed rows."""
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = table.join(new, keys, "left")
    taken = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    if touch is not None:
        taken["last_modified_at"] = F.when(F.col("_hit"), touch).otherwise(F.col("last_modified_at"))
    return joined.select(*(taken[c].alias(c) if c in taken else F.col(c) for c in table.columns))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those with the same key, and the others added."""
    return without(table, rows, keys).unionByName(rows.select(*table.columns))


def cascaded(state: State, name: str, doomed: DataFrame) -> State:
    """Delete rows by key, with all that references let go with them. Refused while a reference without cascade holds."""
    key = list(TABLES[name].key)
    new = {name: without(state[name], doomed, key)}
    if key == ["id"]:
        for child in TABLES.values():
            for r in child.references:
                if r.table != name or child.name == name:
                    continue
                ids = doomed.select(F.col("id").alias(r.column)).distinct()
                held = state[child.name].join(ids, r.column, "left_semi")
                if not r.cascade:
                    if not held.isEmpty():
                        raise ConstraintError(f"{child.name} holds rows of {name}")
                elif TABLES[child.name].key == ("id",):
                    state = cascaded(state, child.name, held.select("id"))
                else:
                    state = state.having(**{child.name: state[child.name].join(ids, r.column, "left_anti")})
    return state.having(**new)
