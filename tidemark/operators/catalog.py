"""The catalogue: namespaces with their closure table, topics with their partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError, LogError, NotFoundError
from ..functions import DELIMITER, partition_id, path_hash
from ..state import State, written
from .relops import cascaded, insert, single, without

def find_namespace(state: State, path: str) -> DataFrame:
    return state["namespaces"].filter(F.col("path") == path)


def namespace_id(state: State, path: str) -> int | None:
    row = single(find_namespace(state, path).select("id"), f"namespace {path}")
    return row and row.id


def descendants(closures: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(id) -> (root_id, id, depth), the roots included."""
    return closures.join(roots.select(F.col("id").alias("ancestor_id")), "ancestor_id").select(F.col("ancestor_id").alias("root_id"), F.col("descendant_id").alias("id"), "depth")


def ancestors(closures: DataFrame, of: DataFrame) -> DataFrame:
    """of(id) -> (id, ancestor_id, depth)."""
    return closures.join(of.select(F.col("id").alias("descendant_id")), "descendant_id").select(F.col("descendant_id").alias("id"), "ancestor_id", "depth")


def closure_of(namespaces: DataFrame, deepest: int = 1000) -> DataFrame:
    """The closure table of the parents: self at depth 0, then a level up in each round until none is left. Each level is written,
    as the next one and the whole read it."""
    level = namespaces.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("depth"))
    parents = namespaces.filter("parent_id is not null").select(F.col("id").alias("ancestor_id"), "parent_id")
    found = level
    for _ in range(deepest):
        level = level.join(parents, "ancestor_id").select(F.col("parent_id").alias("ancestor_id"), "descendant_id", (F.col("depth") + 1).alias("depth"))
        level = written(level, "closure-level")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise LogError("namespaces are nested too deeply, or in a circle")


def create_namespace(state: State, path: str, as_of: Column) -> tuple[State, int]:
    """Blanks around a path or name don't make it one; the path is stored as given."""
    path = path or ""
    if not path.strip(" "):
        raise LogError("a namespace needs a path")
    above, _, name = path.rpartition(DELIMITER)
    if not name.strip(" "):
        raise LogError("a namespace needs a name")
    parent = None
    if DELIMITER in path:
        parent = namespace_id(state, above)
        if parent is None:
            raise NotFoundError(f"parent namespace {above!r} does not exist")
    if namespace_id(state, path) is not None:
        raise ConstraintError(f"namespace {path!r} exists already")
    new = state.next_id("namespaces")
    row = state.spark.range(1).select(
        F.lit(new).alias("id"), F.lit(parent).cast("long").alias("parent_id"), F.lit(name).alias("name"), F.lit(path).alias("path"), path_hash(F.lit(path)).alias("path_hash")
    )
    links = state.spark.range(1).select(F.lit(new).alias("ancestor_id"), F.lit(new).alias("descendant_id"), F.lit(0).alias("depth"))
    if parent is not None:
        inherited = state["namespace_closures"].filter(F.col("descendant_id") == parent)
        links = links.unionByName(inherited.select("ancestor_id", F.lit(new).alias("descendant_id"), (F.col("depth") + 1).alias("depth")))
    state = insert(state, "namespaces", row, as_of)
    return insert(state, "namespace_closures", links, check=False).counting(namespaces=new + 1), new


def delete_namespace(state: State, path: str) -> State:
    """The namespace and all below it; refused while one of them has a topic."""
    root = namespace_id(state, path)
    if root is None:
        raise NotFoundError(f"namespace {path!r} does not exist")
    return cascaded(state, "namespaces", descendants(state["namespace_closures"], find_namespace(state, path)).select("id"))


def with_prefix(namespaces: DataFrame, subtree: DataFrame, old: Column, new: Column, as_of: Column) -> DataFrame:
    """namespaces with the path prefix old replaced by new in the subtree (id)."""
    hit = namespaces.join(subtree.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    path = F.when(F.col("_hit"), F.concat(new, F.substr(F.col("path"), F.char_length(old) + 1))).otherwise(F.col("path"))
    out = hit.withColumn("path", path).withColumn("path_hash", path_hash(F.col("path")))
    return out.withColumn("last_modified_at", F.when(F.col("_hit"), as_of).otherwise(F.col("last_modified_at"))).select(*namespaces.columns)


def rename_namespace(state: State, path: str, name: str, as_of: Column) -> State:
    """A missing path is left alone; a sibling of that name is an error."""
    row = single(find_namespace(state, path), f"namespace {path}")
    if row is None:
        return state
    table = state["namespaces"]
    if not table.filter(F.col("parent_id").eqNullSafe(F.lit(row.parent_id)) & (F.col("name") == name) & (F.col("id") != row.id)).isEmpty():
        raise ConstraintError(f"a sibling is named {name!r} already")
    above = path.rpartition(DELIMITER)[0]
    new = f"{above}{DELIMITER}{name}" if DELIMITER in path else name
    subtree = descendants(state["namespace_closures"], find_namespace(state, path))
    table = with_prefix(table, subtree, F.lit(path), F.lit(new), as_of)
    return state.having(namespaces=table.withColumn("name", F.when(F.col("id") == row.id, F.lit(name)).otherwise(F.col("name"))))


def moved_closures(closures: DataFrame, root: int, parent: int | None) -> DataFrame:
    """Links from outside ancestors into the subtree go; each new ancestor gets one to each node of the subtree."""
    below = closures.filter(F.col("ancestor_id") == root).select(F.col("descendant_id"), F.col("depth").alias("below"))
    inside = below.select("descendant_id")
    into = closures.join(inside, "descendant_id")
    cut = into.join(inside.withColumnRenamed("descendant_id", "ancestor_id"), "ancestor_id", "left_anti")
    kept = without(closures, cut, ["ancestor_id", "descendant_id"])
    if parent is None:
        return kept
    above = closures.filter(F.col("descendant_id") == parent).select("ancestor_id", F.col("depth").alias("above"))
    # Ancestors of one node: as many as the tree is deep.
    new = below.crossJoin(F.broadcast(above)).select("ancestor_id", "descendant_id", (F.col("above") + F.col("below") + 1).cast("int").alias("depth"))
    return kept.unionByName(new)


def move_namespace(state: State, path: str, parent_path: str | None, as_of: Column) -> State:
    """Under another parent, or to the root if that is null or blank. A missing path is left alone."""
    row = single(find_namespace(state, path), f"namespace {path}")
    if row is None:
        return state
    parent = None
    if parent_path and parent_path.strip(" "):
        parent = namespace_id(state, parent_path)
        if parent is None:
            raise NotFoundError(f"parent namespace {parent_path!r} does not exist")
        if parent == row.id:
            raise LogError("a namespace can't be moved under itself")
        if not state["namespace_closures"].filter((F.col("ancestor_id") == row.id) & (F.col("descendant_id") == parent)).isEmpty():
            raise LogError("a namespace can't be moved under one of its descendants")
    new = row.name if parent is None else f"{parent_path}{DELIMITER}{row.name}"
    if new != path and namespace_id(state, new) is not None:
        raise ConstraintError(f"namespace {new!r} exists already")
    subtree = descendants(state["namespace_closures"], find_namespace(state, path))
    table = with_prefix(state["namespaces"], subtree, F.lit(path), F.lit(new), as_of)
    table = table.withColumn("parent_id", F.when(F.col("id") == row.id, F.lit(parent).cast("long")).otherwise(F.col("parent_id")))
    return state.having(namespaces=table, namespace_closures=moved_closures(state["namespace_closures"], row.id, parent))


def generated_partitions(topics: DataFrame) -> DataFrame:
    """topics(id, partitions) -> their partitions; a topic always has number 0."""
    numbers = F.explode(F.sequence(F.lit(0), F.greatest(F.col("partitions"), F.lit(1)) - 1))
    rows = topics.select(F.col("id").alias("topic_id"), numbers.alias("partition_number"))
    return rows.select(partition_id(F.col("topic_id"), F.col("partition_number")).alias("id"), "topic_id", "partition_number", F.lit(0).cast("long").alias("high_watermark"))


def create_topic(state: State, path: str, name: str, partitions: int, as_of: Column) -> tuple[State, int]:
    home = namespace_id(state, path)
    if home is None:
        raise NotFoundError(f"namespace {path!r} does not exist")
    new = state.next_id("topics")
    row = state.spark.range(1).select(F.lit(new).alias("id"), F.lit(home).alias("namespace_id"), F.lit(name).alias("name"), F.lit(partitions).alias("partitions"))
    state = insert(state, "topics", row, as_of)
    return insert(state, "partitions", generated_partitions(row), check=False).counting(topics=new + 1), new


def resolved_topics(state: State) -> DataFrame:
    """(path, topic, topic_id, partitions) of every topic, resolved live."""
    spaces = state["namespaces"].select(F.col("id").alias("namespace_id"), "path")
    return state["topics"].join(spaces, "namespace_id").select("path", F.col("name").alias("topic"), F.col("id").alias("topic_id"), "partitions")


def find_topic(state: State, path: str, name: str) -> DataFrame:
    spaces = find_namespace(state, path).select(F.col("id").alias("namespace_id"))
    return state["topics"].filter(F.col("name") == name).join(F.broadcast(spaces), "namespace_id").select(*state["topics"].columns)


def find_partition(state: State, path: str, name: str, number: int) -> DataFrame:
    topic = find_topic(state, path, name).select(F.col("id").alias("topic_id"))
    return state["partitions"].filter(F.col("partition_number") == number).join(F.broadcast(topic), "topic_id").select(*state["partitions"].columns)


def delete_topic(state: State, path: str, name: str, cascade: bool = False) -> State:
    """A topic always has partitions, which hold it: refused, unless they go with it."""
    topic = find_topic(state, path, name).select("id")
    if cascade:
        parts = state["partitions"].join(topic.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
        state = cascaded(state, "partitions", parts.select("id"))
    return cascaded(state, "topics", topic)
