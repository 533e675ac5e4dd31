"""Mixing sources to target weights by the cube method of balanced sampling.

Every document of a source is to be taken target / source size times: its whole part for certain, the rest as an inclusion
probability. The flight phase moves the probabilities of three documents at a time along the null space of the two
constraints (number of documents, number of words) until one is 0 or 1, so both totals stay as they are while all but two
documents of a group get decided. A source is dealt into groups of bounded size by hash; what a group leaves undecided meets
in the next round's groups, until one group of a source is left. It holds a few documents back; with the two left open they are the landing problem, of
which all ways are tried and the one nearest to the expected totals is taken.

Targets: sources weigh by the order of their names, share the total and stop at a multiple of their own size; the excess is
shared by weight again. That is the level at which the sum of min(cap, level * weight) is the total, found from running sums.

Defined results: a null text has no words; a null source is one source, the last; rows without words are never taken; texts of any
length count whole; of equal sizes, places are drawn from ids; repeated rows are documents of their own; the draw depends only on
ids and sizes, so reruns agree; columns of any name are carried along, but those of the names that are added give way; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small, spread, table

# The contract's weights, the share of all sizes that is taken, and the cap on a source.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Documents of a group in the flight phase, and groups whose left-overs meet in one of the next round.
GROUP_ROWS, FAN_IN = 8192, 1024
#: Documents of a source that the landing holds back: so many of the largest, and as many of all.
HELD = 7
#: Sources whose table is broadcast, at most; beyond, it is joined on a salted key.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: Copies of a repeated row that one task makes.
PART = 4096


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def running(rows: DataFrame, order: list, **sums: str) -> DataFrame:
    """rows, written, with place (from 0 in the given order, of which no two rows are equal) and running sums of columns before
    each row. Ranges of the order are numbered by themselves and moved by the sums of the ranges before: one row for each."""
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = rows.select("*", *(c.alias(k) for c, k in zip(order, keys)))
    dealt = materialize(dealt.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    inside = Window.partitionBy("_range").orderBy(*keys)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    dealt = dealt.withColumn("_place", F.row_number().over(inside).cast("long") - 1).withColumns({f"_{n}": zero(F.sum(c).over(before)) for n, c in sums.items()})
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", zero(F.sum("_n").over(earlier)).alias("_at"), *(zero(F.sum(f"_all_{n}").over(earlier)).alias(f"_at_{n}") for n in sums))
    found = dealt.join(F.broadcast(ranges), "_range")  # as many rows as there are shuffle partitions
    return found.select(*rows.columns, (F.col("_at") + F.col("_place")).alias("place"), *((F.col(f"_at_{n}") + F.col(f"_{n}")).alias(n) for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, size) -> one row for each source: source, rank, docs, source_size, target."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    each = running(each, [F.col("source").isNull(), F.coalesce("source", F.lit(""))]).withColumnRenamed("place", "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    each = materialize(running(each, [F.col("most") / F.col("weight"), F.col("rank")], before="most", passed="weight"), "mix-levels")
    whole = each.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    each = each.withColumn("level", (F.lit((whole["size"] or 0) * share) - F.col("before")) / (F.lit(whole["weight"] or 1.0) - F.col("passed")))
    # The first source, in this order, that doesn't reach its cap sets the level for itself and all after it.
    first = each.filter(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct(F.col("most") / F.col("weight"), "rank", "level")).alias("at")).first().at
    target = F.col("most") if first is None else F.least(F.col("most"), F.lit(first["level"]) * F.col("weight"))
    return each.select("source", "rank", "docs", "source_size", target.alias("target"))


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Chances after the flight phase: all are 0 or 1 but two at most; sums of chances and of size * chance are kept."""
    out = list(chances)
    active: list[int] = []
    waiting = iter(range(len(out)))
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1, -1, 0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            u = (1, -1)
        else:
            return out
        up = down = float("inf")
        for i, d in zip(active, u):
            if d:
                to_one, to_zero = (1 - out[i]) / abs(d), out[i] / abs(d)
                up, down = (min(up, to_one), min(down, to_zero)) if d > 0 else (min(up, to_zero), min(down, to_one))
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u):
            x = out[i] + step * d
            out[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        active = [i for i in active if 0 < out[i] < 1]


def land(sizes: list[int], chances: list[float]) -> list[float]:
    """The last few chances as 0 or 1: of all ways, the one nearest to the expected words and documents (one counts as one)."""
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    size, chance = np.array([sizes[i] for i in open_], float), np.array([chances[i] for i in open_], float)
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float) - chance
    best = int(np.argmin(np.abs(ways @ size) + np.abs(ways.sum(axis=1)))) if open_ else 0
    out = list(chances)
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    return out


def flight_and_landing(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Decides all: a few documents, the largest and some drawn from all (sizes fall), are held back for the landing."""
    n = len(sizes)
    held = {*range(min(n, HELD)), *rng.sample(range(n), min(n, HELD))}
    rest = [i for i in range(n) if i not in held]
    out = list(chances)
    for i, p in zip(rest, flight([sizes[i] for i in rest], [chances[i] for i in rest], rng)):
        out[i] = p
    return land(sizes, out)


def _decide(last: bool):
    def decide(key, rows):
        # A document's place among those of its size is drawn from its id.
        rows = rows.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rng = random.Random(int.from_bytes(hashlib.blake2b(repr(tuple(map(int, key))).encode(), digest_size=8).digest(), "big"))
        sizes = rows["size"].tolist()
        rows["chance"] = (flight_and_landing if last else flight)(sizes, rows["chance"].tolist(), rng)
        return rows

    return decide


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target and copies, how often the mix takes the row."""
    carried = [c for c in docs.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies")]
    names = {c: f"_c{i}" for i, c in enumerate(carried)}  # so that none clashes with the columns below
    given = [c for c in docs.columns if c in names or c in ("doc_id", "source", "size")]
    docs = materialize(docs.select("doc_id", "source", "size", *(F.col(c).alias(n) for c, n in names.items())), "mix-sizes")
    sources = materialize(targets(docs, weights, share, cap), "mix-sources")
    top = sources.agg(F.count("*"), F.coalesce(F.max("docs"), F.lit(0))).first()
    few = top[0] <= BROADCAST_SOURCES
    s = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        joined = docs.join(F.broadcast(s), same)
    else:
        salted = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("_of", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))).join(salted, same & (F.col("_of") == F.col("_salt"))).drop("_of", "_salt")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.drop("_source").withColumn("_rate", rate).withColumn("_whole", F.floor("_rate")).withColumn("chance", F.col("_rate") - F.col("_whole"))
    shards = F.ceil(F.col("docs") / GROUP_ROWS)
    joined = joined.withColumn("order", F.xxhash64("doc_id", "size")).withColumn("shard", F.pmod(F.xxhash64("order"), F.greatest(shards, F.lit(1))))
    plain = joined.filter("not (chance > 0 and chance < 1)")
    drawn, done = joined.filter("chance > 0 and chance < 1"), []
    groups = -(-top[1] // GROUP_ROWS)
    while True:
        last = groups <= 1
        drawn = drawn.groupBy("rank", "shard").applyInPandas(_decide(last), drawn.schema)
        if last:
            done.append(drawn)
            break
        drawn = materialize(drawn, "mix-flight")
        done.append(drawn.filter("chance <= 0 or chance >= 1"))
        drawn = drawn.filter("chance > 0 and chance < 1").withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        groups = -(-groups // FAN_IN)
    for part in done:
        plain = plain.unionByName(part)
    return plain.select(*(F.col(names.get(c, c)).alias(c) for c in given), "source_size", "target", (F.col("_whole") + F.col("chance")).cast("long").alias("copies"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = sized(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).select("doc_id", "source", "size")
    mixed = copies(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    # Columns get names of their own, whatever docs has. Rows that are equal in all columns are interchangeable: they share a key
    # and what is taken of them.
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    hashed = [names[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = plain.withColumn("key", F.xxhash64(*hashed)).withColumn("id", F.coalesce(F.col(names["doc_id"]), F.lit(0)))
    sizes = sized(keyed, names["text"]).select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["source"]).alias("source"), "size", "key", "id")
    taken = materialize(copies(sizes).groupBy("id", "key").agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).filter(F.col("all") > 0), "mix-taken")
    each = keyed.join(taken.filter(F.col("rows") == 1), ["id", "key"])
    repeated = taken.filter(F.col("rows") > 1)
    if not repeated.isEmpty():
        # One row of each stands for all; what is taken of it is dealt in parts.
        row = F.struct(*names.values())
        some = keyed.join(small(repeated.select("id", "key")), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.first(row).alias("row"))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / PART)))
        some = some.join(repeated, ["id", "key"]).withColumn("part", parts).withColumn("all", F.least(F.lit(PART), F.col("all") - F.col("part") * PART))
        each = each.select(*names.values(), "all").unionByName(some.repartition("id", "key", "part").select("row.*", "all"))
    found = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("all").cast("long"))))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))
