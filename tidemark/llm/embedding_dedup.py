"""Embedding near-dedup by a forest of random projection trees with spill.

Equal vectors of a label are one point with a weight. Each tree projects the points on one random direction for each level and
splits every node at its median; points closer to the split than a margin go to both sides, so that two near points hardly
ever part. Splits are fitted on a bounded sample, then every point is routed by itself: all its leaves in all trees are known
before points are compared. A label's trees are as deep as its points need for leaves of a bounded size, and as many as their
depth needs: one for a label that fits in a leaf, more the more splits could part two near points.

Points are compared within leaves in double precision. A pair that meets in several leaves belongs to the smallest of them, so
a leaf yields sums of links and a spanning forest for its points, never pairs, and its output is linear in its members. Leaves
that stay large, as those of a dense group, are dealt in blocks; each two blocks are compared in a task of their own.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing; vectors of different lengths aren't linked; repeated rows are vectors of their own; a row with a null id takes no part
(component null, not kept); a pair at the threshold is linked; columns but the id, the vector and the label aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small, table
from .components import components
from .vectors import matrix, takes_part, unit

THRESHOLD = 0.93
#: Points of the fit, members of a leaf aimed at, and deepest tree.
SAMPLE, LEAF, DEEPEST = 8192, 2048, 40
#: Half the width of the overlap at a split, in standard deviations of the difference that two vectors at the threshold have on
#: a random direction.
SPILL = 0.7
#: Share of the pairs at the threshold that one split parts with such an overlap (measured: 0.011), and share that may be parted
#: in all trees.
PARTED, MISSED = 0.012, 1e-4
#: Nodes whose medians are fitted; deeper ones split at their level's median.
FITTED_LEVELS = 8
#: Members of a block of a leaf.
BLOCK = 4096
#: Parts that equal vectors are dealt in when they get their component.
SALTS = 32


def trees_for(depth: int) -> int:
    """Trees of so many levels in all of which no more than MISSED of the pairs at the threshold are parted."""
    if not depth:
        return 1
    return math.ceil(math.log(MISSED) / math.log(1 - (1 - PARTED) ** depth))


class Forest:
    def __init__(self, sample: np.ndarray, dim: int, threshold: float, trees: int = trees_for(DEEPEST), levels: int = DEEPEST):
        rng = np.random.Generator(np.random.PCG64(11))
        d = rng.standard_normal((trees, levels, dim))
        self.directions = d / np.linalg.norm(d, axis=2, keepdims=True)
        self.margin = SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(dim)
        self.medians = np.zeros((trees, levels))
        self.nodes: list[dict[int, float]] = [{} for _ in range(trees)]
        for t in range(trees):
            if not len(sample):
                continue
            p = sample @ self.directions[t].T
            self.medians[t] = np.median(p, axis=0)
            node = np.ones(len(sample), np.int64)
            for level in range(min(FITTED_LEVELS, levels)):
                split = np.full(len(sample), self.medians[t, level])
                for n in np.unique(node):
                    at = node == n
                    if at.sum() >= 16:
                        self.nodes[t][int(n)] = float(np.median(p[at, level]))
                        split[at] = self.nodes[t][int(n)]
                node = 2 * node + (p[:, level] > split)

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> list[list[int]]:
        """For each unit vector, its leaves as numbers: tree and path."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        deepest = int(depth.max(initial=0))
        trees = np.array([trees_for(d) for d in range(deepest + 1)])[depth]
        for t in range(int(trees.max(initial=0))):
            p = x @ self.directions[t, :deepest].T
            row = np.flatnonzero(trees > t)
            node = np.ones(len(row), np.int64)
            for level in range(deepest):
                go = depth[row] > level
                split = np.full(len(row), self.medians[t, level])
                if level < FITTED_LEVELS:
                    split = np.array([self.nodes[t].get(int(n), s) for n, s in zip(node, split)])
                diff = p[row, level] - split
                left, right = go & (diff <= self.margin), go & (diff > -self.margin)
                row, node = np.concatenate((row[~go], row[left], row[right])), np.concatenate((node[~go], 2 * node[left], 2 * node[right] + 1))
            for r, n in zip(row.tolist(), node.tolist()):
                out[r].append(n * 64 + t)
        return out


def routed(points: DataFrame, forests: dict[int, Forest], kind: type) -> DataFrame:
    """points(rep, label, n, vector, depth) -> with vectors as bytes of that type and their leaves, smallest first."""

    def route(batches):
        for rows in batches:
            for dim, part in rows.groupby(rows["vector"].map(len)):
                x = matrix(part["vector"])
                leaves = forests[dim].leaves(unit(x), part["depth"].to_numpy())
                labels = part["label"].tolist()
                # Of tuples of integers, which hash alike in every process.
                keyed = [sorted(hash((dim, label, leaf)) for leaf in own) for label, own in zip(labels, leaves)]
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "n": part["n"].to_numpy(), "raw": [v.tobytes() for v in x.astype(kind)], "leaves": keyed})

    return points.mapInPandas(route, "rep long, n long, raw binary, leaves array<long>")


def _owned(leaves: list[list[int]], a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether leaf is the smallest that the two points of each pair share."""
    widest = max(map(len, leaves))
    table_ = np.array([[*x, *[-1] * (widest - len(x))] for x in leaves], np.int64)
    before = np.where((table_ < leaf) & (np.arange(widest) < [[len(x)] for x in leaves]), table_, np.int64(-(2**63)))
    other = np.where(before == np.int64(-(2**63)), np.int64(2**63 - 1), before)  # padding of the two sides never meets
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 20_000):
        x, y = before[a[at : at + 20_000]], other[b[at : at + 20_000]]
        out[at : at + 20_000] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return out


def compare(threshold: float, kind: type):
    """Of a tile: rows (a, b, w): b null, w links of the vector a; or b the smallest point of a's group in this tile."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = key
        rows = rows.sort_values("rep", ignore_index=True)
        x = unit(np.frombuffer(b"".join(rows["raw"]), kind).reshape(len(rows), -1).astype(np.float64))
        rep, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
        block = rows["block"].to_numpy()
        left = np.arange(len(rows)) if i == j else np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block != i)
        links, group = np.zeros(len(rows), np.int64), np.arange(len(rows))
        leaves = rows["leaves"].tolist()
        pairs_a, pairs_b = [], []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            near = x[part] @ x[right].T >= threshold
            if i == j:
                near &= right[None, :] > part[:, None]
            p, q = np.nonzero(near)
            a, b = part[p], right[q]
            own = _owned(leaves, a, b, leaf) if len(a) else np.empty(0, bool)
            a, b = a[own], b[own]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            pairs_a.append(a)
            pairs_b.append(b)
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while len(a):  # the smallest place spreads over each group; places are in order of rep
            least = group.copy()
            np.minimum.at(least, a, group[b])
            np.minimum.at(least, b, group[a])
            least = least[least]
            if (least == group).all():
                break
            group = least
        some, moved = np.flatnonzero(links), np.flatnonzero(group != np.arange(len(rows)))
        return pd.DataFrame({
            "a": np.concatenate((rep[some], rep[moved])),
            "b": pd.array([*[None] * len(some), *rep[group[moved]].tolist()], dtype="Int64"),
            "w": np.concatenate((links[some], np.zeros(len(moved), np.int64))),
        })

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row for each row."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    good = takes_part(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = ids.select("vec_id", F.when(good, F.xxhash64("label", "vector")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "vector", "label")).alias("h2"), "label", "vector")
    good = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    points = materialize(good, "forest-points")
    # Vectors travel in the precision that they have; cosines are computed in double precision.
    kind = np.float32 if points.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64
    sizes = materialize(points.groupBy("label").agg(F.count("*").alias("size")), "forest-labels")
    depth = F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / LEAF)).cast("int")))
    # Labels of more than a leaf are few enough to be broadcast: one for each LEAF points at most. Others have depth 0.
    deep = points.join(small(sizes.filter(F.col("size") > LEAF)), "label", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    deep = deep.select("rep", F.xxhash64("label").alias("label"), "n", "vector", depth.alias("depth"))
    forests = {}
    for (dim,) in points.select(F.size("vector")).distinct().collect():  # lengths of vectors: a handful
        sample = points.filter(F.size("vector") == dim).select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE)
        forests[dim] = Forest(unit(matrix(pd.Series([r.vector for r in sample.collect()]))), dim, threshold)
    at = materialize(routed(deep, forests, kind), "forest-leaves")
    large = at.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    large = materialize(large, "forest-sizes")
    rows = at.withColumn("leaf", F.explode("leaves")).join(small(large), "leaf")
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = rows.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "raw", "leaves")
    found = materialize(tiles.groupBy("leaf", "i", "j").applyInPandas(compare(threshold, kind), "a long, b long, w long"), "forest-links")
    release(sizes, at, large)
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    comps = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    placed = points.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(comps, "rep", "left").filter("n > 1 or w is not null")
    placed = placed.select("h1", "h2", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    placed = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = keyed.select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = dealt.filter("h1 is not null").join(placed, ["h1", "h2", "salt"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    alone = dealt.filter("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
