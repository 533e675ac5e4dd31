"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (principal axes, then iterative quantisation, from several starts) turn each vector into a
long binary code. A code is cut into substrings of 16 bits and every substring of a block of codes has an index of its own: a
table from each value to the codes that have it. A query probes each table with all values within a small radius of its own
substring. By the pigeonhole principle, that retrieves every code that differs in fewer than (radius + 1) * substrings bits;
codes farther away are retrieved if one of their substrings is near. All that is retrieved is ranked by cosine in double precision.

The radius and the number of substrings are calibrated on the sample: of those that retrieve nearly all true neighbours of its
vectors, the ones that visit the fewest entries are taken. True neighbours of a larger table are nearer than those of the
sample, so its share is a lower bound. A query that retrieves fewer codes of a block than it asks for widens its radius there.

Every row is indexed, in one block. Queries meet each block; a block yields the best few of each of its queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or have a null id, take no part; rows
with the query's id are its own; vectors of other lengths than the query's are no candidates; ties go to the smaller id; with
fewer candidates than asked for, all are returned; columns but the id and the vector aren't read; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import matrix, takes_part, unit

NEIGHBOURS, EVERY = 5, 50
#: Vectors of the fit, those of them that serve as queries, and rounds of quantisation of each rotation.
SAMPLE, TRIED, ROUNDS = 4096, 1024, 5
#: Bits of all rotations, about; bits of a substring; share of the sample's true neighbours that must be retrieved.
BITS, PIECE, WITHIN = 3072, 16, 0.96
#: Bytes of the vectors of an index block in single precision, and queries that meet it in one task, at most.
BLOCK_BYTES, QUERY_ROWS = 8 << 20, 4096


@dataclass(frozen=True)
class Codes:
    """Learned rotations (bits, dim) of centred vectors, and the radius around each substring that is probed."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors -> (rows, substrings) of uint16."""
        return np.packbits((x - self.centre) @ self.rotation.T > 0, axis=1).view(np.uint16)


def rotations(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(centre, directions): as many rotations of the principal axes as give so many bits, whole substrings only."""
    dim = sample.shape[1]
    rng = np.random.Generator(np.random.PCG64(5))
    centre = sample.mean(axis=0)
    z = sample - centre
    axes = np.linalg.svd(z.T @ z)[0].T if len(z) > 1 else np.eye(dim)
    parts, y = [], z @ axes.T
    for _ in range(max(1, -(-bits // dim))):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ROUNDS):  # the rotation that brings the codes' corners closest to the vectors
            u, _, v = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        parts.append((axes.T @ r).T)
    found = np.concatenate(parts)
    return centre, found[: len(found) // PIECE * PIECE]


def near_values(radius: int) -> np.ndarray:
    """All numbers of PIECE bits with at most radius ones: the differences to probe."""
    every = np.arange(1 << PIECE, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius].astype(np.uint16)


def fit(sample: np.ndarray, within: float = WITHIN, neighbours: int = NEIGHBOURS) -> Codes:
    """sample: unit vectors."""
    centre, directions = rotations(sample)
    some = sample[:TRIED]
    k = min(neighbours, len(sample) - 1)
    if k < 1:
        return Codes(centre, directions[:PIECE], PIECE)
    cos = some @ sample.T
    cos[np.arange(len(some)), np.arange(len(some))] = -2
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    coded = Codes(centre, directions, 0).encode(sample)
    far = np.bitwise_count(coded[: len(some), None, :] ^ coded[near]).reshape(-1, coded.shape[1])
    best = None
    for radius in range(PIECE + 1):
        # Share of the neighbours that the first substrings retrieve, for every number of substrings.
        share = np.maximum.accumulate(far <= radius, axis=1).mean(axis=0)
        if share[-1] >= within:
            pieces = int(np.argmax(share >= within)) + 1
            visits = pieces * len(near_values(radius))
            if best is None or visits < best[0]:
                best = visits, pieces, radius
    _, pieces, radius = best  # a radius of all bits retrieves everything
    return Codes(centre, directions[: pieces * PIECE], radius)


class Block:
    """The substring tables of a block of codes: of each substring, the places in order of value, and where each value starts."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.size, self.radius = len(codes), radius
        self.order = np.ascontiguousarray(np.argsort(codes, axis=0, kind="stable").T.astype(np.int32))
        self.start = np.zeros((codes.shape[1], (1 << PIECE) + 1), np.int32)
        for s in range(codes.shape[1]):
            np.cumsum(np.bincount(codes[:, s], minlength=1 << PIECE), out=self.start[s, 1:])
        self.probes = {radius: near_values(radius)}

    def retrieved(self, query: np.ndarray, least: int) -> np.ndarray:
        """Places of all codes with a substring within the radius of the query's; at least so many, or all."""
        radius = self.radius
        while True:
            if radius not in self.probes:
                self.probes[radius] = near_values(radius)
            wanted = query[:, None] ^ self.probes[radius][None]
            row = np.arange(len(query))[:, None]
            low, high = self.start[row, wanted], self.start[row, wanted.astype(np.int32) + 1]
            piece, probe = np.nonzero(high > low)
            low, count = low[piece, probe], (high - low)[piece, probe]
            # The entries from low on, count of them, of each probe that has some.
            entries = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
            seen = np.zeros(self.size, bool)
            seen[self.order[np.repeat(piece, count), entries]] = True
            found = np.flatnonzero(seen)
            if len(found) >= min(least, self.size) or radius == PIECE:
                return found
            radius += 1


def search_block(codes: Codes, most: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            x, q = matrix(index["vector"]), matrix(queries["vector"])
            ids, qids = index["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            block = Block(codes.encode(unit(x)), codes.radius)
            length, own = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            # The best few, and as many more as rows may have the query's own id.
            again = int(pd.Series(ids).value_counts().max())
            for k, code in enumerate(codes.encode(unit(q))):
                some = block.retrieved(code, most + again)
                some = some[ids[some] != qids[k]]
                score = (x[some] * q[k]).sum(axis=1) / (length[some] * own[k])
                if len(some) > 4 * most:  # ties with the last one stay in
                    kept = score >= np.partition(score, -most)[-most]
                    some, score = some[kept], score[kept]
                best = np.lexsort((ids[some], -score))[:most]
                out["query_id"] += [int(qids[k])] * len(best)
                out["vec_id"] += ids[some][best].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(index: DataFrame, queries: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """index, queries(vec_id, vector), vectors of one length that take part -> (query_id, rank, vec_id, score).

    An index row is in one block of BLOCK_BYTES and goes to as many tasks as the queries need: one for each QUERY_ROWS, or, of a
    small table, as many as keep the cores busy.
    """
    n, m = index.count(), queries.count()
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    if not sample:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = fit(unit(matrix(pd.Series([r.vector for r in sample]))), neighbours=most)
    i_blocks = -(-n * 4 * len(sample[0].vector) // BLOCK_BYTES)
    idle = -(-index.sparkSession.sparkContext.defaultParallelism // i_blocks)
    q_blocks = max(1, -(-m // QUERY_ROWS), min(idle, m // 64))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda k, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(k)).cast("int")
    a = index.withColumn("i", block(i_blocks, 1)).withColumn("j", every(q_blocks))
    b = queries.withColumn("j", block(q_blocks, 2)).withColumn("i", every(i_blocks))
    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(search_block(codes, most), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = materialize(rows.filter("vec_id is not null").filter(takes_part(F.col("vector"))), "search-vectors")
    found = None
    for (dim,) in rows.select(F.size("vector")).distinct().collect():  # lengths of vectors: a handful
        own = rows.filter(F.size("vector") == dim)
        part = search(own, own.filter(F.col("vec_id") % EVERY == 0).dropDuplicates(["vec_id"]))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
