"""MinHash near-dedup by a signature-coordinate inverted join.

1. One pass gives each document the size and digest of its shingle set and its signature. Documents with equal sets are one
   from here on.
2. Each signature posts its (coordinate, value) pairs, the tokens. Two documents that share at least T of K tokens also share
   one of their K - T + 1 rarest ones (prefix), in any order common to all; the order is by how many documents have a token.
   Tokens that only one document has can't join anything. Common shingles and shared passages come last in that order and are
   skipped, not scanned.
3. First round: of each posting list, the hub is the document whose tokens are the most common ones. Each document meets the
   one hub that it shares most lists with: one row for each document, however dense its group.
4. Second round: lists whose documents are all in one component by now are skipped. In the others, collisions of wider
   signatures are counted between documents of different components, and pairs with enough are retained. A list yields no
   pairs but a spanning forest of the retained ones; the components of all forests are clusters, outside of which no pair is
   retained.
5. The pairs that are retained within a cluster are confirmed on full shingle sets, again between different components only,
   and yield a spanning forest of links. Lists and clusters that are long are dealt in blocks; each two blocks are compared in
   a task of their own. So rows grow with the members of a group, also if none of its pairs is a link, and no pair that could
   link two components stays untried.

Defined results: a null or blank text has an empty set, links with nothing and is its own component; rows that share a
doc_id get each the component of its own text; a null doc_id takes no part (component null, not kept); whole texts of any length count;
of equal similarities none is preferred, as links have no order; other columns of the documents aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_groups, map_rows, materialize, release, small, spread, table
from .components import components
from .shingles import multipliers, shingle_set, signature

#: Coordinates of a signature. 64 leave six bits of a token for the coordinate.
COORDINATES = 64
#: Standard deviations that the match threshold lies below the matches expected at the similarity sought: of such pairs, about
#: one in two thousand is missed.
DEVIATIONS = 3.3
#: Coordinates that collisions are counted on: only sets that share a token have them.
WIDE = 256
#: Members of a block of a posting list or of a hub's documents, bytes of the sets of a block of a cluster.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Tokens that are broadcast with their counts, at most: those of so many documents that there can't be more of them.
HOT_TOKENS = 200_000
#: Parts that the documents of one set are dealt in when they get its component.
SALTS = 32


def match_threshold(similarity: float, coordinates: int = COORDINATES) -> int:
    mean = coordinates * similarity
    return max(1, math.floor(mean - DEVIATIONS * math.sqrt(mean * (1 - similarity))))


def digest_of(shingles: np.ndarray) -> bytes | None:
    """Equal for equal sets; null for an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sig array<int>); digest and sig are null for an empty set."""
    coefficients = multipliers(COORDINATES)

    def sign(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, text in rows:
            s = shingle_set(text, words)
            if len(s):
                yield i, len(s), digest_of(s), signature(s, coefficients).view(np.int32)
            else:
                yield i, 0, None, None

    ids = F.col(id_col).cast("long").alias("doc_id")
    return map_rows(docs.select(ids, text_col), "doc_id long, n_shingles long, digest binary, sig array<int>", sign)


def posters(sets: DataFrame, matches: int) -> DataFrame:
    """sets(rep, sig) -> (rep, common, prefix array<struct<df, token>>): the documents that have a token in their prefix that
    another has too; common is the sum of the counts of a document's tokens."""
    posts = sets.select("rep", F.posexplode("sig").alias("at", "v")).select("rep", (F.col("v").cast("long") * COORDINATES + F.col("at")).alias("token"))
    shared = materialize(posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-shared")
    # Of all posts, 64 for each set, no more than HOT_TOKENS tokens can have so many: they are broadcast, and what is left to
    # join by shuffle has no large keys.
    many = max(2, -(-COORDINATES * sets.count() // HOT_TOKENS))
    marked = posts.join(F.broadcast(shared.filter(F.col("df") >= many)), "token", "left")
    cold = marked.filter("df is null").select("rep", "token").join(shared.filter(F.col("df") < many), "token")
    found = marked.filter("df is not null").select("rep", "token", "df").unionByName(cold.select("rep", "token", "df"))
    by_set = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    # Tokens without a second document are the rarest: they fill the prefix first. A document of several sets posts all.
    size = F.size("found")
    room = F.when(size > COORDINATES, size).otherwise(F.greatest(F.lit(0), F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - size)))
    common = F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["df"])
    posted = by_set.select("rep", common.alias("common"), F.slice("found", 1, room).alias("prefix")).filter(F.size("prefix") > 0)
    posted = materialize(posted, "minhash-posts")
    release(shared)
    return posted


def _part(members: Column, rows: int) -> Column:
    """How many blocks so many members are dealt in."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(members / rows))


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def nearest_hubs(posts: DataFrame) -> DataFrame:
    """posts(rep, common, token, df) -> (rep, hub): of the hubs of its lists, the one that most of them have."""
    hubs = posts.groupBy("token", "df").agg(F.max(F.struct("common", (-F.col("rep")).alias("less"))).alias("hub"))
    hubs = hubs.select("token", _numbers(_part(F.col("df"), BLOCK)).alias("part"), F.col("hub.common").alias("common"), (-F.col("hub.less")).alias("hub"))
    dealt = posts.select("rep", "token", F.pmod(F.xxhash64("rep"), _part(F.col("df"), BLOCK)).alias("part"))
    met = dealt.join(hubs, ["token", "part"]).filter("rep <> hub").repartition("rep")
    met = met.groupBy("rep", "hub", "common").agg(F.count("*").alias("lists"))
    best = F.max(F.struct("lists", "common", (-F.col("hub")).alias("less")))
    return met.groupBy("rep").agg(best.alias("best")).select("rep", (-F.col("best.less")).alias("hub"))


def full_sets(docs: DataFrame, posted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles, wide) of the documents that stand for a posted set: sorted 64-bit hashes, as bytes, and a signature of
    more coordinates, of a byte each."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_col).join(small(posted.select("rep")), "rep", "left_semi")
    coefficients = multipliers(WIDE)

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        for rep, text in rows:
            s = shingle_set(text, words)
            if len(s):
                yield rep, s.tobytes(), signature(s, coefficients).astype(np.uint8).tobytes()

    return map_rows(texts, "rep long, shingles binary, wide binary", whole).dropDuplicates()


class Sets:
    """The sets of a tile in numbers of its own, so that one set is held against many by lookups."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) // 8 for x in raw])
        self.end = np.cumsum(self.size)
        self.flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1]
        self.marked = np.zeros(len(self.flat) + 1, bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.end[i] - self.size[i] : self.end[i]]

    def linked(self, a: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others with 100 * intersection >= percent * union."""
        n, sizes = self.size[a], self.size[others]
        # Too different in size to be linked whatever they share.
        others = others[100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)]
        if not len(others):
            return others
        sizes = self.size[others]
        self.marked[self.of(a)] = True
        both = np.add.reduceat(self.marked[np.concatenate([self.of(i) for i in others])].astype(np.int64), np.cumsum(sizes) - sizes)
        self.marked[self.of(a)] = False
        return others[100 * both >= percent * (n + sizes - both)]


def _wide(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["wide"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal coordinates of each row of x and each row of y."""
    out = np.empty((len(x), len(y)), np.int16)
    for at in range(0, len(x), 16):
        out[at : at + 16] = (x[at : at + 16, None, :] == y[None, :, :]).sum(axis=2)
    return out


_PAIRS = "a long, b long"


def hub_links(matches: int, percent: int):
    """Of a hub and some documents that meet it: the links between them."""

    def run(key: tuple, rows: pa.Table) -> list | None:
        hub, rep = key[0], rows["rep"].to_numpy()
        wide, sets = _wide(rows), Sets(rows["shingles"].to_pylist())
        found = []
        for h in np.flatnonzero(rep == hub):  # several if rows of the hub's id have different texts
            some = np.flatnonzero((wide == wide[h]).sum(axis=1) >= matches)
            found.append(rep[sets.linked(h, some[rep[some] != hub], percent)])
        b = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return [np.full(len(b), hub), b] if len(b) else None

    return run


def _sides(rows: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of the two blocks of a tile; one of them may have none."""
    if i == j:
        return np.arange(rows.num_rows), np.arange(rows.num_rows)
    block = rows["block"].to_numpy()
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _forest(rows: pa.Table, i: int, j: int, matches: int, group: np.ndarray, joined) -> list | None:
    """Pairs (a, b) of a tile, of different components and with enough collisions, as few as connect the groups that they connect.

    group: the group of each row at first. joined(a, places) gives those of places that a is paired with.
    """
    comp, rep = rows["comp"].to_numpy(), rows["rep"].to_numpy()
    left, right = _sides(rows, i, j)
    if not len(left) or not len(right) or (comp == comp[0]).all():
        return None
    wide = _wide(rows)
    found_a, found_b = [], []
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        if (group[right] == group[part[0]]).all() and (group[part] == group[part[0]]).all():
            continue  # nothing is left to connect
        good = (_equal(wide[part], wide[right]) >= matches) & (comp[part][:, None] != comp[right][None]) & (rep[part][:, None] != rep[right][None])
        for a, row in zip(part, good):
            some = right[row]
            some = some[group[some] != group[a]]
            for b in joined(a, some) if len(some) else ():
                if group[b] != group[a]:
                    group[group == group[b]] = group[a]
                    found_a.append(rep[a])
                    found_b.append(rep[b])
    return [np.array(found_a), np.array(found_b)] if found_a else None


def retained(matches: int):
    """Of a tile of a posting list: a spanning forest, over documents, of the pairs that are retained."""

    def run(key: tuple, rows: pa.Table) -> list | None:
        _, i, j = key
        return _forest(rows, i, j, matches, np.arange(rows.num_rows), lambda a, some: some)

    return run


def confirmed(matches: int, percent: int):
    """Of a tile of a cluster: a spanning forest, over components, of the links."""

    def run(key: tuple, rows: pa.Table) -> list | None:
        _, i, j = key
        comp, sets = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1], Sets(rows["shingles"].to_pylist())
        return _forest(rows, i, j, matches, comp, lambda a, some: sets.linked(a, some, percent))

    return run


def _tiles(rows: DataFrame) -> DataFrame:
    """rows(blocks, rep, ...) -> each row in every tile (i, j) of its block and another, i <= j."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", _numbers(F.col("blocks")))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def first_links(posts: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links of each document with its hub."""
    met = materialize(nearest_hubs(posts), "minhash-hubs")
    sizes = materialize(met.groupBy("hub").agg(F.count("*").alias("n")), "minhash-hub-sizes")
    # A hub of many documents is there once for each of their parts.
    members = met.join(small(sizes.filter(F.col("n") > BLOCK)), "hub", "left")
    members = members.select("rep", "hub", F.pmod(F.xxhash64("rep"), _part(F.coalesce("n", F.lit(1)), BLOCK)).alias("part"))
    hubs = sizes.select(F.col("hub").alias("rep"), "hub", _numbers(_part(F.col("n"), BLOCK)).alias("part"))
    rows = members.unionByName(hubs).join(sets, "rep").select("hub", "part", "rep", "shingles", "wide")
    links = materialize(map_groups(rows, ["hub", "part"], _PAIRS, hub_links(matches, percent)), "minhash-links")
    release(met, sizes)
    return links


def second_links(posts: DataFrame, sets: DataFrame, comps: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links between components of the first round."""
    of = comps.withColumnRenamed("node", "rep")
    now = posts.join(of, "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"), "token", _part(F.col("df"), BLOCK).alias("blocks"))
    now = materialize(now.withColumn("part", F.pmod(F.xxhash64("rep"), "blocks")), "minhash-posted")
    lists = now.groupBy("token", "blocks").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    now_open = now.join(lists.select("token", _numbers(F.col("blocks")).alias("part")), ["token", "part"], "left_semi").drop("part")
    wide = now_open.join(sets.select("rep", "wide"), "rep")
    near = materialize(map_groups(_tiles(wide), ["token", "i", "j"], _PAIRS, retained(matches)), "minhash-retained")
    clusters = components(near).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = clusters.join(of, "rep", "left").join(sets, "rep").select("cluster", "rep", F.coalesce("component", "rep").alias("comp"), "shingles", "wide")
    members = materialize(members, "minhash-clusters")
    long = members.groupBy("cluster").agg(F.sum(F.length("shingles")).alias("bytes")).filter(F.col("bytes") > BLOCK_BYTES)
    dealt = members.join(small(materialize(long, "minhash-long")), "cluster", "left").withColumn("blocks", _part(F.coalesce("bytes", F.lit(1)), BLOCK_BYTES)).drop("bytes")
    links = materialize(map_groups(_tiles(dealt), ["cluster", "i", "j"], _PAIRS, confirmed(matches, percent)), "minhash-links")
    release(now, near, members)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest): one row for each row of docs; digest is that of its shingle set."""
    matches, many = match_threshold(percent / 100), match_threshold(percent / 100, WIDE)
    signed = materialize(signatures(docs, words, id_col, text_col), "minhash-sets")
    distinct = signed.filter("digest is not null and doc_id is not null").groupBy("digest")
    sets = materialize(distinct.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("n")), "minhash-distinct")
    posted = posters(sets.select("rep", "sig"), matches)
    whole = materialize(full_sets(docs, posted, words, id_col, text_col), "minhash-shingles")
    posts = posted.select("rep", "common", F.explode("prefix").alias("post")).select("rep", "common", "post.token", "post.df")
    links = first_links(posts, whole, many, percent)
    first = materialize(components(links), "minhash-components")
    more = second_links(posts, whole, first, many, percent)
    comps = first
    if not more.isEmpty():  # of the first round, each node's component is all that's needed
        comps = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        comps = materialize(comps, "minhash-components")
        release(first)
    release(posted, whole, links, more)
    # Of each set, the component; of sets that stand alone, nothing. Documents of one set are dealt in SALTS parts.
    placed = sets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 or component is not null")
    placed = placed.select("digest", F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = signed.select("doc_id", "n_shingles", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    alone = dealt.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "digest")
    found = dealt.filter("digest is not null and doc_id is not null").join(placed, ["digest", "salt"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "digest").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "digest")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), words=3, percent=85).drop("digest")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without the documents that are near-duplicates of one with a smaller id.

    Of rows with equal id and text, the first by their other columns stays; rows that share an id but not their text all stay, as
    nothing says that their texts are alike. Columns of any name are carried along.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    key, text = names["doc_id"], names["text"]
    found = materialize(near_duplicates(docs.select("doc_id", "text"), words, percent), "minhash-kept")
    of_id = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("any"), F.count("*").alias("rows"))
    kept = plain.join(small(of_id.filter("not any").select(key)), key, "left_anti")
    again = of_id.filter("any and rows > 1").select(key)
    if not again.isEmpty():  # ids with several rows: each is judged by its own text
        again, at, row = small(again), list(names).index("text"), F.struct(*names.values())
        schema = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in docs.schema.fields)
        rows = map_rows(kept.join(again, key, "left_semi").select(*names.values()), f"{schema}, own binary", lambda rows: ((*r, digest_of(shingle_set(r[at], words))) for r in rows))
        rows = rows.join(found.filter("not kept").select(F.col("doc_id").alias(key), F.col("digest").alias("own")), [key, "own"], "left_anti")
        rows = rows.groupBy(key, F.sha2(text, 256)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        kept = kept.join(again, key, "left_anti").select(*names.values()).unionByName(rows)
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
