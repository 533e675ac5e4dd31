"""Operators that look at rows together, against brute force on small tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, hamming_search, minhash_dedup, mixing, quality
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = smallest_reachable({x for a, b in links if a != b for x in (a, b)}, links)
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingled(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = [f"w{i}é" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 150))) for _ in range(15)]
    out = [None, "", " \t", "one", "One", "one two", "ONE TWO", "one\u00a0two"]
    for b in base:
        out.append(b)
        for _ in range(rng.choice([0, 1, 3, 40])):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    out += [base[0]] * 30 + [base[0].upper()]
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, k, percent, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)  # so that small lists are dealt in blocks too
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(3)
    found = {r.doc_id: r for r in minhash_dedup.near_duplicates(df, k, percent).collect()}
    sets = [shingled(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    expected = smallest_reachable(range(len(texts)), links)
    for i, s in enumerate(sets):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(s), expected[i], expected[i] == i)


def test_rows_grow_with_members_of_a_group_without_links(spark, monkeypatch):
    """Documents of one template, most of them just not similar enough."""
    base = [f"t{i}" for i in range(200)]
    seen = []
    plain = minhash_dedup.map_groups
    monkeypatch.setattr(minhash_dedup, "map_groups", lambda df, *rest: (seen.append(df.count()), plain(df, *rest))[1])

    def run(n):
        rng = random.Random(9)
        texts = []
        for i in range(n):
            w = list(base)
            for at in rng.sample(range(4, 196, 4), 4):  # two of them share 174 of 222 shingles
                w[at] = f"own{i}x{at}"
            texts.append(" ".join(w))
        seen.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, 3, 85).collect()}
        sets = [shingled(t, 3) for t in texts]
        links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert found == smallest_reachable(range(n), links) and len(links) < n
        return sum(seen)

    assert run(600) <= 2.2 * run(300)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", "", "", 1), (1, "a b c d e f", "", "", 1), (None, "a b c d e f", "", "", 1), (2, "a b c d e f", "", "", 1), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    found = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert found == [(0, None, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert sorted((r.doc_id or 0) for r in minhash_dedup.keep_one(df).collect()) == [0, 1, 3]
    # One id with texts that aren't alike: all stay, of equal rows the first by other columns.
    rows = [(1, "a b c d e f", "y", "", 1), (1, "a b c d e f", "x", "", 1), (1, "quite another text it is", "z", "", 1), (2, "a b c d e f", "", "", 1)]
    rows += [(3, "a b c d e f", "copy", "", 1), (3, "and a text of its own", "own", "", 1), (3, None, "null", "", 1)]
    wide = spark.createDataFrame(rows, schema).selectExpr("*", "1 as rep", "2 as _c0", "map(1, 2) as salt")
    kept = minhash_dedup.keep_one(wide)
    assert kept.columns == wide.columns and sorted((r.doc_id, r.lang, r.rep) for r in kept.collect()) == [(1, "x", 1), (1, "z", 1), (3, "null", 1), (3, "own", 1)]
    long = spark.createDataFrame([(1, "w " * 200_000), (2, "w " * 200_001), (3, "v" * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(long).collect()} == {1: 1, 2: 1, 3: 3}


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.08 * rng.standard_normal((30, 16)), base[:1] + 0.02 * rng.standard_normal((50, 16)), np.repeat(base[2:3], 25, axis=0)]).astype(np.float32)
    labels = [None if i == 7 else i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), labels[i]) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, [float("inf")] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in embedding_dedup.linked(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(n) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and u[i] @ u[j] >= 0.93]
    expected = smallest_reachable(range(n + 7), links)
    count = np.bincount(np.array(links).ravel(), minlength=n + 7)
    assert len(links) > 500
    for i in range(n + 7):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (count[i], expected[i], expected[i] == i)
    assert embedding_dedup.linked(df.limit(0)).count() == 0
    # Doubles, repeated rows, a null id, and extra columns with names used inside.
    rows = [(1, [1.0, 1e-9], 0, "x"), (1, [1.0, 1e-9], 0, "x"), (None, [1.0, 0.0], 0, "x"), (2, [1.0, 0.3], 0, "x"), (3, [1.0, 0.5], 0, "x")]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, leaf string").withColumnRenamed("leaf", "n_links")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.linked(odd).collect())
    assert found == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 3, 1), (3, 1, 1)]


def test_trees_are_as_many_as_their_depth_needs():
    assert embedding_dedup.trees_for(0) == 1
    for depth in (1, 3, 10, 40):
        parted = 1 - (1 - embedding_dedup.PARTED) ** depth
        assert parted ** embedding_dedup.trees_for(depth) <= embedding_dedup.MISSED


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (5000, 8), dtype=np.uint16)
    near = codes[:50] ^ np.uint16(1 << 3)
    block = hamming_search.Block(np.concatenate([codes, near]), 1)
    every = np.concatenate([codes, near])
    for q in codes[:50]:
        away = np.bitwise_count(q ^ every)
        found = block.retrieved(q, 1)
        # Exactly the codes with a substring within the radius; by the pigeonhole principle, all that differ in 15 bits at most.
        assert found.tolist() == np.flatnonzero(away.min(axis=1) <= 1).tolist()
        assert set(np.flatnonzero(away.sum(axis=1) < 2 * 8)) <= set(found.tolist())
    assert len(block.retrieved(codes[0], 4000)) >= 4000 and len(block.retrieved(codes[0], 10_000)) == 5050


def test_search_probes_a_part_of_random_vectors():
    """The registered table, whose vectors are close to random: the calibrated radius visits a part, and nearly all neighbours."""
    import duckdb

    from tidemark.llm.vectors import unit

    x = np.array([v for (v,) in duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()], float)
    u = unit(x)
    codes = hamming_search.fit(u)
    assert codes.radius <= 3
    coded = codes.encode(u)
    block = hamming_search.Block(coded, codes.radius)
    share, hits = 0.0, 0
    for k in range(0, len(u), 50):
        found = block.retrieved(coded[k], 6)
        s = u @ u[k]
        s[k] = -2
        hits += len(set(found.tolist()) & set(np.argsort(-s)[:5].tolist()))
        share += len(found) / len(u)
    n = len(range(0, len(u), 50))
    assert share / n < 0.35 and hits / (5 * n) >= 0.9


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[100:110] = x[100]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    rows = hamming_search.search(df, df.filter("vec_id % 50 = 0")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(got[q]) & set(np.lexsort((np.arange(3000), -np.round(s, 12)))[:5].tolist()))
        assert len(got[q]) == 5
    assert hits / 300 >= 0.9
    assert got[100] == [101, 102, 103, 104, 105]
    few = hamming_search.search(df.limit(3), df.limit(1)).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]
    assert hamming_search.search(df.limit(0), df.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(6)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    chances = [rng.random() for _ in sizes]
    out = mixing.flight(sizes, chances, rng)
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(chances)) < 1e-6 and abs(sum(s * p for s, p in zip(sizes, out)) - sum(s * p for s, p in zip(sizes, chances))) < 1e-3
    landed = mixing.flight_and_landing(sizes, chances, random.Random(1))
    assert set(landed) <= {0.0, 1.0}
    assert abs(sum(s * p for s, p in zip(sizes, landed)) - sum(s * p for s, p in zip(sizes, chances))) < 20


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(7)
    rows = [(i, rng.choice(["b", "a", "é", None, "hot", "hot", "hot"]), rng.randint(0, 300), 5) for i in range(900)] + [(1, "a", 10, 5)] * 3
    clashing = ("order", "rank", "docs", "shard", "chance", "weight", "level", "place", "_rate", "copies", "_c0")
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, order int").select("*", *(F.lit(i).alias(c) for i, c in enumerate(clashing[1:])))
    assert mixing.copies(df).columns == ["doc_id", "source", "size", *(c for c in clashing if c != "copies"), "source_size", "target", "copies"]
    assert {(r.order, r["rank"], r._c0) for r in mixing.copies(df).collect()} == {(5, 0, 9)}
    one, two = (sorted(map(tuple, mixing.copies(df).select("doc_id", "source", "size", "source_size", "target", "copies").collect()), key=repr) for _ in range(2))
    assert one == two and len(one) == len(rows)
    total = {}
    for _, s, n, _ in rows:
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda x: (x is None, x))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    capped, left = {}, names
    while True:
        level = (1.5 * sum(total.values()) - sum(capped.values())) / sum(weight[n] for n in left)
        over = [n for n in left if level * weight[n] > 2 * total[n]]
        if not over:
            break
        capped |= {n: 2 * total[n] for n in over}
        left = [n for n in left if n not in capped]
    for n in names:
        own = [r for r in one if r[1] == n]
        assert own[0][3] == total[n] and abs(own[0][4] - capped.get(n, level * weight.get(n))) < 1e-6
        assert abs(sum(r[2] * r[5] for r in own) - own[0][4]) < 30 and all(0 <= r[5] <= 2 for r in own)
    assert mixing.copies(df.limit(0)).count() == 0


def test_many_sources_have_running_levels(spark):
    """Ranks and levels without a window over all sources in one task."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(10**6):06d}é", rng.randint(0, 50)) for _ in range(500)]
    found = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total = {}
    for s, n in rows:
        total[s] = total.get(s, 0) + n
    names = sorted(total)
    assert [found[n]["rank"] for n in names] == list(range(len(names)))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    free, capped = list(names), {}
    while True:
        level = (1.5 * sum(total.values()) - sum(capped.values())) / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 2 * total[n]]
        if not over:
            break
        capped |= {n: 2 * total[n] for n in over}
        free = [n for n in free if n not in capped]
    assert all(abs(found[n].target - capped.get(n, level * weight[n])) < 1e-6 for n in names)


def test_mixed_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "w " * (i % 9 + 1), "en", "ab"[i % 2], 2) for i in range(60)] + [(7, "twice", "en", "a", 5)] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = mixing.mix_documents(df).collect()
    taken = mixing.copies(mixing.sized(df).select("doc_id", "source", "size")).agg({"copies": "sum"}).first()[0]
    assert len(out) == taken and out[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    assert mixing.mix_documents(df.limit(0)).count() == 0
    hot = spark.createDataFrame([(1, "w w w", "en", "a", 5)] * 9000 + [(i, "v " * 40, "en", "b", 80) for i in range(2, 9)], schema)
    from collections import Counter

    taken = Counter(r.doc_id for r in mixing.mix_documents(hot).collect())
    assert abs(3 * taken[1] - mixing.targets(mixing.sized(hot).select("source", "size")).filter("source = 'a'").first().target) < 100
    clash = df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("size", "key", "copies", "turn", "stats", "score", "all"))))
    assert mixing.mix_documents(clash).columns == clash.columns
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.keep_good(clash, labels).columns == clash.columns


def test_quality_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    measured = quality.with_statistics(df).select(F.col("doc_id").alias("id"), "stats").cache()
    model = quality.fit(measured, quality.learnable(labels))
    score = {r.id: r.score for r in quality.scored(measured, model).collect()}
    held = [(score[r.doc_id] >= quality.THRESHOLD) == bool(r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in score.values())


def independent_scores(x, labelled, y):
    """The discriminant again, from its definition: densities by determinants and solved systems, class by class."""
    common = sum((labelled[y == k] - labelled[y == k].mean(axis=0)).T @ (labelled[y == k] - labelled[y == k].mean(axis=0)) for k in (0, 1)) / len(labelled)
    common = common + np.eye(x.shape[1]) * (1e-6 + 1e-3 * np.trace(common) / x.shape[1])
    density = []
    for k in (0, 1):
        own = labelled[y == k]
        cov = (1 - quality.POOLED) * np.cov(own.T, bias=True) + quality.POOLED * common
        cov = (1 - quality.DIAGONAL) * cov + quality.DIAGONAL * np.diag(np.diag(common))
        d = x - own.mean(axis=0)
        density.append(np.log(len(own) / len(labelled)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d * np.linalg.solve(cov, d.T).T).sum(axis=1))
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def test_registered_scores_are_the_discriminants(spark):
    import duckdb

    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    labels = {i: q for i, q in duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall() if q is not None and zlib.crc32(str(i).encode()) % 4 != 2 and i in docs}
    stats = {i: np.array(quality.statistics(t)) for i, t in docs.items()}
    expected = independent_scores(np.array(list(stats.values())), np.array([stats[i] for i in labels]), np.array(list(labels.values())))
    found = {r.doc_id: r.score for r in quality.op5_quality_classifier(spark, SF).collect()}
    assert found.keys() == docs.keys()
    for i, s in zip(stats, expected):
        assert abs(found[i] - s) < 1e-6


def test_quality_of_odd_tables(spark):
    texts = [None, "", " ", "x", "!" * 10000, "a b " * 5000, "\ud7ff\U0001f600"]
    assert all(np.isfinite(quality.statistics(t)).all() for t in texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    measured = quality.with_statistics(df)
    none = spark.createDataFrame([], "id long, quality int")
    model = quality.fit(measured, none)
    assert {r.score for r in quality.scored(measured, model).collect()} == {0.5}
    assert quality.scored(measured.limit(0), model).count() == 0
    clash = quality.scored(quality.with_statistics(df.selectExpr("*", "'mine' as stats", "'mine' as score", "7 as quality")), model)
    assert clash.columns == ["id", "text", "quality", "score"] and {(r.quality, r.score) for r in clash.collect()} == {(7, 0.5)}
    assert quality.from_moments(np.array([0.0, 5.0]), np.zeros((2, 3)), np.zeros((2, 3, 3))).constant == 1.0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_dedup", "secret_scans", "mixing", "byte_bpe"]
    assert corpus_pipeline.quality_classifier(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and extra columns with clashing names."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "A plain sentence of some length that is written, as they are, with care. "
    rows = [(i, text * (i % 4 + 1) + str(i), "en", "ab"[i % 2], 9) for i in range(40)] + [(1, text * 2 + "1", "en", "b", 9)] * 3
    rows += [(None, None, None, None, None), (100, "", "en", None, 0), (101, None, None, "a", None), (102, "word " * 50_000, "en", "a", 1), (103, "x" * 100_000, "en", "a", 1), (None, text, "en", "a", 1)]
    plain = spark.createDataFrame(rows, schema)
    extra = [F.lit(i).alias(c) for i, c in enumerate(("stats", "score", "size", "key", "id", "copies", "_c0", "rep", "kept", "all", "part"))]
    for docs in (plain, plain.limit(0), plain.select("*", *extra)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            count = out.count()
            assert count == n if name == "secret_scans" else count <= 2 * n if name == "mixing" else count <= n
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == n
