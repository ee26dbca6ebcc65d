"""Operators that deal rows into blocks, salts or components, and what is trained or stored, against plain versions."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from strand.operators import coref, embed, fivew, graph, threads, training
from strand.sources import stored
from strand.streaming import jobs


def vectors(spark, n=60, dims=6, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims))
    return v, spark.createDataFrame([(0, k, x.tolist(), float(k)) for k, x in enumerate(v)], "part int, pos long, vec array<double>, ts double")


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def test_nearest_neighbours(spark):
    v, rows = vectors(spark)
    c = np.round(1 - cosines(v), 9)
    np.fill_diagonal(c, np.inf)
    want = {(i, int(j), k + 1) for i in range(len(v)) for k, j in enumerate(np.argsort(c[i], kind="stable")[:4])}
    assert {(r.src, r.dst, r.k) for r in graph.nearest_neighbours(rows, 4, block=16).collect()} == want


def test_edges_of_a_batch_and_its_history(spark):
    v, rows = vectors(spark)
    c = np.round(1 - cosines(v), 9)
    got = jobs.cross_edges(rows.filter("pos % 3 = 0"), rows.filter("pos % 3 <> 0"), 0.8, block=16).collect()
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if c[i, j] < 0.8 and (i % 3 == 0 or j % 3 == 0)}
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)


def test_sparse_cosine(spark):
    rng = random.Random(2)
    terms = [(f"d{i}", t) for i in range(60) for t in [*(f"common{rng.randrange(3)}" for _ in range(8)), *(f"rare{rng.randrange(40)}" for _ in range(4))]]
    weights = threads.tf_idf(spark.createDataFrame(terms, "doc string, term string"), max_df=1.0)
    rows = defaultdict(dict)
    for r in weights.collect():
        rows[r.doc][r.term] = r.w
    dot = lambda a, b: sum(x * rows[b].get(t, 0) for t, x in rows[a].items())
    for limit in (0.2, 0.6):
        want = {(a, b): dot(a, b) for a, b in itertools.combinations(sorted(rows), 2) if round(dot(a, b), 9) > limit}
        assert {(r.src, r.dst): r.c for r in threads.sparse_cosine(weights, limit).collect()} == pytest.approx(want, abs=1e-8)
    assert threads.sparse_cosine(weights, 0.2, include_self=True).filter("src = dst").count() == len(rows)


def test_shared_entities_of_a_hot_one(spark):
    rng = random.Random(3)
    own = {(d, 0) for d in range(50)} | {(rng.randrange(50), rng.randrange(1, 20)) for _ in range(150)}
    by = defaultdict(set)
    for d, e in own:
        by[d].add(e)
    want = {(a, b): len(by[a] & by[b]) for a, b in itertools.combinations(sorted(by), 2) if by[a] & by[b]}
    got = graph.shared_entities(spark.createDataFrame(sorted(own), "doc long, entity long"), hot_from=7)
    assert {(r.src, r.dst): r.shared for r in got.collect()} == want


def test_claims_with_a_minimum(spark):
    rng = random.Random(5)
    rows = sorted({(t, o, f"d{rng.randrange(60)}") for t in range(40) for o in range(rng.randrange(1, 5))})
    taken, want = set(), set()
    for t in range(40):
        new = {}
        for _, o, d in (r for r in rows if r[0] == t):
            if d not in taken and d not in new:
                new[d] = o
        if len(new) >= 2:
            taken |= set(new)
            want |= {(t, d) for d in new}
    got = threads.first_wins_min_length(spark.createDataFrame(rows, "thread_id long, ord int, doc_id string"), 2)
    assert {(r.thread_id, r.doc_id) for r in got.collect()} == want


def test_louvain_finds_cliques(spark):
    edges = [(0, a, b, 1.0) for g in (range(5), range(5, 10)) for a, b in itertools.combinations(g, 2)] + [(0, 4, 5, 0.1)]
    got = {r.node: r.comm for r in graph.louvain(spark.createDataFrame(edges, "part int, src long, dst long, d double")).collect()}
    assert got == {n: 0 if n < 5 else 5 for n in range(10)}


def test_latent_semantics(spark):
    rng = np.random.default_rng(6)
    a = rng.random((30, 3)) @ rng.random((3, 25))  # of rank 3
    rows = spark.createDataFrame([(f"d{i:02}", f"t{j}", float(a[i, j])) for i in range(30) for j in range(25)], "doc string, term string, w double")
    got = np.array([r.vec for r in embed.lsa(rows, 3, oversample=4).orderBy("doc").collect()])
    assert np.allclose(got @ got.T, cosines(a), atol=1e-6)


def test_slopes_are_those_of_the_losses(spark):
    rng = np.random.default_rng(7)
    rows = [(d, m, a, int(g), float(c), float(f)) for d in range(3) for m in range(4) for a, g, c, f in zip(range(-1, 4), rng.permutation([1, 1, 0, 0, 0]), rng.random(5), rng.standard_normal(5), strict=True)]
    df = spark.createDataFrame(rows, "doc int, men int, ant int, gold int, cost double, f double").cache()
    for stage in training.STAGES:
        loss = lambda w: df.withColumn("score", w * df["f"]).select(training._slopes(stage)[0].alias("x")).agg({"x": "sum"}).first()[0]  # noqa: B023, E731
        loss_column, slope = training._slopes(stage)
        found = df.withColumn("score", 0.3 * df["f"]).withColumn("slope", slope).selectExpr("sum(slope * f)").first()[0]
        assert found == pytest.approx((loss(0.3 + 1e-5) - loss(0.3 - 1e-5)) / 2e-5, rel=1e-3, abs=1e-4)


def test_training_learns_the_rule(spark):
    rng = np.random.default_rng(8)
    rows = [(0, m, a, int(e), int(e), int(rng.integers(2))) for m in range(1, 40) for a in range(m) for e in [rng.random() < 0.3]]
    names = ("exact", "noise")
    pairs = spark.createDataFrame(rows, "doc int, men int, ant int, gold int, exact int, noise int")
    data = training.training_rows(pairs, names).cache()
    model = training.train_scorer(data, names, {"all_pairs": 12, "top_pairs": 4, "ranking": 4})
    first, last = model.history[0], [h for h in model.history if h[0] == "all_pairs"][-1]
    assert last[2] < 0.8 * first[2] and model.weights[0] > 1 and abs(model.weights[1]) < 0.5 * model.weights[0]
    assert data.filter("ant = -1").count() == 39


def test_overlapping_ranges(spark):
    rng = random.Random(9)
    span = lambda: (s := rng.randrange(400), s + rng.randrange(1, 90))
    a, b = [(0, k, *span()) for k in range(40)], [(0, k, *span()) for k in range(40)]
    left, right = spark.createDataFrame(a, "g int, x int, b int, e int"), spark.createDataFrame(b, "g int, y int, b int, e int")
    got = [(r.x, r.y) for r in coref.overlapping(left, right, ["g"], width=32).collect()]
    assert sorted(got) == sorted((x, y) for _, x, p, q in a for _, y, s, t in b if p < t and s < q)


def test_stored_files(spark, tmp_path):
    url, cache = f"file://{tmp_path}/a.txt", f"file://{tmp_path}/cache"
    stored.put_bytes(spark, url, b"one")
    first = stored.cached_path(spark, url, cache)
    assert stored.cached_path(spark, url, cache) == first and stored.entry_source(spark, first)[0] == url
    stored.put_bytes(spark, url, b"three")
    second = stored.cached_path(spark, url, cache)
    assert second != first and [spark.read.text(p).first()[0] for p in (first, second)] == ["one", "three"]
    layers = [(np.arange(6.0).reshape(2, 3), np.ones(3)), (np.ones((3, 1)), np.zeros(1))]
    stored.save_model(spark, f"file://{tmp_path}/model", layers, spark.createDataFrame([("w", [1.0])], "word string, vec array<double>"), {"greedyness": 0.5})
    found, words, settings = stored.load_model(spark, f"file://{tmp_path}/model")
    assert all(np.array_equal(x, y) for a, b in zip(layers, found, strict=True) for x, y in zip(a, b, strict=True)) and words.count() == 1 and settings == {"greedyness": 0.5}


def test_constituents():
    tokens = fivew.annotate("The old house stands in New York (since 1900).")
    tree = fivew.chunk_tree(tokens)
    assert tree.count("(") == tree.count(")") and "(PP (NN in) (NP (NNP New) (NNP York)" in tree and "-LRB-" in tree
