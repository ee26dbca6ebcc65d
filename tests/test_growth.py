"""Steps whose work must grow with their input: how often rows are sent, and results against plain versions."""

import numpy as np
import pandas as pd
import pytest

from strand import registry
from strand.operators import cluster, embed, graph, sparse, threads
from strand.plans import runs
from tests.test_scale import cosines, vectors


def test_rows_go_to_a_fixed_number_of_tiles(spark):
    v, rows = vectors(spark, 200)
    assert graph._tiles(rows, 1).select("own").distinct().count() <= graph.TILES
    c = np.round(1 - cosines(v), 9)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if c[i, j] < 0.6}
    got = [(r.src, r.dst) for r in graph.blocked_edges(rows, 0.6, block=3).collect()]
    assert len(got) == len(want) and set(got) == want
    near = {(r.src, r.dst) for r in graph.nearest_neighbours(rows, 3, block=5).collect()}
    np.fill_diagonal(c, np.inf)
    assert near == {(i, int(j)) for i in range(200) for j in np.argsort(c[i], kind="stable")[:3]}


def test_percentiles_by_cells(spark):
    x = np.round(np.random.default_rng(1).random(3001) * 0.7, 9)
    edges = spark.createDataFrame(pd.DataFrame({"d": np.concatenate([x, x[:500]])}))
    ranks = (0.0, 0.25, 0.3, 0.75, 1.0)
    assert graph.distance_percentiles(edges, ranks) == pytest.approx(np.quantile(np.concatenate([x, x[:500]]), ranks), abs=1e-12)
    assert graph.distance_percentiles(edges.limit(0), ranks) == [None] * 5


def test_parts_of_different_sizes_get_their_own_number_of_threads(spark):
    _, rows = vectors(spark, 36)
    rows = rows.selectExpr("if(pos < 30, 0, 1) as part", "pos", "cast(pos as string) as doc_id", "timestamp_seconds(pos) as created", "ts", "vec")
    found = runs.seqint(rows, clusters_per_item=5).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in found} == {0: 6, 1: 1}


def test_equal_ranges_are_compared_once(spark, tmp_path):
    k = [*range(1, 400), 7, 7, None]
    pd.DataFrame({"c_custkey": pd.array(k, "Int64"), "c_nationkey": pd.array([i % 3 for i in range(len(k))], "Int64")}).to_parquet(tmp_path / "customer.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    from strand.queries import coref as q

    for name in ("JOIN13_box_entailment", "JOIN14_interval_entailment"):
        got = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall()), name
    b = spark.range(1000).selectExpr("id as k", "0 as g", "id % 5 as x", "id % 5 + 1 as y")
    assert q._classes_within(b).count() == 5


def test_corpus_files_are_read_by_document(spark, tmp_path):
    from strand.sources import documents as D

    doc = lambda name, word: f"#begin document ({name}); part 000\n{name}\t000\t0\t{word}\t(1)\n\n{name}\t000\t0\tb\t-\n\n#end document\n"
    (tmp_path / "x.auto_conll").write_text(doc("x", "no"))
    (tmp_path / "x.gold_conll").write_text("".join(doc(f"d{k}", "yes") for k in range(50)))
    rows = D.read_conll(spark, f"file://{tmp_path}", rows=7)
    assert sorted((r.doc, r.utt, r.tok, r.word) for r in rows.collect()) == sorted((f"d{k}", u, 0, w) for k in range(50) for u, w in ((0, "yes"), (1, "b")))
    assert "wholetext" not in rows._jdf.queryExecution().toString() and spark.read.text(str(tmp_path), lineSep="\n#end document").filter("value like '%begin%'").count() == 51


def test_annotations_are_handed_on_in_slices():
    from strand.operators import fivew

    batch = pd.DataFrame({"doc_id": list("abcdef"), "text": ["x" * 40, None, "y" * 70, "z", "", "w" * 500]})
    parts = list(fivew._slices(iter([batch]), chars=100))
    assert len(parts) == 3 and pd.concat(parts)["doc_id"].tolist() == list("abcdef")


def test_weights_of_passages_where_they_stand(spark, monkeypatch):
    rows = [("a", "x y y z"), ("b", "x z z z"), ("c", "x q"), ("c", "q r"), ("d", "")]
    terms = spark.createDataFrame([(d, t.split(" ")) for d, t in rows], "doc string, terms array<string>")
    plain = terms.selectExpr("doc", "explode(terms) as term").filter("term <> ''")
    for kind in ({"max_df": 0.7}, {"max_terms": 3}):
        want = {(r.doc, r.term): r.w for r in threads.tf_idf(plain, **kind).collect()}
        assert {(r.doc, r.term): r.w for r in threads.passage_weights(terms, **kind).collect()} == pytest.approx(want)
        monkeypatch.setattr(threads, "VOCABULARY", 1)
        assert {(r.doc, r.term): r.w for r in threads.passage_weights(terms, **kind).collect()} == pytest.approx(want)
        monkeypatch.undo()
    own = plain.selectExpr("if(doc = 'a', 1, 2) as thread_id", "doc", "term")
    weights = threads.tf_idf(plain)
    want = {(r.thread_id, r.word): (r.rank, r.score) for r in threads.keywords(own, weights).collect()}
    docs = own.select("thread_id", "doc").distinct().groupBy("thread_id").count().withColumnRenamed("count", "n")
    got = threads.keywords_of_passages(weights.selectExpr("if(doc = 'a', 1, 2) as thread_id", "doc", "term", "w"), docs)
    assert {(r.thread_id, r.word): (r.rank, r.score) for r in got.collect()} == want
    assert "Window" not in threads.passage_weights(terms)._jdf.queryExecution().toString()


def test_expression_edges_are_many_tasks(spark):
    v, rows = vectors(spark, 120)
    c = np.round(1 - cosines(v), 9)
    got = [(r.src, r.dst) for r in graph.expression_edges(rows, 0.6, block=16).collect()]
    assert sorted(got) == [(i, j) for i in range(120) for j in range(i + 1, 120) if c[i, j] < 0.6]
    assert graph._tile_pairs(graph._tiles(rows, 16), None).filter("own = i").count() == 36


def test_sparse_cosine_reads_the_whole_vocabulary():
    sql = registry.oracle_sql()["VEC06_sparse_cosine"]
    assert "0.01 * n" not in sql and "0.9 * n" in sql


def test_complete_linkage_without_matrices(spark):
    v, rows = vectors(spark, 150)
    c = np.round(1 - cosines(v), 9)
    edges = graph.blocked_edges(rows, 0.7, block=32)
    want = cluster.cut(150, cluster.merges(np.where(c < 0.7, c, 1.0)), height=1.0)
    for task_links in (0, 300, 10**6):
        got = {r.node: r.label for r in cluster.complete(edges, task_links).collect()}
        assert got == {k: int(want[k]) for k in got} and len(got) == ((c < 0.7).sum(1) > 1).sum()
    ties = spark.createDataFrame([(a, b, 0.5) for a in range(6) for b in range(a + 1, 6)] + [(7, 8, 0.1), (8, 9, 0.1)], "src long, dst long, d double")
    assert all({r.node: r.label for r in cluster.complete(ties, k).collect()} == {**dict.fromkeys(range(6), 0), 7: 7, 8: 7, 9: 9} for k in (0, 100))
    assert cluster.complete(ties.limit(0)).count() == 0


def test_entities_of_edges_make_no_pairs(spark):
    rng = np.random.default_rng(11)
    own = sorted({(int(d), int(e)) for d in range(40) for e in ([0] if d < 12 else rng.integers(0, 25, 1 + d % 2))})
    incidence = spark.createDataFrame(own, "doc long, entity long")
    pairs = [(a, b) for a in range(42) for b in range(a + 1, 42) if rng.random() < 0.3]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    shared = {(r.src, r.dst): r.shared for r in graph.shared_entities(incidence).collect()}
    far = [p for p in pairs if p not in shared]
    hops = {(r.src, r.dst): r.hops for r in graph.passage_hops(incidence, spark.createDataFrame(far, "src long, dst long"), 3).collect()}
    got = {(r.src, r.dst): (r.shared, r.hops) for r in graph.edge_entities(edges, incidence, 3).collect()}
    assert got == {p: (shared.get(p, 0), hops.get(p)) for p in pairs} and len(set(hops.values())) > 2
    assert graph._entity_classes(incidence).filter("doc < 12 and class = 0").count() == 12


def test_latent_semantics_of_rows_that_stay(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [(f"d{i:02}", [f"t{i % 3}{j}" for j in rng.integers(0, 9, 12)] + ["all", ""]) for i in range(30)] + [("none", ["all"])]
    terms = spark.createDataFrame(texts, "doc string, terms array<string>")
    want = {r.doc: np.array(r.vec) for r in embed.vectorise(terms.selectExpr("doc", "explode(terms) as term").filter("term <> ''"), 3).collect()}
    for _ in range(2):
        got = {r.doc: np.array(r.vec) for r in embed.vectorise_passages(terms, 3).collect()}
        assert got.keys() == want.keys() and "none" not in got
        assert all(abs(got[a] @ got[b] - want[a] @ want[b]) < 1e-6 for a in got for b in got)
        monkeypatch.setattr(threads, "VOCABULARY", 1)
    monkeypatch.undo()
    assert "Join" not in embed.vectorise_passages(terms, 3)._jdf.queryExecution().toString()


def test_communities_need_few_edges(spark, monkeypatch):
    _, rows = vectors(spark, 150)
    monkeypatch.setattr(graph, "TILES", 2)  # of many blocks
    edges, few = graph.blocked_edges(rows, 0.7, block=8).cache(), graph.blocked_edges(rows, 0.7, block=8, parents=True).cache()
    assert few.exceptAll(edges).count() == 0 and few.count() < edges.count() / 2
    n = few.groupBy("src", "dst").count().count()
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(graph.nearest_parents(few)) == as_set(graph.nearest_parents(edges))
    ends = lambda df: as_set(df.selectExpr("explode(array(src, dst))"))
    assert ends(few) == ends(edges) and n == few.count()
    found = spark.createDataFrame([(0, k, k % 40) for k in range(150)], "part int, node long, comm long")
    own = threads.thread_members(found, rows.selectExpr("*", "cast(pos as string) as doc_id", "timestamp_seconds(pos) as created")).cache()
    walked = threads.step_edges(own, 0.7)
    assert as_set(threads.is_path(own, walked)) == as_set(threads.is_path(own, edges))
    score = lambda e: sorted((r[0], None if r[1] is None else round(r[1], 8)) for r in threads.path_score(own, e).collect())
    assert score(walked) == score(edges)


def test_a_later_graph_of_the_same_edges_is_laid_over_without_a_shuffle(spark):
    rows = [(a, b, 0.1 * a) for a in range(5) for b in range(a + 1, 5)]
    edges = spark.createDataFrame(rows, "src long, dst long, d double")
    got = graph.recomposed(edges, edges["src"] % 2 == 0, edges["src"] * 0 + 1.0)
    assert sorted(tuple(r) for r in got.collect()) == [(a, b, 1.0 if a % 2 == 0 else d) for a, b, d in rows]
    plan = registry.queries()["SET01_graph_compose"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "max_by" not in plan


def test_sparse_cosines_shuffle_rows_and_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [[f"common{k}" for k in rng.integers(0, 4, 6)] + [f"rare{k}" for k in rng.integers(0, 60, 4)] for _ in range(50)]
    texts = [(f"d{i:02}", t) for i, t in enumerate(texts + [texts[7]] * 9 + [texts[3][::-1]])]  # copies, and one in another order
    rows = threads.passage_rows(spark.createDataFrame(texts, "doc string, terms array<string>"), max_df=1.0).cache()
    vec = {r.doc: dict(zip(r.terms, r.w, strict=True)) for r in rows.collect()}
    c = {(a, b): round(sum(x * vec[b].get(t, 0) for t, x in vec[a].items()), 9) for a in vec for b in vec if a <= b}
    want = {p: x for p, x in c.items() if x > 0.3}
    for name, value in {"RIGHT": 16, "COPIES": 4, "HANDED": 20}.items():
        monkeypatch.setattr(sparse, name, value)
    assert sparse.equal_rows(rows).count() == 49 + 3 and sparse._met(sparse.equal_rows(rows))._df.count() == 4 * 52
    for own in (False, True):
        found = sparse.cosine_pairs(rows, 0.3, own)
        got = {(r.src, r.dst): r.c for r in found.collect()}
        assert got == pytest.approx({p: x for p, x in want.items() if own or p[0] != p[1]}, abs=2e-9) and found.count() == len(got)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan
    ends = [(n, x) for p, x in want.items() for n in p]
    degrees = {r.node: (r.degree, r.weighted) for r in sparse.cosine_degrees(rows, 0.3).collect()}
    assert degrees.keys() == vec.keys()
    assert all(d == (sum(n == m for m, _ in ends), pytest.approx(sum(x for m, x in ends if n == m), abs=1e-7)) for n, d in degrees.items())
    monkeypatch.setattr(sparse, "LEFT", 7)
    left = sparse._Tile([pd.DataFrame({"row": k, "docs": [[d] for d in k], "t": [[hash(t) for t in vec[d]] for d in k], "w": [list(vec[d].values()) for d in k]}) for k in [list(vec)]])
    found = [(left.row[i], left.row[j]) for x, y, _ in sparse._products(left, left, True, 0.3) for i, j in zip(x, y, strict=True)]
    assert len(found) == len(set(found)) and {tuple(sorted(p)) for p in found} == {p for p in want if p[0] != p[1]}


def test_louvain_of_a_large_part_is_spread(spark, monkeypatch):
    rng = np.random.default_rng(8)
    ends = [(a, b) for a in range(80) for b in range(a + 1, 80)]
    rows = [(p, p * 100 + a, p * 100 + b, 1.0 if a // 10 == b // 10 else 0.01) for p in (1, 2) for a, b in ends if a // 10 == b // 10 or rng.random() < 0.1]
    rows += [(0, a, b, 1.0) for a, b in ((1, 2), (2, 3), (7, 8))]
    edges = spark.createDataFrame([(p, int(a), int(b), d) for p, a, b, d in rows], "part int, src long, dst long, d double")
    want = {(p, p * 100 + k): p * 100 + k // 10 * 10 for p in (1, 2) for k in range(80)} | {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 7): 7, (0, 8): 7}
    kept = []
    level = graph._spread_level
    monkeypatch.setattr(graph, "_spread_level", lambda *a: kept.append(level(*a)) or kept[-1])
    for most in (10**6, 100):
        monkeypatch.setattr(graph, "LOUVAIN_EDGES", most)
        assert {(r.part, r.node): r.comm for r in graph.louvain(edges).collect()} == want
    own, between, smaller = kept[0]
    assert len(kept) == 1 and smaller and {r.part for r in own.collect()} == {1, 2}
    whole = edges.filter("part > 0").groupBy().sum("d").first()[0]
    assert between.groupBy().sum("d").first()[0] == pytest.approx(whole) and between.count() < 100


def test_of_large_vocabularies_only_rare_terms_are_joined(spark, monkeypatch):
    rows = [("a", "x y y z"), ("b", "x z z q"), ("c", "x q p"), ("d", "all x")]
    terms = spark.createDataFrame([(d, t.split(" ")) for d, t in rows], "doc string, terms array<string>")
    want = {(r.doc, r.term): r.w for r in threads.passage_weights(terms).collect()}
    assert "x" not in {t for _, t in want} and len(want) == 7
    monkeypatch.setattr(threads, "VOCABULARY", 2)  # z and q; y, p and all are in one passage each
    own = threads.passage_weights(terms)
    assert "Join" not in own._jdf.queryExecution().toString() and {(r.doc, r.term): r.w for r in own.collect()} == pytest.approx(want)
    for most in (1, 3):  # nothing is held that is as frequent as what is left out; with a bound on terms too
        monkeypatch.setattr(threads, "VOCABULARY", most)
        found = {(r.doc, t): w for r in threads.passage_rows(terms).collect() for t, w in zip(r.terms, r.w, strict=True)}
        assert found == pytest.approx(want)
        plain = {(r.doc, r.term): r.w for r in threads.tf_idf(terms.selectExpr("doc", "explode(terms) as term"), max_terms=4).collect()}
        assert {(r.doc, r.term): r.w for r in threads.passage_weights(terms, max_terms=4).collect()} == pytest.approx(plain)


def test_stored_vectors_are_sent_and_give_the_same_units(spark):
    x = np.random.default_rng(3).normal(size=(40, 8)).astype(np.float32)
    x[3] = 0
    x[5, 2] = np.nan
    rows = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "part int, pos long, vec array<float>")
    sent = graph._tiles(rows, 16)
    assert dict(sent.dtypes)["vec"] == "array<float>"  # no wider than it is stored
    own = sent.select("pos", "vec", "size", graph.unit(sent["vec"]).alias("unit")).toPandas()
    got = graph._units(np.stack(own["vec"].to_numpy()), own["size"].to_numpy())
    assert np.array_equal(got, np.stack(own["unit"].to_numpy()), equal_nan=True) and not got[own["pos"] == 3].any()
    ends = {k for r in graph.blocked_edges(rows, 0.9, block=7).collect() for k in (r.src, r.dst)}
    assert ends and not ends & {3, 5}


def test_returned_edges_come_in_order_of_distance(spark, monkeypatch, tmp_path):
    _, rows = vectors(spark, 200)
    monkeypatch.setattr(graph, "TILES", 2)
    monkeypatch.setattr(graph, "HANDED_EDGES", 100)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    plain = as_set(graph.blocked_edges(rows, 0.9, block=8))
    for most in (10**6, 700):
        monkeypatch.setattr(graph, "SORTED_EDGES", most)
        edges = graph.blocked_edges(rows, 0.9, block=8, by_distance=True)
        assert as_set(edges) == plain and edges.count() == len(plain)
    d = [np.array([3, 1, 2] * 50), np.array([4, 5, 6] * 50), np.array([0.3, 0.1, 0.2] * 50)]
    parts = list(graph._by_distance([tuple(d), tuple(d)]))
    assert len(parts) == 3 and (np.diff(np.concatenate([p[2] for p in parts])) >= 0).all() and sum(len(p[0]) for p in parts) == 300
    assert {tuple(x) for p in parts for x in zip(*p, strict=True)} == {tuple(x) for x in zip(*d, strict=True)}


def test_of_large_vocabularies_terms_are_held_by_hash(spark, monkeypatch):
    rows = [("a", "x y y z r"), ("b", "x z z q r"), ("c", "x q p s"), ("d", "all x s t"), ("e", "z t t")]
    terms = spark.createDataFrame([(d, t.split(" ")) for d, t in rows], "doc string, terms array<string>")
    want = {(r.doc, r.term): r.w for r in threads.passage_weights(terms, max_df=0.7).collect()}
    assert len(want) == 14
    monkeypatch.setattr(threads, "VOCABULARY", 1)
    as_dict = lambda df: {(r.doc, r.term): r.w for r in df.collect()}
    own = threads.passage_weights(terms, max_df=0.7)
    assert "Join" not in own._jdf.queryExecution().toString() and as_dict(own) == pytest.approx(want)
    df = spark.createDataFrame([("q", 2), ("r", 2), ("s", 2), ("t", 2), ("y", 1), ("p", 1), ("all", 1)], "term string, df long")
    keys, documents, named = threads._hashed(df)
    assert len(keys) == 4 and set(documents) == {2} and not named
    assert set(threads._looked_up({"q", "t", "y", "new"}, keys, documents, np.arange(3.0))) == {"q", "t"}
    hashed = threads._hash
    monkeypatch.setattr(threads, "_hash", lambda t: hashed(t) % 3)  # terms that share a hash are held by name
    keys, documents, named = threads._hashed(df)
    assert len(keys) + len(named) >= 4 and len(named) > 1 and all(named[t] == k for t, k in df.collect() if t in named)
    monkeypatch.setattr(threads, "_hash", hashed)
    monkeypatch.setattr(threads, "HASHED", 3)  # too many to be held: joined
    own = threads.passage_weights(terms, max_df=0.7)
    assert "Join" in own._jdf.queryExecution().toString() and as_dict(own) == pytest.approx(want)


def test_terms_of_threads_are_not_brought_together(spark):
    weights = spark.createDataFrame([(k % 3, f"d{k}", f"t{j}", 1.0 + j * k % 7) for k in range(30) for j in range(k % 5 + 1)], "thread_id long, doc string, term string, w double")
    docs = weights.select("thread_id", "doc").distinct().groupBy("thread_id").count().withColumnRenamed("count", "n")
    plan = threads.keywords_of_passages(weights, docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "WindowGroupLimit" in plan  # the best of each task are ranked, not all terms of a thread
