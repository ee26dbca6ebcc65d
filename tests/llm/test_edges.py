"""Rows that repeat or lack ids, empty tables, very long texts, clashing names; what only a plain version can judge."""

import re
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strand.llm import exact_dedup, html_text, minhash, mixing, packing, pii, quality, secret_scan, substring, topk
from strand.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, source string, lang string, n_chars long, i string, t string, h string, row string, slot string, key string, size string, copies string, kept string, gone_i string, mix_size string, mix_source string, quality_score string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, *"abcdefghijklm") for i, t, s in rows], CLASHING)


def body(k, n=60):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_repeated_and_null_ids(spark):
    rows = [(1, body(1), "s"), (7, body(1), "s"), (7, body(2), "s"), (7, body(2), "t"), (None, body(3), None), (None, body(3), None), (None, body(1), "s"), (8, None, "s"), (9, "", "s")]
    docs = clashing(spark, rows)
    exact = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in exact) == [(0, "w3x"), (1, "w1x"), (7, "w2x"), (8, "")]
    near = minhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in near) == [(0, "w3x"), (1, "w1x"), (7, "w2x"), (8, ""), (9, "")]
    assert [c for c, _ in minhash.drop_near_duplicates(docs).dtypes] == docs.columns
    cut = [(r.doc_id or 0, r.n_words, r.n_removed) for r in substring.substring_dedup(docs).collect()]
    assert sorted(cut) == sorted([(1, 60, 0), (7, 60, 60), (7, 60, 0), (7, 60, 0), (0, 60, 0), (0, 60, 0), (0, 60, 60), (8, 0, 0), (9, 0, 0)])
    found = minhash.near_dedup(docs).collect()
    assert len(found) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in found)
    packed = packing.pack(docs, tokenizer_path()).collect()
    assert Counter(r.doc_id for r in packed) == Counter(i for i, _, _ in rows)
    taken = mixing.mixed(docs).collect()
    assert len(taken) == len(rows) and {r.mix_size for r in taken} == {0, 60} and {r.mix_source for r in taken} == {"l"}
    assert all(r.mix_size == "k" and r.mix_source == "l" for r in mixing.mix_sources(docs).collect())
    assert pii.find_pii(docs).count() == secret_scan.scan_secrets(docs).count() == len(rows)
    scored = quality.quality(docs, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored) and all(r.held_out for r in scored if r.doc_id is None)


def test_near_links_of_repeated_ids_stay_apart(spark):
    """A text that shares its smallest id with another isn't linked by the other's links."""
    a, b = body(1).split(), body(2)
    variant = " ".join([*a[:-1], "z"])
    got = minhash.near_dedup(spark.createDataFrame([(5, body(1)), (5, b), (3, variant), (9, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_top_k_of_repeated_queries(spark):
    rows = spark.createDataFrame([(100, [1.0, 0.5]), (100, [-1.0, 0.25]), (1, [2.0, 1.0]), (2, [1e300, 1.0]), (3, None), (4, [0.5, float("nan")]), (6, [1.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(rows.filter("vec_id = 100"), rows).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(100, 1, 1, 2 * 1024 * 1024 + 512 * 1024), (100, 1, 6, -1024 * 1024), (100, 2, 1, -2 * 1024 * 1024 + 256 * 1024), (100, 2, 6, 1024 * 1024)]
    wide = spark.createDataFrame([(100, [4e12] * 4), (1, [4e12] * 4), (2, [-4e12] * 4)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(wide.filter("vec_id = 100"), wide).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 1 - 2**63)]


def test_empty_tables(spark):
    docs, labels = clashing(spark, [(1, "a", "s")]).limit(0), spark.createDataFrame([], "doc_id long, quality int")
    vectors, pages = spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "page_id long, url string, html string")
    for found in (
        minhash.near_dedup(docs), minhash.drop_near_duplicates(docs), packing.pack(docs, tokenizer_path()), exact_dedup.exact_dedup(docs), exact_dedup.drop_exact_duplicates(docs),
        secret_scan.scan_secrets(docs), html_text.extract_text(pages), topk.top_k(vectors, vectors), substring.substring_dedup(docs), quality.quality(docs, labels),
        pii.find_pii(docs), mixing.mixed(docs), mixing.mix_sources(docs),
    ):
        assert found.count() == 0


def test_very_long_texts(spark):
    n = 150_000
    long = " ".join(f"word{k % 977}" for k in range(n)) + " mail a.b@c.de token=abcdefgh12 end"
    docs = spark.createDataFrame([(1, long), (2, "x" * 400_000), (3, "1 2 3 4 " * 20_000), (4, "a" + "." * 50_000 + "@" * 1000)], "doc_id long, text string")
    secrets = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    at = long.index("token=")
    assert secrets[1].n_assign == 1 and secrets[1].spans == f"assign:{at}:{at + 16}" and secrets[4].n_assign == 0
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    at = long.index("a.b@c.de")
    assert f"email:{at}:{at + 8}" in found[1].spans.split(",")
    assert all(0 <= r.score <= 1 for r in quality.quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect())
    html = "<nav><a>x</a></nav><article>" + "".join(f"<p>paragraph {k} of the long article</p>" for k in range(8000)) + "</article>"
    text = html_text.extract_text(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text
    assert text.split("\n") == [f"paragraph {k} of the long article" for k in range(8000)]
    assert substring.substring_dedup(docs).filter("doc_id = 1").first().n_removed > n - 2000


def test_pipeline_stages_on_awkward_rows(spark):
    rows = [(1, body(1), "s"), (1, body(1), "s"), (1, body(2), None), (None, body(1), "s"), (None, None, "t"), (5, "", None), (6, " ".join(body(1).split()[:-1]) + " q", "s")]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == clashing(spark, rows).columns
        empty = stage(spark, clashing(spark, rows).limit(0), SF)
        assert empty.count() == 0
        if name == "quality_classifier":
            docs = clashing(spark, rows)  # whatever it thinks of these texts
        if name == "near_dedup":
            assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in docs.collect()) == [(1, "w1x"), (1, "w2x"), (5, "")]


# ---- pages ------------------------------------------------------------------------------------------------


def article(html):
    """The blocks of the one article of a generated page, by its tags."""
    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<!--.*?-->", "", inner).replace("<br>", " "))
    return "\n".join(filter(None, (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in blocks)))


@pytest.mark.parametrize("renamed", [False, True])
def test_html_of_all_pages(spark, renamed):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    if renamed:  # without the tag that names it
        pages = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def untagged(k):
    """A page of plain blocks: nothing but its text and tags tells the article from what stands around it."""
    rng = np.random.default_rng(k)
    words = lambda n: " ".join(f"{'abcdefgh'[rng.integers(8)]}{rng.integers(99)}" for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{j}'>{words(2)}</a></li>" for j in range(n)) + "</ul>"
    text = [words(rng.integers(30, 80)) if rng.random() < 0.7 else words(rng.integers(2, 8)) for _ in range(rng.integers(5, 12))]
    inner = "".join(f"<p>{t}</p>" for t in text[:3]) + links(6) + "".join(f"<p>{t}</p>" for t in text[3:])
    return f"<body><div>{links(8)}</div><div>{words(3)} <a href=x>{words(1)}</a></div><div>{inner}</div><div>{links(5)}</div></body>", text


def test_html_by_ratios_alone(monkeypatch):
    found = wanted = right = 0
    for k in range(60):
        html, text = untagged(k)
        got = html_text.main_text(html).split("\n")
        found, wanted, right = found + len(got), wanted + len(text), right + len(set(got) & set(text))
    assert right >= 0.97 * wanted and right >= 0.97 * found
    pages = [untagged(k)[0] for k in range(20)]
    with_clusters = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "two_clusters", lambda values: -1.0)  # every line votes
    assert all(html_text.main_text(p) != t for p, t in zip(pages, with_clusters, strict=True))


# ---- trees ------------------------------------------------------------------------------------------------


def plain_score(trees, row):
    raw = trees.base
    for feature, value, left, weight in trees.trees:
        node = 0
        while left[node] != node:
            node = left[node] + int(row[feature[node]] > value[node])
        raw += weight[node]
    return 1 / (1 + np.exp(-raw))


def test_trees_against_plain_traversal():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(int)
    trees = quality.Trees(rounds=40).fit(x[:600], y[:600])
    scores = trees.score(x)
    assert np.allclose(scores, [plain_score(trees, row) for row in x])
    assert ((scores[600:] > 0.5) == y[600:]).mean() > 0.85
    one = quality.Trees(rounds=1, depth=1, least=1).fit(x[:600], y[:600])
    feature, value, left, _ = one.trees[0]
    gains = {}
    p = y[:600].mean()
    for f in range(5):
        for c in np.unique(np.quantile(x[:600, f], np.linspace(0, 1, 65)[1:-1])).astype(np.float32):
            low = x[:600, f] <= c
            gains[f, float(c)] = sum((p * m.sum() - y[:600][m].sum()) ** 2 / (m.sum() * p * (1 - p) + 1) for m in (low, ~low))
    assert gains[int(feature[0]), float(value[0])] == pytest.approx(max(gains.values()))


def test_documents_of_the_pipeline_frame(spark):
    """What a stage returns can be written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix_sources(docs)
    assert mixed.dtypes == docs.dtypes and pd.Series([r.doc_id for r in mixed.select("doc_id").collect()]).value_counts().max() <= 3
