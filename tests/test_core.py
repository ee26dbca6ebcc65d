"""Graph, clustering, sampling, sources and dates against known or brute-force values."""

import datetime as dt
import itertools

import numpy as np
import pytest

from strand.functions.dates import extract_dates
from strand.operators import cluster, graph, sdpp
from strand.params import HyperParams, thread_pattern
from strand.queries.tables import items
from strand.sources import documents as D

SF = "/root/testdata/sf0.001"


def test_communities_of_the_small_example(spark):
    edges = spark.createDataFrame([(0, 1, 2, 0.3), (0, 1, 3, 0.2), (0, 2, 3, 0.5), (0, 3, 4, 0.4), (0, 3, 5, 0.1), (0, 1, 4, 0.6)], "part int, src long, dst long, d double")
    groups = {}
    for r in graph.npc(edges).collect():
        groups.setdefault(r.comm, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3, 4, 5]]


def test_three_edge_plans_agree(spark):
    rows = items(spark, SF).filter("pos < 250")
    key = lambda df: sorted((r.src, r.dst, round(r.d, 6)) for r in df.collect())
    assert key(graph.blocked_edges(rows, 0.7, block=64)) == key(graph.expression_edges(rows, 0.7))
    p = HyperParams()
    assert key(graph.time_pruned_edges(rows, p)) == key(graph.expression_edges(rows, 0.7, alpha=p.alpha)) == key(graph.blocked_edges(rows, 0.7, alpha=p.alpha))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def textbook(d, height):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        x, a, b = min((max(d[i, j] for i in p for j in q), a, b) for (a, p), (b, q) in itertools.combinations(enumerate(groups), 2))
        if x >= height:
            break
        groups[a] += groups.pop(b)
    return sorted(map(sorted, groups))


def test_complete_linkage_is_the_textbook_one():
    rng = np.random.default_rng(0)
    for _ in range(20):
        d = rng.random((9, 9))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        label = cluster.cut(9, cluster.merges(d), height=0.6)
        assert sorted(sorted(np.flatnonzero(label == x).tolist()) for x in set(label)) == textbook(d, 0.6)


def test_trellis_by_enumeration():
    rng = np.random.default_rng(1)
    n, length = 4, 3
    m = sdpp.Trellis(rng.random((n, n)), rng.random(n), rng.random(n), length)
    f = rng.random((n, 2))
    total, marginal, moment = 0.0, np.zeros((length, n)), np.zeros((2, 2))
    for s in itertools.product(range(n), repeat=length):
        w = m.first[s[0]] * np.prod([m.step[a, b] * m.quality[b] for a, b in itertools.pairwise(s)])
        total += w
        for t, x in enumerate(s):
            marginal[t, x] += w
        g = f[list(s)].sum(axis=0)
        moment += w * np.outer(g, g)
    assert m.partition() == pytest.approx(total)
    assert np.allclose(m.marginals(), marginal / total) and np.allclose(m.second_moment(f), moment)
    assert [sdpp.elementary_symmetric(np.array([1.0, 2, 3, 4]), 3)[k, -1] for k in (1, 2, 3)] == [10, 35, 50]
    small = [sdpp.Trellis(np.array([[0, 0.5, 0.4], [0, 0, 0.3], [0, 0, 0]]), np.array([1.0, 2, 3]), np.ones(3), t).partition() for t in (2, 3)]
    assert np.allclose(small, [1.5, 0.15])


@pytest.mark.parametrize("text, want", [
    ("5-Jan-2012 17:00", dt.datetime(2012, 1, 5, 17)), ("January 12, 2010", dt.datetime(2010, 1, 12)), ("12 January 2011", dt.datetime(2011, 1, 12)),
    ("11th Feb, 1975", dt.datetime(1975, 2, 11)), ("2010", None), ("next Tuesday", dt.datetime(2020, 5, 19)), ("yesterday", dt.datetime(2020, 5, 12)),
])
def test_dates(text, want):
    assert [t for _, t in extract_dates(text, dt.date(2020, 5, 13))] == ([want] if want else [])


def test_word_files():
    paragraphs, comments = D.parse_docx(D.make_docx(["a & b", "", "c"], [(0, 2, "note")]))
    assert paragraphs == ["a & b", "", "c"] and [(c["start"], c["end"], c["text"]) for c in comments] == [(0, 2, "note")]
    assert D.parse_docx(D.make_docx(["x"]))[1] == []


def test_corpus_brackets():
    spans = [("1", 0, 3), ("2", 1, 1), ("1", 4, 5)]
    assert D.coref_spans(D.bracket_tags(6, spans)) == spans
    rows = D.parse_conll("#begin document (d); part 000\nd\t0\t0\thello\t(1)\n\nd\t0\t0\tyou\t-\n#end document\n")
    assert [(r[2], r[4], r[5]) for r in rows] == [(0, "hello", "(1)"), (1, "you", "-")]


def test_params():
    assert HyperParams().with_overrides(alpha=3, gamma=None) == HyperParams(alpha=3)
    assert thread_pattern("lsa", time_decay=True) == "lsa_time_npc"
