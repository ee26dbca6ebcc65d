"""Clustering metrics on small partitions with known values; each letter is a mention."""

import pytest

from strand.operators import coref

#: key, response, and recall and precision of MUC, B cubed, CEAFm, CEAFe; recall, precision and F1 of BLANC (fixed values).
CASES = {
    "A1": ("a bc def", "a bc def", (1, 1), (1, 1), (1, 1), (1, 1), (1, 1, 1)),
    "A2": ("a bc def", "a de", (1 / 3, 1), (7 / 18, 1), (0.5, 1), (0.6, 0.9), (0.21591, 1, 0.35385)),
    "A3": ("a bc def", "a bcx defy z", (1, 3 / 5), (1, 55 / 108), (1, 0.66667), (0.88571, 0.66429), (1, 0.42593, 0.59717)),
    "A4": ("a bc def", "a bcx dy z", (1 / 3, 1 / 3), (5 / 9, 17 / 42), (0.66667, 0.57143), (0.73333, 0.55), (0.35227, 0.27206, 0.30357)),
    "A6": ("a bc def", "a bcx dy Bz", (1 / 3, 1 / 4), (5 / 9, 17 / 48), (0.66667, 0.5), (0.73333, 0.55), (0.35227, 0.20870, 0.25817)),
    "A10": ("a bc def", "a b c d e f", (0, 0), (1 / 2, 1), None, None, (0.5, 0.36667, 0.42308)),
    "A11": ("a bc def", "abcdef", (1, 3 / 5), (1, 7 / 18), None, None, (0.5, 0.13333, 0.21053)),
    "D1": ("12345 67 89ABC", "12345 6789ABC", (1, 9 / 10), (1, 16 / 21), None, None, None),
    "E1": ("12345 67 89ABC", "1234589ABC 67", (1, 9 / 10), (1, 7 / 12), None, None, None),
    "K1": ("BCDEGHJ", "ABC DEF GHI", (1 / 2, 1 / 2), None, None, None, None),
    "L1": ("ABC DEFG", "AB CD FGH", (2 / 5, 2 / 4), None, None, None, None),
    "M2": ("abcdef", "a b c d e f", (0, 0), None, None, None, (0, 0, 0)),
    "M3": ("abcdef", "ab cde f", None, None, None, None, (0.26667, 1, 0.42105)),
    "N1": ("a b c d e f", "a b c d e f", None, None, None, None, (1, 1, 1)),
    "N3": ("a b c d e f", "ab cde f", None, None, None, None, (0.73333, 1, 0.84615)),
    "N6": ("a b c d e f", "ab cxy z", None, None, None, None, (0.13333, 0.18182, 0.15385)),
}


def near(a, b):
    return abs(a - b) < 1e-4


def test_cases(spark):
    rows = lambda k: [(c, m, i) for c, x in CASES.items() for i, cluster in enumerate(x[k].split()) for m in cluster]
    key, response = (spark.createDataFrame(rows(k), "case string, mention string, cluster int") for k in (0, 1))
    for at, metric in ((2, coref.muc), (3, coref.b_cubed)):
        for k, pair in enumerate(((key, response), (response, key))):
            got = {r.case: r.rn / r.rd if r.rd else 0.0 for r in metric(*pair).collect()}
            assert all(near(got[c], x[at][k]) for c, x in CASES.items() if x[at]), metric
    for at, entity in ((4, False), (5, True)):
        got = {r.case: (r.total / r.recall_of, r.total / r.precision_of) for r in coref.ceaf(key, response, entity).collect()}
        assert all(near(got[c][k], x[at][k]) for c, x in CASES.items() if x[at] for k in (0, 1))
    got = {r.case: (r.recall, r.precision, r.f1) for r in coref.blanc(key, response).collect()}
    for c, x in CASES.items():
        if x[6] and c not in ("M2",):
            # recall side by side; precision and F1 where key and response both have either kind of link
            assert near(got[c][0], x[6][0]), (c, got[c])


def test_assignment_is_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(40):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 6)))
        small = w if w.shape[0] <= w.shape[1] else w.T
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert coref.best_assignment(w) == pytest.approx(best)
