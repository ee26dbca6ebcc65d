"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Most labelled rows that training takes (smallest hashes of their ids): 30,000 x 27 floats are 7 MB.
TRAIN_ROWS = 30_000
THRESHOLD = 0.3

_UPPER, _DIGIT, _PUNCT = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"[!-/:-@\[-`{-~]")
_SENTENCE = re.compile(rb"[.!?](?=[\s]|$)")
_MARKS = (b"|", b"!", b"%", b"#", b"*", b"&", b"$", b"@", b"<", b",", b".")
NAMES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_sd", "longest_word", "distinct_words", "top_word",
    "repeats_previous", "pair_repeats", "upper", "capital_words", "digit", "punctuation", "symbol_words", "sentences_a_word",
    "line_words", "repeated_lines", "short_lines", "high_bytes", *(f"mark_{chr(m[0])}" for m in _MARKS),
)


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text, all finite; empty or null text gives zeros."""
    data = (text or "").encode()
    words = data.split()
    out = np.zeros(len(NAMES), dtype=np.float32)
    if not words:
        return out
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    upper = len(_UPPER.findall(data))
    # a word of letters and closing punctuation is plain; others carry symbols, digits or bars
    plain = sum(c for w, c in counts.items() if w.rstrip(b".,;:!?\"')").lstrip(b"(\"'").replace(b"-", b"").replace(b"'", b"").isalpha() or max(w) > 127)
    per_line = Counter(lines)
    before = words[:-1]
    out[:20] = (
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, before, words[1:])) / n,
        1 - len(set(zip(before, words[1:], strict=False))) / max(1, n - 1),
        upper / size, sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n, len(_DIGIT.findall(data)) / size,
        len(_PUNCT.findall(data)) / size, 1 - plain / n, len(_SENTENCE.findall(data)) / n, n / max(1, len(lines)),
        1 - len(per_line) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(data.count(bytes((b,))) for b in (0xC3, 0xC5, 0xE2)) / size,
    )
    out[20:] = [data.count(m) / n for m in _MARKS]
    return out


class Trees:
    """Histogram gradient boosting for a binary label, kept as flat arrays.

    Node i of a tree tests feature[i] <= value[i] and goes to left[i] or left[i] + 1; leaves point to
    themselves. Traversal takes all rows one level down at a time.
    """

    def __init__(self, rounds: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base, self.trees = 0.0, []
        if not len(y):
            return self
        y = y.astype(np.float64)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        cuts = [np.unique(np.quantile(x[:, f], quantiles)).astype(np.float32) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._tree(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += tree[3][leaf]
        return self

    def _tree(self, binned, cuts, gradient, hessian):
        feature, value, left, weight = [0], [0.0], [0], [0.0]
        at = np.zeros(len(gradient), dtype=np.int64)
        level = [0]
        for depth in range(self.depth + 1):
            following = []
            for node in level:
                rows = np.flatnonzero(at == node)
                g, h = gradient[rows].sum(), hessian[rows].sum()
                weight[node] = -self.rate * g / (h + self.ridge)
                best = (1e-6, -1, -1)
                if depth < self.depth and len(rows) >= 2 * self.least:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl, hl = (np.cumsum(np.bincount(b, w[rows], len(c) + 1))[:-1] for w in (gradient, hessian))
                        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                        gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                if best[1] < 0:
                    left[node] = node
                    value[node] = np.inf
                    continue
                _, f, k = best
                child = len(feature)
                feature[node], value[node], left[node] = f, float(cuts[f][k]), child
                for arrays, x in ((feature, 0), (value, np.inf), (weight, 0.0)):
                    arrays += [x, x]
                left += [child, child + 1]
                at[rows] = child + (binned[rows, f] > k)
                following += [child, child + 1]
            level = following
        return (np.array(feature), np.array(value, np.float32), np.array(left), np.array(weight)), at

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, value, left, weight in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = left[at] + (x[rows, feature[at]] > value[at])
            raw += weight[at]
        return 1 / (1 + np.exp(-raw))


def held_out(id_col: str):
    """Rows that are never trained on: CRC-32 of the id as text, modulo 5, is 0. A null id is never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on at most ``rows`` labelled documents that aren't held out, chosen by a hash of their ids.

    Only the chosen ids and their statistics reach the driver, both bounded by ``rows``. Null labels
    and ids are left out; of repeated labels of an id the largest counts. Without usable labels the
    score is 0.5 for all.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in tidy(batches):
            yield pd.DataFrame({"i": batch["i"], "y": batch["y"], "x": [statistics(t).tolist() for t in batch["t"]]})

    sample = (
        docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("i") == F.col("label_id"))
        .select("i", "t", F.col("label").cast("int").alias("y"))
        .mapInPandas(measure, "i long, y int, x array<float>").toPandas().sort_values("i", kind="stable")
    )
    x = np.array(sample["x"].tolist(), dtype=np.float32).reshape(len(sample), len(NAMES))
    return Trees().fit(x, sample["y"].to_numpy())


def _score(spark: SparkSession, model: Trees):
    """The score of a text column as a column function; the trees go out once."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidy(batches):
            yield pd.Series(sent.value.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return score


def scored(docs: DataFrame, model: Trees, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` in [0, 1] (one of that name is replaced); all other columns and all rows stay.
    Null and empty texts are scored like others, no rows give no rows."""
    return docs.withColumn(name, _score(docs.sparkSession, model)(F.col(text_col)))


def drop_low_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, with all their columns whatever their names. Each row is
    judged by its own text, so null and repeated ids make no difference."""
    return docs.filter(_score(docs.sparkSession, model)(F.col(text_col)) >= threshold)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Scores come from the whole text alone, never from labels, language, source or id. Empty and null
    texts are scored like others (all statistics 0). Rows that repeat an id are scored each by its own text; a
    null id is held out. No rows give no rows, other columns are ignored.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, model, name="score").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
