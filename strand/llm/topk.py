"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strand.operators.passages import with_position

from .common import materialize

#: Query rows of one group: with 64 components 2 MB of weights.
QUERY_BLOCK = 4096
#: Most candidates of one group, 8 MB with 64 components.
CANDIDATE_BLOCK = 16_384
#: Candidates whose score array is held at a time: 4096 x 512 scores of 8 bytes are 16 MB.
ROWS_AT_ONCE = 512
#: Scaled components up to this size are whole numbers in a double.
MOST = float(1 << 53)


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as floor(scale * x), x as double; null unless all components are finite (and at most 2**53 scaled)."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) <= F.lit(MOST)) & ~F.isnan(x.cast("double")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term its posting list: rows where it isn't zero, and their weights. Short vectors are zero beyond their end."""
    width = max((len(v) for v in vectors), default=0)
    rows = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v
    return [(at, rows[at, t]) for t in range(width) for at in [np.flatnonzero(rows[:, t])]]


def _accumulate(queries: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """Scores [candidate, query]: each term of a query scatters its weighted postings into the score arrays.

    Where sums may pass 64 bits they are taken in Python's integers and the nearest 64-bit number counts.
    """
    postings = _postings(vectors)[: queries.shape[1]]
    most = sum(float(np.abs(w).max(initial=0)) * float(np.abs(queries[:, t]).max(initial=0)) for t, (_, w) in enumerate(postings))
    kind = np.int64 if most < 2.0**62 else object
    queries = queries.astype(kind)
    scores = np.zeros((len(vectors), len(queries)), dtype=kind)
    for t, (at, weights) in enumerate(postings):
        weights = weights.astype(kind)
        active = np.flatnonzero(queries[:, t])
        if not len(at) or not len(active):
            continue
        if len(at) == len(vectors) and len(active) == len(queries):
            scores += weights[:, None] * queries[None, :, t]
        else:
            scores[np.ix_(at, active)] += weights[:, None] * queries[None, active, t]
    return np.clip(scores, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row indices and scores of the k best of each column (ties to the smaller id), by partition selection."""
    order = np.argsort(ids, kind="stable")
    scores = scores[order]
    if len(scores) > k:
        # the k-th score of a column bounds it from below; ties at the bound are settled by id order
        bound = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        rows, columns = np.nonzero(scores >= bound)
    else:
        rows, columns = np.nonzero(np.ones(scores.shape, bool))
    found = scores[rows, columns]
    by = np.lexsort((rows, -found, columns))
    rows, columns, found = rows[by], columns[by], found[by]
    rank = np.arange(len(columns)) - np.searchsorted(columns, columns, side="left")
    keep = rank < k
    return order[rows[keep]], np.stack([columns[keep], found[keep]])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each query row: query_id, rank, vec_id, score.

    Exhaustive: every query row against every candidate but those of its own id. Query rows and candidates
    are dealt into blocks and every two blocks meet in one group of one job, which keeps k rows a query;
    these are merged by query row. A group's memory follows from the blocks' bounds, whatever the tables' size.

    Vectors that are null or hold a null or non-finite component take no part; null ids neither. Query rows that
    repeat an id have k rows each (the ranks repeat), candidates that repeat an id count each by itself. Vectors
    of other lengths score over the components both have. Ties go to the smaller id. With fewer candidates than
    k, all are returned; without queries or candidates none. Other columns are ignored. Scaled components beyond
    2**53 count as not finite, scores beyond 64 bits as the nearest 64-bit number.
    """
    valid = lambda df: df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v")).filter("id is not null and v is not null")
    asked = with_position(valid(queries).withColumn("h", F.xxhash64("v")), None, "id", "h", name="q")
    asked = materialize(asked.select("id", "v", "q", F.floor(F.col("q") / QUERY_BLOCK).cast("long").alias("qb")), "topk-queries")
    n, total = asked.count(), rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // CANDIDATE_BLOCK), min(4 * cores, total // ROWS_AT_ONCE), 1)
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = asked.withColumn("cb", each(blocks))
    right = valid(rows).withColumn("cb", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn("qb", each(max(1, -(-n // QUERY_BLOCK))))

    def search(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held = pd.DataFrame({"q": np.empty(0, np.int64), "query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        if not len(asked) or not len(own):
            return held
        weights = np.zeros((len(asked), max(map(len, asked["v"]))), dtype=np.int64)
        for i, v in enumerate(asked["v"]):
            weights[i, : len(v)] = v
        numbers, query_ids, ids = (frame[c].to_numpy() for frame, c in ((asked, "q"), (asked, "id"), (own, "id")))
        for lo in range(0, len(own), ROWS_AT_ONCE):
            some = ids[lo : lo + ROWS_AT_ONCE]
            scores = _accumulate(weights, list(own["v"].iloc[lo : lo + ROWS_AT_ONCE]))
            lowest = np.iinfo(np.int64).min
            scores[some[:, None] == query_ids[None, :]] = lowest
            at, (columns, found) = _best(scores, some, k)
            real = found > lowest
            columns = columns[real]
            held = pd.concat([held, pd.DataFrame({"q": numbers[columns], "query_id": query_ids[columns], "vec_id": some[at[real]], "score": found[real]})])
            held = held.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)
        return held

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
