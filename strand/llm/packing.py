"""Best-fit packing with exact-complement hashing."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy
from .tokens import word_ids

CAPACITY = 4096
END_ID = 1
#: Rows of one (length, bucket) group at most, about: the unit in which ranks are counted.
RANK_ROWS = 50_000


class _Sums:
    """Single, pair and triple sums of available lengths, hashed by their sum.

    Availability only falls, so each sum keeps the largest part it has not yet ruled out and moves
    down from there; a lookup costs nothing once its sum has been found empty.
    """

    def __init__(self, count: list[int]):
        self.count = count
        self.pair_at: dict[int, int] = {}
        self.triple_at: dict[int, int] = {}

    def single(self, s: int) -> tuple[int, ...] | None:
        return (s,) if 0 < s < len(self.count) and self.count[s] else None

    def pair(self, s: int) -> tuple[int, ...] | None:
        count = self.count
        a = self.pair_at.get(s, min(s - 1, len(count) - 1))
        while 2 * a >= s:
            b = s - a
            if count[a] and count[b] and (a != b or count[a] > 1):
                self.pair_at[s] = a
                return (a, b)
            a -= 1
        self.pair_at[s] = -1
        return None

    def triple(self, s: int) -> tuple[int, ...] | None:
        count = self.count
        a = self.triple_at.get(s, min(s - 2, len(count) - 1))
        while 3 * a >= s:
            if count[a]:
                rest = self.pair(s - a)
                # the largest part leads, so the pair's parts are at most a; enough of each must be left
                if rest and all((a, *rest).count(x) <= count[x] for x in rest):
                    self.triple_at[s] = a
                    return (a, *rest)
            a -= 1
        self.triple_at[s] = -1
        return None


Patterns = list[tuple[tuple[int, ...], int]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """Patterns (lengths of one sequence, how many such sequences) that use up ``histogram``.

    Longest first, each length takes the single, pair or triple that exactly fills its gap, as often
    as the counts allow at once. What no combination fills exactly goes to best fit, longest first,
    again in bulk. Steps follow the number of distinct lengths (at most ``capacity``), not of pieces.

    Where that leaves more than one sequence above the tokens' own bound, combinations of fewer parts
    are tried as well (they leave more small pieces to best fit) and the smallest plan counts.
    """
    bound = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best: Patterns | None = None
    for parts in (3, 2, 1, 0):
        found = _plan(histogram, capacity, parts)
        if best is None or _sequences(found) < _sequences(best):
            best = found
        if _sequences(best) <= bound + 1:
            break
    return best or []


def _sequences(patterns: Patterns) -> int:
    return sum(times for _, times in patterns)


def _plan(histogram: dict[int, int], capacity: int, most: int) -> Patterns:
    """One plan, with exact combinations of at most ``most`` parts."""
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] = n
    patterns: Patterns = []
    if count[capacity]:
        patterns.append(((capacity,), count[capacity]))
        count[capacity] = 0
    left: list[tuple[int, int]] = []
    sums = _Sums(count)
    for length in range(capacity - 1, 0, -1):
        total = count[length]
        while total:
            gap = capacity - length
            count[length] = total - 1  # the seed itself is not for its own gap
            fill = next(filter(None, (find(gap) for find in (sums.single, sums.pair, sums.triple)[:most])), None)
            count[length] = total
            if not fill:
                break
            parts = (length, *fill)
            times = min(count[x] // parts.count(x) for x in set(parts))
            for x in parts:
                count[x] -= times
            patterns.append((parts, times))
            total = count[length]
        if total:
            left.append((length, total))
            count[length] = 0
    return patterns + _best_fit(left, capacity)


def _best_fit(left: list[tuple[int, int]], capacity: int) -> Patterns:
    """Best fit decreasing over (length, count), with equal open sequences kept as one class."""
    open_gaps: list[int] = []  # sorted
    classes: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(parts: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(parts)
        if gap not in classes:
            bisect.insort(open_gaps, gap)
            classes[gap] = []
        classes[gap].append((parts, times))

    for length, n in left:
        while n:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                fit = capacity // length
                if n // fit:
                    put((length,) * fit, n // fit)
                if n % fit:
                    put((length,) * (n % fit), 1)
                break
            gap = open_gaps[at]
            parts, times = classes[gap].pop()
            if not classes[gap]:
                del classes[gap], open_gaps[at]
            fit = gap // length
            if n >= fit * times:
                put(parts + (length,) * fit, times)
                n -= fit * times
                continue
            full, some = divmod(n, fit)
            if full:
                put(parts + (length,) * fit, full)
            if some:
                put(parts + (length,) * some, 1)
            if rest := times - full - bool(some):
                put(parts, rest)
            n = 0
    return [x for gap in open_gaps for x in classes[gap]]


def _slots(patterns: Patterns) -> dict[int, dict[str, np.ndarray]]:
    """For each length: from which rank on, in which sequences (first id) and offset its pieces stand."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for parts, times in patterns:
        offset = 0
        for x in parts:
            rank = used.get(x, 0)
            rows.setdefault(x, []).append((rank, first, offset))
            used[x] = rank + times
            offset += x
        first += times
    return {x: dict(zip(("rank", "first", "offset"), np.array(r, dtype=np.int64).T, strict=True)) for x, r in rows.items()}


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    schema = "doc_id {}, piece int, start long, length long, ids_crc32 long{}".format(
        docs.schema[id_col].dataType.simpleString(), ", ids array<int>" if keep_ids else ""
    )
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = word_ids(tokenizer)
        for batch in tidy(batches):
            rows = []
            for doc_id, text in zip(batch["i"], batch["t"], strict=True):
                ids = memoryview(tok.ids(text) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = [doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    rows.append([*row, np.frombuffer(part, "<u4").astype("<i4")] if keep_ids else row)
                if len(rows) > 20_000:
                    yield _frame(rows, keep_ids)
                    rows = []
            yield _frame(rows, keep_ids)

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(cut, schema)


def _frame(rows: list, keep_ids: bool) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
    if frame["doc_id"].dtype == float:  # null ids
        frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Place every document's pieces in sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked
    for). Documents longer than the capacity are cut into pieces of it, others never. The driver sees
    the number of pieces of each length (at most ``capacity`` rows), plans patterns on it and sends
    them to the tasks; a piece's place follows from its rank among the pieces of its length. Ranks are
    counted in buckets, so a length that a third of all pieces have is spread over many tasks.

    Null text is empty and is one piece of the end id alone. Null ids and rows that repeat an id are
    packed like others, each row by itself. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, id_col, text_col, keep_ids), "pack-pieces")
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(by_length.values())
    slots = spark.sparkContext.broadcast(_slots(plan(by_length, capacity)))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANK_ROWS + 1)
    # equal rows are interchangeable: whichever gets a rank, the result has the same rows
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets))
    pieces = pieces.withColumn("bucket", bucket)
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    # the bases come from counts over the same keys as the ranks, so the join needs no other shuffle
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = order[lo:hi]
            own = slots.value[int(lengths[at[0]])]
            k = np.searchsorted(own["rank"], ranks[at], side="right") - 1
            sequence[at] = own["first"][k] + ranks[at] - own["rank"][k]
            offset[at] = own["offset"][k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * keep_ids
    )
