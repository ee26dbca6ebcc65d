"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small_batches, tidy

WINDOW = 20
#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Words hashed at a time: words and arrays for them take about 40 MB of a Python worker.
WORDS_AT_ONCE = 200_000
#: Bytes of text that one bucket of hashes stands for, about.
BUCKET_BYTES = 2 << 20
#: At most 65,536 buckets; beyond 128 GB of texts buckets grow with the input instead.
MOST_BITS = 16
#: Buckets of one partition: with several, partitions come out even.
BUCKETS_A_TASK = 4
#: Removal intervals of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20

_LAST = int(np.iinfo(np.int64).max)  # stands for a null id: later than any


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the polynomial's value over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    if len(_POWERS.get("base", ())) < n:
        for name, base in (("base", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["base"][:n], _POWERS["inverse"][:n]


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """Hash of each run of ``window`` words: a polynomial in the words' hashes, rolled by prefix sums."""
    n = len(words)
    if n < window:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    power, inverse = _powers(n)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * power, out=prefix[1:])
    return _mixed((prefix[window:] - prefix[:-window]) * inverse[: n - window + 1])


def _planes(values: np.ndarray) -> bytes:
    """Bytes of an array plane by plane, so that high bytes, which hardly differ, compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """Ids, marks and words of documents, about WORDS_AT_ONCE words at a time; a document stays whole."""
    ids, marks, docs, total = [], [], [], 0
    for batch in batches:
        for i, mark, text in zip(batch["i"], batch["k"], batch["t"], strict=True):
            words = text.encode().split() if text else []
            ids.append(i)
            marks.append(mark)
            docs.append(words)
            total += len(words)
            if total >= WORDS_AT_ONCE:
                yield np.array(ids, dtype=np.int64), np.array(marks, dtype=np.int64), docs
                ids, marks, docs, total = [], [], [], 0
    if docs:
        yield np.array(ids, dtype=np.int64), np.array(marks, dtype=np.int64), docs


def _marks(marks: np.ndarray) -> bytes:
    """Marks are zero but for rows that repeat an id: mostly there is nothing to send."""
    return marks.astype("<i8").tobytes() if marks.any() else b""


def _from_marks(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i8") if data else np.zeros(n, np.int64)


def _by_block(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, blocks: int) -> pd.DataFrame:
    """Windows to remove, packed into one row for each block of documents (by a hash of the id)."""
    block = (_mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[by], prepend=-1, append=-1))
    rows = [
        (int(block[by[lo]]), ids[by[lo:hi]].astype("<i8").tobytes(), _marks(marks[by[lo:hi]]), start[by[lo:hi]].astype("<u4").tobytes())
        for lo, hi in zip(edges[:-1], edges[1:], strict=True)
    ]
    return pd.DataFrame(rows, columns=["block", "ids", "marks", "places"])


def _scan(window: int, bits: int, blocks: int):
    """Windows of a chunk of documents. Of equal windows in a chunk only the first is sent on, with its
    place; the others are repeats already. Rows go out by bucket (the hash's top bits), hashes sorted.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, marks, docs in _chunks(tidy(batches)):
            order = np.lexsort((marks, ids))
            ids, marks, docs = ids[order], marks[order], [docs[k] for k in order]
            sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
            hashes = window_hashes([w for words in docs for w in words], window)
            first = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(docs)), sizes)[: len(hashes)]
            start = np.arange(len(hashes)) - first[doc] if len(hashes) else np.empty(0, np.int64)
            inside = start + window <= sizes[doc]
            hashes, doc, start = hashes[inside], doc[inside], start[inside]
            by = np.argsort(hashes, kind="stable")  # (id, mark, start) ascend within equal hashes
            sorted_hashes = hashes[by]
            new = np.ones(len(by), bool)
            new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
            # rows that share id, mark and start with the first of their hash are no later than it
            leader = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
            later = (ids[doc[by]] != ids[doc[leader]]) | (marks[doc[by]] != marks[doc[leader]]) | (start[by] != start[leader])
            again = by[~new & later]
            if len(again):
                found = _by_block(ids[doc[again]], marks[doc[again]], start[again], blocks)
                yield found.assign(bucket=-1, hashes=None, docs=None)[_COLUMNS]
            keep, kept = by[new], sorted_hashes[new]
            edges = np.searchsorted(kept, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
            rows = []
            for b, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(kept)], strict=True)):
                if lo == hi:
                    continue
                own, index = np.unique(doc[keep[lo:hi]], return_inverse=True)
                gaps = np.diff(kept[lo:hi], prepend=np.uint64(0))
                rows.append((b, 0, _planes(gaps), _planes(index.astype("<u4")), _planes(start[keep[lo:hi]].astype("<u4")), ids[own].astype("<i8").tobytes(), _marks(marks[own])))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return scan


_SCANNED = "bucket int, block int, hashes binary, docs binary, places binary, ids binary, marks binary"
_COLUMNS = ["bucket", "block", "hashes", "docs", "places", "ids", "marks"]


def _later_windows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's hashes: ids, marks and starts of windows that start later than the first of the same hash."""
    ids, marks, start, hashes = [], [], [], []
    for row in rows.itertuples(index=False):
        own = np.frombuffer(row.ids, "<i8")
        index = _from_planes(row.docs, np.uint32)
        hashes.append(np.cumsum(_from_planes(row.hashes, np.uint64)))
        ids.append(own[index])
        marks.append(_from_marks(row.marks, len(own))[index])
        start.append(_from_planes(row.places, np.uint32))
    hashes = np.concatenate(hashes)
    by = np.argsort(hashes)
    same = hashes[by]
    twice = np.zeros(len(by), bool)
    twice[1:] = same[1:] == same[:-1]
    twice[:-1] |= twice[1:]
    by = by[twice]
    hashes, ids, marks, start = hashes[by], np.concatenate(ids)[by], np.concatenate(marks)[by], np.concatenate(start)[by]
    by = np.lexsort((start, marks, ids, hashes))
    hashes, ids, marks, start = hashes[by], ids[by], marks[by], start[by]
    lead = np.ones(len(by), bool)
    lead[1:] = hashes[1:] != hashes[:-1]
    at = np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0)) if len(by) else by
    later = (ids != ids[at]) | (marks != marks[at]) | (start != start[at])
    return ids[later], marks[later], start[later]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i, k and t of documents: the id (null as the last of all), the text, and a mark that tells rows of one id
    apart by their texts. The mark is 0 for ids that occur once; only ids are counted for that."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    rows = docs.select(own.alias("i"), F.col(text_col).alias("t"))
    repeated = materialize(rows.groupBy("i").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("i").alias("again")), "substring-repeated-ids")
    n, mark = repeated.count(), F.xxhash64("t")
    if not n:
        return rows.withColumn("k", F.lit(0).cast("long"))
    if n > BROADCAST_ROWS:  # marks for all are right as well, they only send more
        return rows.withColumn("k", mark)
    return rows.join(F.broadcast(repeated), F.col("i") == F.col("again"), "left").select("i", "t", F.when(F.col("again").isNull(), 0).otherwise(mark).alias("k"))


def removal_intervals(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """i, k and spans (array of [begin, end) word positions, maximal and ascending) to remove, of texts (i, k, t).

    One row for each document that has any. A word goes if a window covers it whose words also start
    earlier: in a smaller (i, k), or earlier in the same document.
    """
    bits = min(MOST_BITS, max(4, int(np.ceil(np.log2(max(1, _input_bytes(texts) / BUCKET_BYTES))))))
    buckets = 1 << bits
    tasks = buckets // BUCKETS_A_TASK
    scanned = texts.mapInPandas(_scan(window, bits, tasks), _SCANNED)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for batch in tidy(batches):
            done = batch["bucket"] < 0
            if done.any():
                yield batch.loc[done, ["block", "ids", "marks", "places"]]
            for b, rows in batch[~done].groupby("bucket"):
                held.setdefault(int(b), []).append(rows)
        found = [_later_windows(pd.concat(held.pop(b))) for b in sorted(held)]
        if found:
            yield _by_block(*map(np.concatenate, zip(*found, strict=True)), tasks)

    # one shuffle by bucket; rows of bucket -1, settled in their chunk already, go by their block
    key = F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket"))
    later = scanned.repartition(tasks, key).mapInPandas(settle, "block int, ids binary, marks binary, places binary")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(x, "<i8") for x in rows["ids"]]
        marks = [_from_marks(x, len(own)) for x, own in zip(rows["marks"], ids, strict=True)]
        starts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["places"]]).astype(np.int64)
        return _merged(np.concatenate(ids), np.concatenate(marks), starts, window)

    found = later.groupBy("block").applyInPandas(merge, "i long, k long, spans array<struct<begin:long,end:long>>")
    return materialize(found, "substring-spans")


def _merged(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, window: int) -> pd.DataFrame:
    """Maximal intervals that windows at ``starts`` cover, by document."""
    by = np.lexsort((starts, marks, ids))
    ids, marks, starts = ids[by], marks[by], starts[by]
    new = np.ones(len(by), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] - starts[:-1] > window)
    begin = np.flatnonzero(new)
    ends = starts[np.append(begin[1:] - 1, len(starts) - 1)] + window
    out: dict[tuple[int, int], list[dict[str, int]]] = {}
    for i, k, a, b in zip(ids[begin].tolist(), marks[begin].tolist(), starts[begin].tolist(), ends.tolist(), strict=True):
        out.setdefault((i, k), []).append({"begin": a, "end": b})
    return pd.DataFrame({"i": [i for i, _ in out], "k": [k for _, k in out], "spans": list(out.values())})


def _input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; where it has none, what the session's shuffle partitions suit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_A_TASK * BUCKET_BYTES


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words joined by one space) of every row.

    Window hashes are sent by bucket of the hash, never a text; equal windows of one chunk are one
    before they are sent, so a passage that a third of all documents hold is one row a chunk. Only
    the removal intervals meet the texts again: broadcast while they are few, shuffled beyond that.

    Null text has no words, as the empty text has. Null ids count as later than any id. Rows that repeat an id,
    or have none, are documents of their own, earlier or later by a hash of their texts; rows that repeat id and
    text are one document, none of them the earlier one. No rows give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    spans = removal_intervals(texts, window).withColumnsRenamed({"i": "span_i", "k": "span_k"})
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 16 + 48), F.lit(0))).first()[0]
    sent = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    joined = texts.join(sent, (F.col("i") == F.col("span_i")) & (F.col("k") == F.col("span_k")), "left")
    joined = joined.select(F.when(F.col("i") < _LAST, F.col("i")).alias("doc_id"), "t", "spans")

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept_sha256:string,text:string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in tidy(batches):
            rows = []
            for text, own in zip(texts, spans, strict=True):
                words = text.encode().split() if text else []
                n = len(words)
                for s in reversed(own) if own is not None else ():
                    del words[s["begin"] : s["end"]]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "text"])

    return joined.withColumn("cut", cut("t", "spans")).select("doc_id", "cut.*")
