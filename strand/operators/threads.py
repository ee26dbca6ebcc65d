"""Threads: members in time order, scores, filters, evaluation, keywords."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strand.functions.vectors import cosine, dot, unit
from strand.operators import sparse
from strand.operators.graph import DIGITS, merged_threads
from strand.plans.cut import materialize


def thread_members(communities: DataFrame, items: DataFrame) -> DataFrame:
    """(thread_id, ord, pos, doc_id, created, …) of communities (part, node, comm), ordered by time, then id."""
    joined = communities.select("part", F.col("node").alias("pos"), F.col("comm").alias("thread_id")).join(items, ["part", "pos"])
    order = Window.partitionBy("part", "thread_id").orderBy("created", "doc_id")
    return joined.withColumn("ord", F.row_number().over(order) - 1)


def consecutive_similarity(members: DataFrame, vec_col: str = "vec", keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """(keys, sim): mean cosine of neighbours along each thread; null for one member."""
    before = F.lag(vec_col).over(Window.partitionBy(*keys).orderBy("created", "doc_id"))
    return members.select(*keys, cosine(before, F.col(vec_col)).alias("c"), before.isNotNull().alias("has")).groupBy(*keys).agg(F.avg(F.when(F.col("has"), F.col("c"))).alias("sim"))


def step_edges(members: DataFrame, limit: float) -> DataFrame:
    """Edges (src, dst, d) below ``limit`` between consecutive members (part, thread_id, ord, pos, vec), from their own vectors: what
    steps walk is known without the edges that they don't."""
    w = Window.partitionBy("thread_id").orderBy("ord")
    steps = members.select(F.lag("pos").over(w).alias("src"), F.col("pos").alias("dst"), F.lag("vec").over(w).alias("u"), "vec", F.lag("part").over(w).alias("p"), "part")
    d = F.round(1 - dot(unit(F.col("u")), unit(F.col("vec"))), DIGITS)
    return steps.filter("src < dst and p = part").select("src", "dst", d.alias("d")).filter(F.col("d") < limit)


def _steps(members: DataFrame) -> DataFrame:
    """(thread_id, src, dst): each member (thread_id, ord, pos) with the one before it, null for the first."""
    before = F.lag("pos").over(Window.partitionBy("thread_id").orderBy("ord"))
    return materialize(members.select("thread_id", before.alias("src"), F.col("pos").alias("dst")), "steps")


def _walked(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that steps walk: there are at most as many steps as members, so edges are looked up among them where they stand."""
    own = steps.filter("src is not null").select("src", "dst").distinct()
    return edges.join(F.broadcast(own) if steps.count() <= 4_000_000 else own, ["src", "dst"])


def path_score(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(thread_id, score): mean weight (src, dst, d) of the edges that consecutive members (thread_id, ord, pos) walk."""
    steps = _steps(members)
    return steps.join(_walked(steps, edges.select("src", "dst", "d")), ["src", "dst"], "left").groupBy("thread_id").agg(F.avg("d").alias("score"))


def is_path(members: DataFrame, edges: DataFrame) -> DataFrame:
    """thread ids all of whose consecutive members (thread_id, ord, pos) are joined by an edge (src, dst)."""
    steps = _steps(members)
    missing = steps.filter("src is not null").join(_walked(steps, edges.select("src", "dst")), ["src", "dst"], "left_anti").select("thread_id").distinct()
    return members.select("thread_id").distinct().join(missing, "thread_id", "left_anti")


def summary(threads: DataFrame) -> DataFrame:
    """Threads, mean length and mean similarity (threads without one left out) of (thread_id, length, sim)."""
    return threads.agg(F.count("*").alias("threads"), F.avg("length").alias("mean_length"), F.avg("sim").alias("mean_sim"))


def first_wins(members: DataFrame) -> DataFrame:
    """Each document with the first thread (smallest thread_id) that holds it."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("thread_id"))
    return members.withColumn("__first", first).filter("__first = 1").drop("__first")


def first_wins_min_length(members: DataFrame, min_len: int) -> DataFrame:
    """First wins, where a thread that gets fewer than ``min_len`` new documents claims none.

    Each claim depends on those of earlier threads that share a document, directly or over others, and on no
    other: threads are folded in order within each such component, so components are independent tasks.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, own in rows.sort_values(["thread_id", "ord"]).groupby("thread_id", sort=True):
            new = own[~own["doc_id"].isin(taken)].drop_duplicates("doc_id")
            if len(new) >= max(min_len, 1):
                taken.update(new["doc_id"])
                out.append(new)
        found = pd.concat(out) if out else rows.head(0)
        return found[["thread_id", "ord", "doc_id"]]

    ids = materialize(members.select("thread_id", "ord", "doc_id"), "claims")
    merged = merged_threads(ids.select("thread_id", F.col("doc_id").alias("doc")))
    return ids.join(merged, "thread_id").groupBy("merged").applyInPandas(fold, ids.schema)


def thread_stats(members: DataFrame) -> DataFrame:
    """(thread_id, length, days, sensitive) of members with created and label."""
    return members.groupBy("thread_id").agg(
        F.count("*").alias("length"), ((F.max("created").cast("double") - F.min("created").cast("double")) / 86400).alias("days"), F.sum("label").alias("sensitive")
    )


def evaluation(members: DataFrame, unique: bool = True) -> DataFrame:
    """One row: documents, sensitive documents, threads, mean length and days, threads all sensitive.

    With ``unique`` a document counts for its first thread only; else for all threads, and documents
    are counted once.
    """
    own = first_wins(members) if unique else members
    stats = thread_stats(own)
    docs = own.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct(F.when(F.col("label") == 1, F.col("doc_id"))).alias("sensitive_docs"))
    threads = stats.agg(
        F.count("*").alias("threads"), F.avg("length").alias("mean_length"), F.avg("days").alias("mean_days"),
        F.sum((F.col("sensitive") == F.col("length")).cast("long")).alias("all_sensitive"),
    )
    return docs.crossJoin(threads)  # one row each


def ratio_bins(stats: DataFrame, bins: int = 4) -> DataFrame:
    """(bin, threads, mean, sd) of the share of sensitive members; the last bin is closed."""
    ratio = F.col("sensitive") / F.col("length")
    own = stats.select(ratio.alias("ratio"), F.least(F.floor(ratio * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return own.groupBy("bin").agg(F.count("*").alias("threads"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd"))


def filter_threads(stats: DataFrame, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Rows whose columns lie in inclusive ranges; null bounds don't count, null values fail where there is one."""
    for name, (low, high) in ranges.items():
        if low is not None:
            stats = stats.filter(F.col(name) >= low)
        if high is not None:
            stats = stats.filter(F.col(name) <= high)
    return stats


def tf_idf(terms: DataFrame, doc: str = "doc", term: str = "term", max_df: float = 0.9, max_terms: int | None = None) -> DataFrame:
    """(doc, term, w) of token rows: count times ln((1 + N) / (1 + df)) + 1, rows of length 1.

    Terms in more than max_df of all documents go; of the rest, the ``max_terms`` most frequent stay.
    """
    counts = materialize(terms.groupBy(doc, term).agg(F.count("*").alias("tf")), "term-counts")  # read three times, counted once
    n = counts.agg(F.countDistinct(doc).alias("n"))
    df = counts.groupBy(term).agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n)).filter(F.col("df") <= max_df * F.col("n"))
    if max_terms is not None:
        df = df.orderBy(F.desc("total"), term).limit(max_terms)
    raw = counts.join(df, term).select(doc, term, (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    size = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.select(doc, term, (F.col("raw") / size).alias("w"))


#: Terms whose weights a worker may hold by name; of larger vocabularies it holds as many of the rest by their hash (10 bytes or so
#: each). Those in one passage only needn't be held. What is left beyond that is joined, only where it occurs.
VOCABULARY, HASHED = 500_000, 30_000_000


def _hash(terms: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(terms, object), categorize=False)


def _hashed(rare: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """Of all terms (term, df) that aren't held by name: the hashes of those in more than one passage, sorted, and their documents; terms
    that share their hash with another are given by name. So no other term is ever taken for a hashed one. None if they are too many."""
    if rare.filter("df > 1").count() > HASHED:
        return None

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"term": batch["term"], "h": _hash(batch["term"].tolist()).view(np.int64), "df": batch["df"]})

    keys = rare.mapInPandas(keyed, "term string, h long, df long")
    own = materialize(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("df").alias("df")).filter("n > 1 or df > 1"), "term-hashes")
    shared = [r["h"] for r in own.filter("n > 1").collect()]  # next to none of 64 bits
    named = {r["term"]: r["df"] for r in keys.filter(F.col("h").isin(shared)).collect()} if shared else {}
    found = own.filter("n = 1").select("h", "df").toPandas()
    h, df = found["h"].to_numpy(np.int64).view(np.uint64), found["df"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], df[order].astype(np.min_scalar_type(int(df.max(initial=1)))), named


def _counted(passages: DataFrame, max_df: float, max_terms: int | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Passages by id, the documents of each term that counts and of each that is too common, and the number of passages."""
    rows = passages.select("doc", F.filter("terms", lambda t: t != "").alias("terms")).filter(F.size("terms") > 0)
    ids = rows.agg(F.count("*").alias("n"), F.countDistinct("doc").alias("ids")).first()
    if ids["n"] != ids["ids"]:
        rows = materialize(rows.groupBy("doc").agg(F.flatten(F.collect_list("terms")).alias("terms")), "repeated-passages")
    n = ids["ids"]
    every = materialize(rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term-documents")
    df, common = every.filter(F.col("df") <= max_df * n), every.filter(F.col("df") > max_df * n)
    if max_terms is not None:
        total = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("total"))
        df = df.join(total, "term").orderBy(F.desc("total"), "term").limit(max_terms)
    return rows, df, common, n


def passage_vectors(passages: DataFrame, max_df: float = 0.9, max_terms: int | None = None) -> tuple[DataFrame, list[str]] | None:
    """The weights of :func:`passage_weights` as a row a passage (doc, terms, w), terms by their place in the vocabulary, which is
    given beside them; None where it has more than ``VOCABULARY`` terms. Passages without a term that counts have no row."""
    rows, df, _, n = _counted(passages, max_df, max_terms)
    if df.count() > VOCABULARY:
        return None
    found = sorted(tuple(r) for r in df.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect())
    held = rows.sparkSession.sparkContext.broadcast(({t: k for k, (t, _) in enumerate(found)}, np.array([x for _, x in found])))

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, idf = held.value
        for batch in batches:
            for lo in range(0, len(batch), 500):
                docs, terms, weights = [], [], []
                for doc, words in zip(batch["doc"].iloc[lo : lo + 500], batch["terms"].iloc[lo : lo + 500], strict=True):
                    own = {place[t]: k for t, k in Counter(words).items() if t in place}
                    if own:
                        at = np.fromiter(own, np.int32, len(own))
                        raw = np.fromiter(own.values(), float, len(own)) * idf[at]
                        docs.append(doc)
                        terms.append(at)
                        weights.append(raw / math.sqrt(raw @ raw))
                yield pd.DataFrame({"doc": docs, "terms": terms, "w": weights})

    return rows.mapInPandas(weighed, "doc string, terms array<int>, w array<double>"), [t for t, _ in found]


def _looked_up(terms: set[str], keys: np.ndarray, documents: np.ndarray, idf: np.ndarray) -> dict[str, float]:
    """The weights of those of the terms whose hashes are in ``keys``."""
    if not terms or not len(keys):
        return {}
    names = list(terms)
    h = _hash(names)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return {names[k]: idf[documents[at[k]]] for k in np.flatnonzero(keys[at] == h)}


def _weighed(passages: DataFrame, max_df: float, max_terms: int | None, whole: bool) -> DataFrame:
    """Weights of passages (doc, terms): (doc, terms, w) if ``whole``, else (doc, term, w)."""
    rows, df, common, n = _counted(passages, max_df, max_terms)
    idf, default, rest = (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"), None, None
    held, hashed = {}, None
    if df.count() > VOCABULARY:
        df = df if max_terms is None else materialize(df, "vocabulary")
        seen, least = 0, None  # terms of ``least`` passages or more are held
        for k, terms in sorted(((r["df"], r["n"]) for r in df.groupBy("df").agg(F.count("*").alias("n")).collect()), reverse=True):
            seen += terms
            if seen > VOCABULARY:
                least = k + 1
                break
        held = {r["term"]: None for r in common.collect()}  # at most the mean number of a passage's terms over max_df
        if max_terms is None and least > 2:
            hashed = _hashed(df.filter(F.col("df") < least))
        if max_terms is None and (least == 2 or hashed is not None):
            default = math.log((1 + n) / 2) + 1  # whatever isn't held is in one passage
        else:
            rest = df.filter(F.col("df") < least).select("term", idf)
        df = df.filter(F.col("df") >= least)
    held |= {r["term"]: r["idf"] for r in df.select("term", idf).collect()}  # VOCABULARY rows at most
    if hashed is not None:
        keys, documents, named = hashed
        held |= {t: math.log((1 + n) / (1 + k)) + 1 for t, k in named.items()}
        hashed = keys, documents, np.log((1 + n) / (1.0 + np.arange(int(documents.max(initial=1)) + 1))) + 1
    sent = rows.sparkSession.sparkContext.broadcast((held, hashed))
    joined = rest is not None
    if joined:

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, _ = sent.value
            for batch in batches:
                for lo in range(0, len(batch), 500):
                    found = [(d, t, k) for d, words in zip(batch["doc"].iloc[lo : lo + 500], batch["terms"].iloc[lo : lo + 500], strict=True) for t, k in Counter(words).items() if t not in known]
                    yield pd.DataFrame(found, columns=["doc", "term", "tf"])

        raw = rows.mapInPandas(others, "doc string, term string, tf long").join(rest, "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("raw")))).alias("v"))
        rows = rows.join(raw.select("doc", F.col("v.term").alias("others"), F.col("v.raw").alias("raw")), "doc", "left")

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hashed = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                docs, terms, weights = [], [], []
                more = zip(part["others"], part["raw"], strict=True) if joined else ((None, None) for _ in range(len(part)))
                counts = [Counter(words) for words in part["terms"]]
                rare = _looked_up({t for c in counts for t in c if t not in own}, *hashed) if hashed is not None else {}
                for doc, words, (names, values) in zip(part["doc"], counts, more, strict=True):
                    raw = {t: k * x for t, k in words.items() if (x := own[t] if t in own else rare.get(t, default)) is not None}
                    if names is not None:
                        raw.update(zip(names, values, strict=True))
                    if raw:
                        size = math.sqrt(math.fsum(x * x for x in raw.values()))  # the same in any order, so that equal passages have equal weights
                        docs.append(doc)
                        terms.append(list(raw))
                        weights.append([x / size for x in raw.values()])
                if whole:
                    yield pd.DataFrame({"doc": docs, "terms": terms, "w": weights})
                else:
                    yield pd.DataFrame({"doc": np.repeat(np.array(docs, object), [len(t) for t in terms]), "term": np.array([t for own in terms for t in own], object), "w": np.array([x for own in weights for x in own], float)})

    return rows.mapInPandas(weighed, "doc string, terms array<string>, w array<double>" if whole else "doc string, term string, w double")


def passage_weights(passages: DataFrame, max_df: float = 0.9, max_terms: int | None = None) -> DataFrame:
    """:func:`tf_idf` of passages (doc, terms), whose terms are an array with repeats: (doc, term, w).

    Documents of a term are counted map-side, and a passage's weights are found where it stands, from the terms' own; neither tokens
    nor weights are shuffled. Passages that repeat an id are put together first. Of vocabularies of more than ``VOCABULARY`` terms the
    most frequent are held by name and others by hash; what isn't held is in one passage. Only where more than ``HASHED`` others are in
    several passages, or terms are bounded, those that aren't held are joined where they occur and each passage is shuffled once.
    """
    return _weighed(passages, max_df, max_terms, whole=False)


def passage_rows(passages: DataFrame, max_df: float = 0.9, max_terms: int | None = None) -> DataFrame:
    """The same weights as a row a passage: (doc, terms, w). Passages without a term that counts have no row."""
    return _weighed(passages, max_df, max_terms, whole=True)


def sparse_cosine(weights: DataFrame, threshold: float = 0.2, include_self: bool = False) -> DataFrame:
    """:func:`~strand.operators.sparse.cosine_pairs` of weights as rows (doc, term, w), put together by document."""
    rows = weights.groupBy("doc").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    return sparse.cosine_pairs(rows.select("doc", F.col("v.term").alias("terms"), F.col("v.w").alias("w")), threshold, include_self)


def keywords(terms: DataFrame, weights: DataFrame, top_n: int | None = 3, max_df: float = 0.9) -> DataFrame:
    """(thread_id, rank, word, score): terms by log softmax of in-thread document share plus log softmax of
    mean weight, both over the whole vocabulary.

    ``terms`` is (thread_id, doc, term), ``weights`` (doc, term, w). Terms a thread lacks count as 0 in both sums.
    """
    docs = terms.select("thread_id", "doc").distinct()
    share = terms.select("thread_id", "doc", "term").distinct().groupBy("thread_id", "term").agg(F.count("*").alias("in"))
    mean = docs.join(weights, "doc").groupBy("thread_id", "term").agg(F.sum("w").alias("sum")).join(share, ["thread_id", "term"], "left")
    return _scored_words(mean, docs.groupBy("thread_id").agg(F.count("*").alias("n")), weights.select("term").distinct().agg(F.count("*").alias("v")), top_n, max_df)


def keywords_of_passages(weights: DataFrame, docs: DataFrame, top_n: int | None = 3, max_df: float = 0.9) -> DataFrame:
    """The same where a passage is in one thread: ``weights`` is (thread_id, doc, term, w), ``docs`` (thread_id, n), the passages of each thread.

    A row of ``weights`` is a passage that has the term, so sums and shares come from one pass that is aggregated map-side; passages
    meet neither their tokens nor their weights.
    """
    mean = materialize(weights.groupBy("thread_id", "term").agg(F.sum("w").alias("sum"), F.count("*").alias("in")), "thread-terms")
    return _scored_words(mean, docs, mean.select("term").distinct().agg(F.count("*").alias("v")), top_n, max_df)


def _a_row_a_thread(rows: DataFrame, name: str) -> DataFrame:
    """Written, and sent to all terms where threads are few: else all terms of a thread would meet in one task."""
    rows = materialize(rows, name)
    return F.broadcast(rows) if rows.count() <= 200_000 else rows


def _scored_words(mean: DataFrame, n: DataFrame, size: DataFrame, top_n: int | None, max_df: float) -> DataFrame:
    n = _a_row_a_thread(n, "thread-sizes")
    both = mean.join(n, "thread_id").select(
        "thread_id", "term", F.abs(F.col("sum") / F.col("n")).alias("y"),
        F.when(F.col("in") / F.col("n") >= max_df, 0.0).otherwise(F.coalesce(F.col("in") / F.col("n"), F.lit(0.0))).alias("x"),
    )
    sums = both.groupBy("thread_id").agg(F.sum(F.exp("x")).alias("ex"), F.sum(F.exp("y")).alias("ey"), F.count("*").alias("k")).crossJoin(F.broadcast(size))
    sums = _a_row_a_thread(sums, "thread-sums")
    score = F.col("x") - F.log(F.col("ex") + F.col("v") - F.col("k")) + F.col("y") - F.log(F.col("ey") + F.col("v") - F.col("k"))
    scored = both.join(sums, "thread_id").select("thread_id", F.col("term").alias("word"), F.round(score, 9).alias("score"))
    if top_n is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top_n)


def keyword_table(found: DataFrame) -> DataFrame:
    """(word, threads, mean_weight, thread_ids) of keywords (thread_id, word, score)."""
    return found.groupBy("word").agg(F.count("*").alias("threads"), F.avg("score").alias("mean_weight"), F.array_sort(F.collect_list("thread_id")).alias("thread_ids"))


def thread_table(members: DataFrame, found: DataFrame) -> DataFrame:
    """(thread_id, length, days, keywords, keyword_weight); the weight's divisor is 3 whatever the number of keywords."""
    words = found.groupBy("thread_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("keywords"), (F.sum("score") / 3).alias("keyword_weight")
    )
    stats = members.groupBy("thread_id").agg(F.count("*").alias("length"), ((F.max("created").cast("double") - F.min("created").cast("double")) / 86400).alias("days"))
    return stats.join(words, "thread_id", "left")
