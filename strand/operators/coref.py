"""Coreference: candidate pairs, features, decisions, clusters, metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strand.functions.vectors import distance_bin, distance_share

#: Mention types in order of how well they represent an entity, best first (fixed values).
TYPES = ("PROPER", "NOMINAL", "PRONOMINAL", "LIST")
PRONOUNS = tuple("i me my mine you your yours he him his she her hers it its we us our they them their this that these those".split())


def mention_type(tag: Column, text: Column) -> Column:
    """LIST for coordinations, PRONOMINAL for pronouns, PROPER for names, NOMINAL for the rest."""
    return (
        F.when(F.rlike(F.lower(text), F.lit(r"\b(and|or)\b|,")), "LIST")
        .when(tag.startswith("PRP") | F.lower(text).isin(*PRONOUNS), "PRONOMINAL")
        .when(tag.startswith("NNP"), "PROPER").otherwise("NOMINAL")
    )


#: Tags and dependencies of mentions' roots, tags that no dependency redeems, and pronouns that can be left out (fixed values).
KEPT_TAGS = ("NN", "NNP", "NNPS", "NNS", "PRP", "PRP$", "DT", "IN")
KEPT_DEPS = ("nsubj", "dobj", "iobj", "pobj")
BARRED_TAGS = ("CC", "TO")
PRONOUN_BLACKLIST = ("i", "me", "my", "you", "your")


def mention_allowed(tag: Column, dep: Column, text: Column, blacklist: bool = True) -> Column:
    """Roots of mentions: noun, pronoun or determiner tags, or kept dependencies; listed pronouns are left out if ``blacklist``."""
    kept = tag.isin(*KEPT_TAGS) | (dep.isin(*KEPT_DEPS) & ~tag.isin(*BARRED_TAGS))
    return kept & ~F.lower(text).isin(*PRONOUN_BLACKLIST) if blacklist else kept


def with_ordinals(mentions: DataFrame, *order: str) -> DataFrame:
    """Ordinal ``i`` from 0 and normalised location of each mention in its document."""
    w = Window.partitionBy("doc")
    i = F.row_number().over(w.orderBy(*order)) - 1
    return mentions.withColumns({"i": i, "n": F.count("*").over(w)}).withColumn("location", F.col("i") / F.col("n"))


def candidate_pairs(mentions: DataFrame, max_dist: int = 50, max_dist_match: int | None = 500) -> DataFrame:
    """(doc, ant, men): mentions with the max_dist before them, and with earlier ones that share a content
    word within max_dist_match.

    A near mention is found by slots of max_dist ordinals, a word by an equi-join: a union of two
    joins in place of one with an OR. ``mentions`` is (doc, i, words).
    """
    slot = F.floor(F.col("i") / max_dist)
    later = mentions.select("doc", F.col("i").alias("men"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    earlier = mentions.select("doc", F.col("i").alias("ant"), slot.alias("slot"))
    near = later.join(earlier, ["doc", "slot"]).filter((F.col("ant") < F.col("men")) & (F.col("men") - F.col("ant") <= max_dist)).select("doc", "ant", "men")
    if max_dist_match is None:
        return near
    words = mentions.select("doc", "i", F.explode(F.array_distinct("words")).alias("word"))
    a, b = words.withColumnRenamed("i", "ant"), words.withColumnRenamed("i", "men")
    alike = a.join(b, ["doc", "word"]).filter((F.col("ant") < F.col("men")) & (F.col("men") - F.col("ant") <= max_dist_match)).select("doc", "ant", "men")
    return near.unionByName(alike).distinct()


def pair_features(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Features of pairs from mentions (doc, i, sent, start, end, speaker, root, text, words)."""
    cols = [c for c in ("sent", "start", "end", "speaker", "root", "text", "words")]
    a = mentions.select("doc", F.col("i").alias("ant"), *[F.col(c).alias(f"a_{c}") for c in cols])
    m = mentions.select("doc", F.col("i").alias("men"), *[F.col(c).alias(f"m_{c}") for c in cols])
    both = pairs.join(a, ["doc", "ant"]).join(m, ["doc", "men"])
    return both.select(
        "doc", "ant", "men", (F.col("a_speaker") == F.col("m_speaker")).cast("int").alias("same_speaker"),
        heads_agree().cast("int").alias("heads_agree"), exact_match().cast("int").alias("exact"), relaxed_match().cast("int").alias("relaxed"),
        distance_bin(F.col("m_sent") - F.col("a_sent")).alias("sent_bin"), distance_share(F.col("m_sent") - F.col("a_sent")).alias("sent_share"),
        distance_bin(F.col("men") - F.col("ant") - 1).alias("mention_bin"), (F.col("m_start") < F.col("a_end")).cast("int").alias("overlap"),
    )


def heads_agree() -> Column:
    return F.lower("a_root") == F.lower("m_root")


def exact_match() -> Column:
    return F.lower("a_text") == F.lower("m_text")


def relaxed_match() -> Column:
    return F.coalesce(F.arrays_overlap("a_words", "m_words"), F.lit(False))


def best_antecedents(scores: DataFrame, singles: DataFrame, greedyness: float = 0.5) -> DataFrame:
    """(doc, men, ant): the antecedent of the highest score, if that beats the mention's own; ties to the nearest.

    ``scores`` is (doc, ant, men, score), ``singles`` (doc, men, self).
    """
    best = scores.groupBy("doc", "men").agg(F.max(F.struct("score", "ant")).alias("best"))
    return singles.join(best, ["doc", "men"]).filter(F.col("best.score") > F.col("self") - 50 * (greedyness - 0.5)).select("doc", "men", "best.ant")


def most_representative(mentions: DataFrame) -> DataFrame:
    """(doc, cluster, i): best type first, then the longest text, then the earliest."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), F.lit(len(TYPES) + 1))
    return mentions.groupBy("doc", "cluster").agg(F.min_by("i", F.struct(rank, -F.length("text"), F.col("i"))).alias("i"))


def resolved_text(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc, text): tokens (doc, tok, word) with each mention (doc, start, end, main) replaced by its main text.

    The first token of a mention carries the replacement, the others go; mentions must not overlap.
    """
    covered = mentions.select("doc", "start", "main", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("tok"))
    hit = tokens.join(covered, ["doc", "tok"], "left")
    word = F.when(F.col("start").isNull(), F.col("word")).when(F.col("tok") == F.col("start"), F.col("main"))
    kept = hit.select("doc", "tok", word.alias("word")).filter("word is not null")
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "word"))), lambda x: x["word"]), " ").alias("text"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of rows of the same keys whose ranges [b, e) overlap, with what else the rows hold.

    An equi-join on the keys and on stretches of ``width`` that a range touches; a pair counts in the first
    stretch that both touch, so long texts cost no more than their overlaps.
    """
    first = F.floor(F.col("b") / width).cast("long")
    touched = F.sequence(first, F.floor((F.greatest(F.col("e"), F.col("b") + 1) - 1) / width).cast("long"))
    a = left.withColumns({"first_l": first, "stretch": F.explode(touched)}).withColumnsRenamed({"b": "b_l", "e": "e_l"})
    c = right.withColumns({"first_r": first, "stretch": F.explode(touched)}).withColumnsRenamed({"b": "b_r", "e": "e_r"})
    met = a.join(c, [*keys, "stretch"]).filter((F.col("b_r") < F.col("e_l")) & (F.col("b_l") < F.col("e_r")))
    return met.filter(F.col("stretch") == F.greatest("first_l", "first_r"))


# ---- metrics: key and response are (case, mention, cluster) ------------------------------------------


def _once(rows: DataFrame) -> DataFrame:
    """A mention counts in its first cluster only."""
    return rows.groupBy("case", "mention").agg(F.min("cluster").alias("cluster"))


def _overlaps(key: DataFrame, response: DataFrame) -> DataFrame:
    """(case, k, r, shared): how many mentions a key and a response cluster share."""
    k = _once(key).withColumnRenamed("cluster", "k")
    r = _once(response).withColumnRenamed("cluster", "r")
    return k.join(r, ["case", "mention"]).groupBy("case", "k", "r").agg(F.count("*").alias("shared"))


def _sizes(rows: DataFrame, name: str) -> DataFrame:
    return _once(rows).groupBy("case", F.col("cluster").alias(name)).agg(F.count("*").alias("size"))


def muc(key: DataFrame, response: DataFrame) -> DataFrame:
    """(case, rn, rd): links of the key that the response's partition keeps. Swap arguments for precision."""
    parts = _overlaps(key, response).groupBy("case", "k").agg(F.count("*").alias("parts"), F.sum("shared").alias("found"))
    own = _sizes(key, "k").join(parts, ["case", "k"], "left")
    pieces = F.coalesce("parts", F.lit(0)) + F.col("size") - F.coalesce("found", F.lit(0))  # a lost mention is a part of its own
    return own.groupBy("case").agg(F.sum(F.col("size") - pieces).cast("double").alias("rn"), F.sum(F.col("size") - 1).cast("double").alias("rd"))


def b_cubed(key: DataFrame, response: DataFrame) -> DataFrame:
    """(case, rn, rd): each key mention's share of its cluster that its response cluster holds."""
    own = _sizes(key, "k")
    hits = _overlaps(key, response).join(own, ["case", "k"]).groupBy("case").agg(F.sum(F.col("shared") * F.col("shared") / F.col("size")).alias("rn"))
    return own.groupBy("case").agg(F.sum("size").cast("double").alias("rd")).join(hits, "case", "left").select("case", F.coalesce("rn", F.lit(0.0)).alias("rn"), "rd")


def best_assignment(weights: np.ndarray) -> float:
    """Largest total weight of a one-to-one assignment: successive shortest augmenting paths with potentials."""
    if not weights.size:
        return 0.0
    cost = -weights if weights.shape[0] <= weights.shape[1] else -weights.T
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j]:
            used[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            free = ~used[1:]
            closer = free & (slack < low[1:])
            low[1:][closer], way[1:][closer] = slack[closer], j
            nearest = np.where(free, low[1:], np.inf)
            step = int(nearest.argmin()) + 1
            delta = low[step]
            u[match[used]] += delta
            v[used] -= delta
            low[1:][free] -= delta
            j = step
        while j:
            match[j], j = match[way[j]], way[j]
    return float(-sum(cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


def ceaf(key: DataFrame, response: DataFrame, entity: bool) -> DataFrame:
    """(case, total, recall_of, precision_of): best one-to-one alignment of clusters, by shared mentions or by
    their share of both sizes."""
    k, r = _sizes(key, "k"), _sizes(response, "r")
    pairs = _overlaps(key, response).join(k.withColumnRenamed("size", "ks"), ["case", "k"]).join(r.withColumnRenamed("size", "rs"), ["case", "r"])
    phi = 2 * F.col("shared") / (F.col("ks") + F.col("rs")) if entity else F.col("shared").cast("double")

    @F.pandas_udf("double")
    def align(batch: pd.Series) -> pd.Series:
        out = []
        for cells in batch:
            rows, columns = ({x: i for i, x in enumerate(dict.fromkeys(c[name] for c in cells))} for name in ("k", "r"))
            grid = np.zeros((len(rows), len(columns)))
            for c in cells:
                grid[rows[c["k"]], columns[c["r"]]] = c["phi"]
            out.append(best_assignment(grid))
        return pd.Series(out)

    cells = F.collect_list(F.struct(F.col("k"), F.col("r"), phi.alias("phi")))
    total = pairs.groupBy("case").agg(cells.alias("cells")).select("case", align("cells").alias("total"))
    size = F.count("*") if entity else F.sum("size")
    return (
        k.groupBy("case").agg(size.cast("double").alias("recall_of")).join(r.groupBy("case").agg(size.cast("double").alias("precision_of")), "case")
        .join(total, "case", "left").select("case", F.coalesce("total", F.lit(0.0)).alias("total"), "recall_of", "precision_of")
    )


def blanc(key: DataFrame, response: DataFrame) -> DataFrame:
    """(case, recall, precision, f1): coreference and non-coreference links, averaged; where one side's
    key and response have no link of a kind, the other kind alone counts."""
    pairs = lambda n: n * (n - 1) / 2
    k, r = _sizes(key, "k"), _sizes(response, "r")
    kc = k.groupBy("case").agg(F.sum(pairs(F.col("size"))).alias("kc"), pairs(F.sum("size")).alias("ka"))
    rc = r.groupBy("case").agg(F.sum(pairs(F.col("size"))).alias("rc"), pairs(F.sum("size")).alias("ra"))
    over = _overlaps(key, response)
    both = over.groupBy("case").agg(F.sum(pairs(F.col("shared"))).alias("bc"), pairs(F.sum("shared")).alias("ba"))
    in_k = over.groupBy("case", "k").agg(F.sum("shared").alias("s")).groupBy("case").agg(F.sum(pairs(F.col("s"))).alias("ik"))
    in_r = over.groupBy("case", "r").agg(F.sum("shared").alias("s")).groupBy("case").agg(F.sum(pairs(F.col("s"))).alias("ir"))
    all_ = kc.join(rc, "case").join(both, "case", "left").join(in_k, "case", "left").join(in_r, "case", "left").fillna(0)
    # non-links that both have: pairs of shared mentions, less those linked in either
    bn = F.col("ba") - F.col("ik") - F.col("ir") + F.col("bc")
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    kn, rn = F.col("ka") - F.col("kc"), F.col("ra") - F.col("rc")
    f = lambda p, q: F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    scores = all_.select(
        "case", "kc", kn.alias("kn"), share(F.col("bc"), F.col("kc")).alias("r_c"), share(F.col("bc"), F.col("rc")).alias("p_c"), share(bn, kn).alias("r_n"), share(bn, rn).alias("p_n")
    )
    mixed = lambda c, n: F.when(F.col("kc") == 0, n).when(F.col("kn") == 0, c).otherwise((c + n) / 2)
    return scores.select(
        "case", mixed(F.col("r_c"), F.col("r_n")).alias("recall"), mixed(F.col("p_c"), F.col("p_n")).alias("precision"),
        mixed(f(F.col("r_c"), F.col("p_c")), f(F.col("r_n"), F.col("p_n"))).alias("f1"),
    )


# ---- scoring -------------------------------------------------------------------------------------------


def linear_score(weights: dict[str, float], bias: float = 0.0) -> Column:
    """The default pair scorer: a linear one over feature columns."""
    total = F.lit(bias)
    for name, w in weights.items():
        total = total + w * F.col(name)
    return total


def mlp_scores(features: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], column: str = "x") -> DataFrame:
    """``features`` with a score from ReLU layers (weights, bias), the last one linear; weights go out by broadcast."""
    sent = features.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        h = np.stack(x.to_numpy())
        for k, (w, b) in enumerate(sent.value):
            h = h @ w + b
            if k < len(sent.value) - 1:
                h = np.maximum(h, 0)
        return pd.Series(h[:, 0])

    return features.withColumn("score", score(column))


def ranking_losses(scores: DataFrame) -> DataFrame:
    """(all_pairs, top_pairs, slack) losses of (doc, men, ant, score, gold, cost): ant -1 is the mention itself."""
    p = 1 / (1 + F.exp(-F.col("score")))
    safe = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    per = scores.withColumn("p", p).groupBy("doc", "men").agg(
        F.sum(F.when(F.col("gold") == 1, -safe(F.col("p"))).otherwise(-safe(1 - F.col("p")))).alias("every"),
        (-safe(F.coalesce(F.max(F.when(F.col("gold") == 1, F.col("p"))), F.lit(1.0))) - safe(1 - F.coalesce(F.max(F.when(F.col("gold") == 0, F.col("p"))), F.lit(0.0)))).alias("top"),
        F.max(F.when(F.col("gold") == 1, F.col("score"))).alias("best"),
    )
    joined = scores.join(per.select("doc", "men", "best"), ["doc", "men"])
    slack = joined.filter("best is not null").groupBy("doc", "men").agg(F.max(F.col("cost") * (1 + F.col("score") - F.col("best"))).alias("slack"))
    return per.join(slack, ["doc", "men"], "left").agg(F.sum("every").alias("all_pairs"), F.sum("top").alias("top_pairs"), F.sum(F.greatest("slack", F.lit(0.0))).alias("slack"))
