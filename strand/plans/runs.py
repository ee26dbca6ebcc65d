"""Whole runs: threads by nearest-parent communities, by hierarchical clustering, by determinantal sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strand.operators import cluster, graph, sdpp, threads
from strand.params import HyperParams
from strand.plans.cut import materialize


def _scored(members: DataFrame) -> DataFrame:
    members = materialize(members, "run-members")
    spans = members.groupBy("part", "thread_id").agg(F.count("*").alias("length"), F.min("created").alias("first"), F.max("created").alias("last"))
    return spans.join(threads.consecutive_similarity(members, keys=("part", "thread_id")), ["part", "thread_id"])


def hint(items: DataFrame, params: HyperParams = HyperParams(), time_decay: bool = False, incidence: DataFrame | None = None, community: str = "npc") -> DataFrame:
    """Threads of items (part, pos, doc_id, created, ts, vec): edges, weights by shared entities, communities, scores.

    With ``incidence`` (doc, entity; doc is pos) the edges below the threshold are weighted by shared
    entities or by passage hops. Parts never meet.
    """
    edges = graph.time_pruned_edges(items, params) if time_decay else graph.blocked_edges(items, params.weight_threshold)
    if incidence is not None:
        from strand.functions.vectors import entity_distance

        known = graph.edge_entities(edges, incidence, params.max_ent_between)
        path = F.col("hops") * 2
        w = entity_distance(F.col("d"), F.col("shared"), path, params.gamma, params.max_common_ent, params.max_ent_between)
        edges = known.select("part", "src", "dst", F.round(w, graph.DIGITS).alias("d"))
    edges = materialize(edges, "run-edges")
    found = graph.npc(edges) if community == "npc" else graph.louvain(edges.withColumn("d", 1 - F.col("d")))
    return _scored(threads.thread_members(found, items))


def seqint(items: DataFrame, params: HyperParams = HyperParams(), clusters_per_item: int | None = None) -> DataFrame:
    """Threads by complete linkage of decayed distances below 1, or by ward linkage into size // n clusters a part."""
    if clusters_per_item:
        labels = cluster.hac_part(items, per_item=clusters_per_item).withColumnRenamed("label", "comm")
    else:
        own = cluster.complete(graph.time_pruned_edges(items, params)).withColumnRenamed("label", "comm")
        labels = own.join(items.select("part", F.col("pos").alias("node")), "node").select("part", "node", "comm")
    return _scored(threads.thread_members(labels, items))


def dpp(items: DataFrame, epochs: int = 100, k: int = 20, length: int = 5) -> DataFrame:
    """Threads by determinantal sampling: distinct sequences, numbered, in time order, scored."""
    paths = sdpp.distinct_paths(sdpp.k_sdpp(items, epochs, k, length))
    named = paths.withColumn("thread_id", F.xxhash64(F.concat_ws(",", F.col("nodes").cast("array<string>"))))
    members = named.select("part", "thread_id", F.explode("nodes").alias("pos")).join(items, ["part", "pos"])
    return _scored(members)
