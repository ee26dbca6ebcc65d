"""Structured Streaming jobs: resumable extraction, a graph that grows, dialogues resolved turn by turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strand.operators.graph import blocked_edges, npc
from strand.plans.cut import exists


def ledger_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "doc_id"):
    """Each new id is transformed once and appended: ids that the output already holds are left out, so a
    batch that is repeated after a failure writes nothing twice. Runs what is there and stops."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if exists(spark, out):
            rows = rows.join(spark.read.parquet(out).select(key), key, "left_anti")
        transform(rows).write.mode("append").parquet(out)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cross_edges(batch: DataFrame, history: DataFrame, limit: float, block: int = 1024, parents: bool = False) -> DataFrame:
    """Edges below ``limit`` of a batch (part, pos, vec) with itself and with history, forward in position:
    late items attach backwards, as positions decide and not arrival.

    Rows are dealt into tiles of positions as for all edges; pairs of tiles or blocks without new rows don't meet. ``parents``: those
    that communities need, as in :func:`blocked_edges`.
    """
    rows = batch.select("part", "pos", "vec", F.lit(1).alias("fresh")).unionByName(history.select("part", "pos", "vec", F.lit(0).alias("fresh")))
    return blocked_edges(rows, limit, block, parents=parents)


def growing_graph(source: DataFrame, out: str, checkpoint: str, limit: float = 0.7):
    """Appends items, and the edges that communities need, under ``out``; communities are read with :func:`communities`."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items, edges = f"{out}/items", f"{out}/edges"
        history = batch.select("part", "pos", "vec").limit(0)
        if exists(spark, items):
            history = spark.read.parquet(items).filter(F.col("batch") != batch_id).select("part", "pos", "vec")
        cross_edges(batch, history, limit, parents=True).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{edges}/b={batch_id}")
        batch.select("part", "pos", "vec").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{items}/b={batch_id}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def communities(spark: SparkSession, out: str) -> DataFrame:
    """An edge that is there twice changes nothing: the smallest counts."""
    return npc(spark.read.parquet(f"{out}/edges").select("part", "src", "dst", "d"))


def _linked(conv: int, rows: pd.DataFrame, seen: dict[str, int], window: int) -> tuple[pd.DataFrame, dict[str, int]]:
    """Capitalised words of utterances with the turn of their last use, and what is retained after them."""
    out = []
    for turn, text in zip(rows["turn"].tolist(), rows["text"], strict=True):
        words = sorted(filter(None, {w.strip(".,;:!?") for w in (text or "").split() if w[:1].isupper()}))
        out += [(conv, turn, w, seen.get(w)) for w in words]
        seen = {w: t for w, t in {**seen, **dict.fromkeys(words, turn)}.items() if t > turn - window}
    return pd.DataFrame(out, columns=["conv_id", "turn", "word", "antecedent_turn"]).astype({"antecedent_turn": "Int64"}), seen


_LINKED = "conv_id long, turn long, word string, antecedent_turn long"


def resolve_dialogue(utterances: DataFrame, window: int = 20) -> DataFrame:
    """(conv_id, turn, word, antecedent_turn): capitalised words of each utterance linked to their last use
    among the last ``window`` turns of the conversation.

    On a stream what is retained is kept as state between batches; a batch call reads each
    conversation whole, in order of turns, and gives the same rows.
    """
    if not utterances.isStreaming:
        whole = lambda key, rows: _linked(int(key[0]), rows.sort_values("turn"), {}, window)[0]
        return utterances.groupBy("conv_id").applyInPandas(whole, _LINKED)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        found, seen = _linked(int(key[0]), pd.concat(list(batches)).sort_values("turn"), seen, window)
        state.update((list(seen), list(seen.values())))
        yield found

    return utterances.groupBy("conv_id").applyInPandasWithState(step, _LINKED, "words array<string>, turns array<long>", "append", GroupStateTimeout.NoTimeout)
