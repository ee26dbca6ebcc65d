"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strand.operators.passages import with_position

from .common import attach_groups, materialize, n_words

MAX_RATE = 3


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE, cycle: int = 3) -> DataFrame:
    """``sizes`` (source, source_size, ...) with target.

    Weights 1 to ``cycle`` repeat in code point order of the sources, null last. Shares of all sizes
    stop at max_rate times the source's size and the excess goes to the others by weight: one water level,
    found in rounds. Each round caps the sources that the level of the others reaches, which lifts it,
    until it reaches no more; a round is one sum over the sources, whose number isn't bounded.
    """
    weighed = with_position(sizes, None, F.col("source").asc_nulls_last(), name="place").withColumns(
        {"weight": F.pmod("place", F.lit(cycle)) + 1, "cap": F.col("source_size") * max_rate}
    ).drop("place")
    rows = materialize(weighed, "mix-weights")
    total, weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, rest_weight = total or 0, weights or 0
    while rest_weight:
        # in whole numbers of up to 38 digits: the level of all that isn't capped reaches the cap
        reached = F.col("cap").cast("decimal(22,0)") * F.lit(rest_weight).cast("decimal(15,0)") <= F.lit(rest).cast("decimal(22,0)") * F.col("weight").cast("decimal(15,0)")
        caps, capped = rows.filter(reached).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - caps, weights - capped) == (rest, rest_weight):
            break
        rest, rest_weight = total - caps, weights - capped
    level = float(rest) / float(rest_weight) if rest_weight else 0.0
    below = F.lit(True) if not rest_weight else reached
    target = F.when(below, F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * F.lit(level))
    return rows.withColumn("target", target).drop("weight", "cap")


def _taken(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (all columns of ``docs``), size, source_size, target and copies."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    source = F.col(source_col)
    # a key that is never null; a null source is apart from any text
    key = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))
    sized = docs.select(row, source.alias("source"), key.alias("key"), F.col(id_col).cast("string").alias("id"), n_words(text_col).alias("size"))
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialize(source_targets(sizes).select("key", "source_size", "target", "rows"), "mix-sources")
    total = targets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    joined = attach_groups(sized, targets, "key", "rows", total)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("id", F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_RATE)))).otherwise(0.0)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (times that the mix takes it).

    A source's repetition rate is target / size. A document is taken floor(rate) times and once more
    with probability rate - floor(rate), decided by a hash of its id and ``seed``: reruns agree and no
    row waits for another. Sizes are summed map-side, so a source with a third of all rows is one row
    a task; targets of large sources are broadcast (1000 at most), others meet their rows in a shuffle.

    Null text has size 0, a null source is a source of its own (last), a null id hashes as the word
    null; rows that repeat an id draw alike. A source of size 0 has target and copies 0. No rows give no
    rows. Columns of docs pass through, but those of the four names are replaced.
    """
    names = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in {f"mix_{n}" for n in names}]
    return _taken(docs, seed, id_col, text_col, source_col).select(*[F.col("row")[c].alias(c) for c in kept], *[F.col(n).alias(f"mix_{n}") for n in names])


def mix_sources(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns whatever their names.
    Nulls, repeated ids and empty tables as in :func:`mixed`."""
    taken = _taken(docs, seed, id_col, text_col, source_col).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
