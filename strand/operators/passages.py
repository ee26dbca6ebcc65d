"""Passages: paragraphs of documents, sections, islands of lines, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strand.functions.text import squeeze, word_count


def split_passages(docs: DataFrame, min_words: int | None = 10, max_words: int | None = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(source_id, idx, doc_id, text): lines of documents within a word range.

    idx counts all lines of the document from 0, also those outside the range; doc_id is
    source_id and idx joined by an underscore.
    """
    lines = docs.select(F.col(id_col).alias("source_id"), F.posexplode(F.split(text_col, "\n")).alias("idx", "text"))
    words = word_count(F.col("text"))
    if min_words is not None:
        lines = lines.filter(words >= min_words)
    if max_words is not None:
        lines = lines.filter(words <= max_words)
    return lines.select("source_id", "idx", F.concat_ws("_", "source_id", "idx").alias("doc_id"), "text")


def with_position(rows: DataFrame, part_col: str | None, *order: str | Column, name: str = "pos") -> DataFrame:
    """``rows`` with a position from 0 by ``order``, counted over all rows or within a part.

    Over all rows the order is global: rows are range-partitioned, counted per partition, and each
    partition numbers its own rows from the count before it, so no task sees all rows.
    """
    if part_col:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(part_col).orderBy(*order)) - 1).cast("long"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from strand.plans.cut import materialize

    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "positions")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(sizes.select("__range", before.alias("__before")))  # one row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(base, "__range").withColumn(name, (F.col("__inside") + F.col("__before")).cast("long")).drop("__range", "__inside", "__before")


def with_part(rows: DataFrame, split_size: int, pos_col: str = "pos") -> DataFrame:
    """Half-open row ranges of ``split_size`` positions as part numbers."""
    return rows.withColumn("part", F.floor(F.col(pos_col) / split_size).cast("int"))


def parts_table(rows: DataFrame) -> DataFrame:
    """(part, start, end) of rows with part and pos."""
    return rows.groupBy("part").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def sections(lines: DataFrame, end_mark: str = "END", date_mark: str = "Document Date:") -> DataFrame:
    """Lines (doc_id, idx, text) after the first END line, with the date text of the block before it."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    started = F.max((F.trim("text") == end_mark).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    dated = F.when(F.col("text").contains(date_mark), F.trim(F.substring_index("text", date_mark, -1)))
    date = F.first(dated, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lines.select("doc_id", "idx", "text", F.coalesce(started, F.lit(0)).alias("body"), date.alias("created_text")).filter("body = 1").drop("body")


def islands(lines: DataFrame, keep_tail: bool = False) -> DataFrame:
    """(doc_id, island, first_idx, last_idx, text): runs of non-blank lines, joined without separator and squeezed.

    A blank line ends a run; a run that no blank line ends is dropped unless ``keep_tail`` is set.
    """
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    w = Window.partitionBy("doc_id").orderBy("idx")
    every = Window.partitionBy("doc_id")
    marked = lines.select(
        "doc_id", "idx", "text", blank.alias("blank"),
        F.sum(blank.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gap"), F.sum(blank.cast("int")).over(every).alias("gaps"),
    ).filter("not blank")
    if not keep_tail:
        marked = marked.filter("gap < gaps")
    joined = marked.groupBy("doc_id", "gap").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("text")
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("gap")) - 1
    return joined.select("doc_id", number.alias("island"), "first_idx", "last_idx", F.trim(squeeze(F.col("text"))).alias("text"))


def labelled(passages: DataFrame, extents: DataFrame) -> DataFrame:
    """label 1 for passages that an annotated extent (doc_id, start, end paragraph) meets, else 0.

    The interval join is by document, so pairs stay within one.
    """
    hit = passages.join(extents, "doc_id").filter("first_idx <= end and start <= last_idx").select("doc_id", "island").distinct()
    return passages.join(hit.withColumn("label", F.lit(1)), ["doc_id", "island"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def pseudo_passage(*answers: str) -> Column:
    """Non-empty answers joined by a full stop."""
    return F.concat_ws(". ", F.filter(F.array(*answers), lambda x: x != ""))
