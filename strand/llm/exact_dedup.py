"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import SPACE, attach_groups, bounded_broadcast, materialize

#: Slots of the first pass a row: about 1.6 % of rows meet another's slot by chance.
SLOTS_A_ROW = 64
#: Bits of the hash whose leading bits number the slots; 63, so that it is never negative.
HASH_BITS = 63
#: Repeated slots of one Bloom filter (10 bits each: 10 MB); with more, slots are cut into as many ranges.
FILTER_ITEMS = 8_000_000


def normalised(text: Column | str) -> Column:
    """Each run of white space as one space; null as empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def _possibly_repeated(rows: DataFrame, slot_bits: int, filter_items: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with h and slot) split into those whose digest may occur again and those whose digest can't.

    First pass: slots of the digests are counted, map-side first, so what moves is a slot number for each
    distinct slot of a task and a digest that a third of all rows share is one number a task. Slots
    counted twice are repeated. Second pass: a Bloom filter of the repeated slots goes to all tasks; rows
    pass straight through unless their slot is in it. The filter's size is bounded: repeated slots
    beyond ``filter_items`` are cut into ranges of hashes, each with a filter and a pass of its own over the
    digests, which are sorted by hash within each file, so a range reads the pages that hold it.
    """
    repeated = materialize(rows.groupBy("slot").agg(F.count("*").alias("marks")).filter("marks > 1").select("slot"), "dedup-slots")
    n = repeated.count()
    if not n:
        return rows.filter(F.lit(False)), rows
    bits = max(0, -(-n // filter_items) - 1).bit_length()
    step = 1 << (HASH_BITS - bits)
    maybe = single = None
    for k in range(1 << bits):
        own, marked = rows, repeated
        if bits:
            own = rows.filter((F.col("h") >= k * step) & (F.col("h") <= (k + 1) * step - 1))
            marked = repeated.filter(F.shiftright("slot", slot_bits - bits) == k)
        data = bloom.build(marked, "slot", max(1, n >> bits), max(64, 10 * (n >> bits)))
        hit = bloom.might_contain(rows, data, F.col("slot")) if data is not None else F.lit(False)
        maybe = own.filter(hit) if maybe is None else maybe.unionByName(own.filter(hit))
        single = own.filter(~hit) if single is None else single.unionByName(own.filter(~hit))
    return maybe, single


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_items: int = FILTER_ITEMS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalising white space; of equal texts the smallest id stays.
    Only ids and digests are moved, never texts, and of those only rows that may be repeated.

    Null text is the empty text. Null ids lose to any id; where all ids of a group are null, keep_id is
    null and all its rows stay. Rows that share id and text all stay with their id and count in
    group_size. No rows give no rows. Other columns are ignored, whatever their names.
    """
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    h = F.shiftrightunsigned(F.xxhash64("text_sha256"), 64 - HASH_BITS)
    rows = materialize(digests.withColumn("h", h).sortWithinPartitions("h"), "dedup-digests")
    total = rows.count()
    slot_bits = min(HASH_BITS, max(10, (SLOTS_A_ROW * total).bit_length()))
    rows = rows.withColumn("slot", F.shiftright("h", HASH_BITS - slot_bits))
    maybe, single = _possibly_repeated(rows, slot_bits, filter_items)
    maybe = maybe.select("doc_id", "text_sha256")
    groups = materialize(
        maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups"
    )
    met = attach_groups(maybe, groups, "text_sha256", "group_size", total)
    passed = single.select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return met.unionByName(passed).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all its columns, with one row of each group of equal texts: a row of the smallest id.

    A row is told by its id and its text's digest together, so where rows repeat an id each text is judged by
    itself. Of rows that repeat both, and of groups without any id, one row stays, which one isn't
    defined. What goes is broadcast while it is little and shuffled beyond that bound. Nulls, empty tables
    and other columns as in :func:`exact_dedup`; columns of any name pass through.
    """
    found = exact_dedup(docs, id_col, text_col).filter("group_size > 1")
    counts = found.groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("rows")).filter("not kept or rows > 1")
    gone = materialize(counts.select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("t"), "kept"), "dedup-drop")
    return without(docs, gone, F.col(id_col), F.sha2(normalised(text_col), 256))


def without(docs: DataFrame, gone: DataFrame, own: Column, mark: Column) -> DataFrame:
    """``docs`` without the rows whose (own, mark) is an (i, t) of ``gone``; of those with ``kept`` one stays."""
    columns = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), own.alias("i"), mark.alias("t"))
    names = bounded_broadcast(gone.select(F.col("i").alias("gone_i"), F.col("t").alias("gone_t")))
    same = F.col("i").eqNullSafe(F.col("gone_i")) & F.col("t").eqNullSafe(F.col("gone_t"))
    out = packed.join(names, same, "left_anti")
    repeats = gone.filter("kept")
    if n := repeats.count():
        again = bounded_broadcast(repeats.select(F.col("i").alias("gone_i"), F.col("t").alias("gone_t")), n)
        out = out.unionByName(packed.join(again, same, "left_semi").groupBy("i", "t").agg(F.first("row").alias("row")))
    return out.select("row.*")
