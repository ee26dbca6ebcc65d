"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strand.operators.graph import components

from . import bloom
from .common import attach_groups, bounded_broadcast, materialize, small_batches, tidy
from .exact_dedup import without

WIDTH = 4
PERCENT = 80
BINS = 128
#: Rows of a band. With 32 bands of 4 a pair at similarity 0.8 shares none with probability 5e-8.
BAND_ROWS = 4
#: Buckets of up to NEAR + 1 members are compared by a window of predecessors, larger ones in arrays.
NEAR = 16
#: Bins of the sketches that candidates of large sets are compared by, two bits each.
SKETCH = 512
#: Sets of up to so many shingles have parities of as many bits instead, which never rule out a link.
PARITY_SHINGLES = 1500
#: Bins in which sketches of a pair may differ: 76.8 +- 8.1 are expected at similarity 0.8, fewer above it.
SKETCH_BINS = 125
#: Rows of a bucket that one task compares; larger buckets are dealt into parts of about so many.
BUCKET_ROWS = 5000
#: Most shared bucket keys that a Bloom filter takes (10 bits each: 10 MB).
FILTER_KEYS = 8_000_000
_PROBES = 64

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z in lower case.

    With fewer words than ``width`` the whole sequence is one shingle; without words there is none.
    """
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    take = min(width, n)
    h = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        h = _mix((h * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k : n - take + 1 + k])
    return np.unique(h)


_PROBED: dict[int, np.ndarray] = {}


def _probes(bins: int) -> np.ndarray:
    """For each bin the bins that it looks at, in turn, while it is empty."""
    if bins not in _PROBED:
        drawn = _mix(np.arange(bins * _PROBES, dtype=np.uint64), 0x5DEECE66D + bins) % np.uint64(bins)
        _PROBED[bins] = drawn.astype(np.int64).reshape(_PROBES, bins)
    return _PROBED[bins]


def signature(hashes: np.ndarray, count: int = BINS) -> np.ndarray:
    """One-permutation MinHash of ``count`` bins; empty bins are densified by independent probes of other bins."""
    h = np.sort(_mix(hashes, 0xA0761D6478BD642F))
    bins = (h >> np.uint64(64 - count.bit_length() + 1)).astype(np.int64)
    out = np.full(count, _EMPTY)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    out[bins[first]] = h[first]
    filled = out != _EMPTY
    dense = out.copy()
    empty = np.flatnonzero(~filled)
    for probe in _probes(count):
        if not len(empty):
            break
        to = probe[empty]
        ok = filled[to]
        dense[empty[ok]] = out[to[ok]]
        empty = empty[~ok]
    if len(empty):  # few values for many bins: past all probes the first filled bin serves
        dense[empty] = h[0]
    return dense


def parities(hashes: np.ndarray) -> np.ndarray:
    """2 * SKETCH bits, each flipped by every shingle that falls on it. Two sets differ in at most as many
    bits as they have shingles not shared, so the count of differing bits is a lower bound of those."""
    at = (_mix(hashes, 0x8EBC6AF09C88C6E3) % np.uint64(2 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=2 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


_BIN_SALT = _mix(np.arange(SKETCH, dtype=np.uint64), 0x2545F4914F6CDD1D)


def _signed(rows: list[tuple[int | None, int, np.ndarray]]) -> pd.DataFrame:
    """Signature columns of (id, hash of the text, shingle hashes), for many documents at once."""
    sets = [s for *_, s in rows]
    full = [k for k, s in enumerate(sets) if len(s)]
    none = np.empty(0, np.int64)
    keys, orders = [none] * len(sets), [none] * len(sets)
    sketch = np.zeros((len(sets), SKETCH // 32), np.int64)
    if full:
        sig = np.stack([signature(sets[k]) for k in full])
        grouped = sig.reshape(len(full), -1, BAND_ROWS)
        key = np.zeros(grouped.shape[:2], np.uint64)
        for r in range(BAND_ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ grouped[:, :, r])
        band = np.arange(key.shape[1])
        key = _mix(key ^ band.astype(np.uint64)[None, :]).view(np.int64)
        low = _mix(sig ^ _BIN_SALT[:BINS]) & np.uint64(0xFF)
        for k in full:
            if len(sets[k]) <= PARITY_SHINGLES:
                sketch[k] = parities(sets[k])
        if wides := [k for k in full if len(sets[k]) > PARITY_SHINGLES]:
            wide = _mix(np.stack([signature(sets[k], SKETCH) for k in wides]) ^ _BIN_SALT)
            bits = np.stack([wide >> np.uint64(63), (wide >> np.uint64(62)) & np.uint64(1)], axis=1).reshape(len(wides), -1, 64)
            sketch[wides] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
        # bytes of other bins order a band's bucket, so that like signatures stand together in it
        order = np.zeros(key.shape, np.uint64)
        for r in range(7):
            order = (order << np.uint64(8)) | low[:, (band * BAND_ROWS + BAND_ROWS + r * 11) % BINS]
        order = order.view(np.int64)
        for j, k in enumerate(full):
            keys[k], orders[k] = key[j], order[j]
    return pd.DataFrame({
        "doc_id": pd.array([i for i, *_ in rows], dtype="Int64"),
        "text_hash": [h for _, h, _ in rows],
        "n": [len(s) for s in sets],
        "mark": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
        "sketch": list(sketch), "keys": keys, "orders": orders,
    })


_SIGNED = "doc_id long, text_hash long, n long, mark string, sketch array<long>, keys array<long>, orders array<long>"


def _sign(width: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in tidy(batches):
            rows, size = [], 0
            for i, text, h in zip(batch["i"], batch["t"], batch["h"], strict=True):
                rows.append((None if pd.isna(i) else int(i), h, s := shingles(text, width)))
                size += len(s)
                if size > 200_000 or len(rows) >= 1000:
                    yield _signed(rows)
                    rows, size = [], 0
            if rows:
                yield _signed(rows)

    return sign


def _alike(a: Column, b: Column, percent: int) -> Column:
    """What any pair at the threshold meets: sizes in proportion and sketches that agree.

    By parities no link is ruled out, by bins (two large sets) there are 6 deviations of slack; a pair of
    one kind each is told by its sizes alone.
    """
    half = SKETCH // 64
    apart = [F.get(a["sketch"], F.lit(k)).bitwiseXOR(F.get(b["sketch"], F.lit(k))) for k in range(2 * half)]
    bins = sum((F.bit_count(apart[k].bitwiseOR(apart[k + half])) for k in range(half)), F.lit(0))
    odd = sum((F.bit_count(x) for x in apart), F.lit(0))
    agree = F.when(F.greatest(a["n"], b["n"]) <= PARITY_SHINGLES, odd * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent)).when(F.least(a["n"], b["n"]) > PARITY_SHINGLES, bins <= SKETCH_BINS)
    return (F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent) & F.coalesce(agree, F.lit(True))


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` without most of those whose bucket (key) no other row has: first counted, then tested
    against a Bloom filter of the shared keys, as long as those are few enough for one."""
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "minhash-shared")
    n = shared.count()
    if not n:
        return rows.filter(F.lit(False))
    if n > FILTER_KEYS:
        return rows
    return rows.filter(bloom.might_contain(rows, bloom.build(shared, "key", n, max(64, 10 * n)), F.col("key")))


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, m, ord, members, centre): classes in the band buckets that they share with others.

    The centre, a map-side minimum by a hash of the class alone, is mostly the same in all buckets of
    a group, so a member's stars are few.
    """
    member = F.struct(F.col("class_id").alias("id"), "n", "sketch").alias("m")
    rows = classes.select(member, F.explode(F.arrays_zip("keys", "orders")).alias("band")).select("m", "band.keys", "band.orders").toDF("m", "key", "ord")
    rows = _shared_buckets(rows)
    centre = F.min_by(F.col("m"), F.struct(F.xxhash64("m.id"), F.col("m.id")))
    stats = materialize(rows.groupBy("key").agg(F.count("*").alias("members"), centre.alias("centre")).filter("members > 1"), "minhash-buckets")
    return materialize(attach_groups(rows, stats, "key", "members", 32 * classes.count()), "minhash-members")


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def star_edges(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a > b, of each member with its bucket's centre: at most one a member and band."""
    own = F.col("m.id") != F.col("centre.id")
    return _edges(members.filter(own & _alike(F.col("m"), F.col("centre"), percent)).select(F.col("m.id").alias("x"), F.col("centre.id").alias("y")))


def _part_pairs(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (key, node, root, ...) once for each two parts (lo, hi) of their bucket that are to meet, with
    their own part. Parts of the bucket's most common root come last and don't meet one another."""
    roots = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = roots.groupBy("key").agg(F.max_by("root", "c").alias("home"), F.max("c").alias("most"), F.sum("c").alias("size"))
    parts = lambda n: F.ceil(n / BUCKET_ROWS).cast("long")
    sizes = materialize(sizes.filter("size > most").select("key", "home", "size", parts(F.col("size") - F.col("most")).alias("outs"), parts(F.col("most")).alias("homes")), "minhash-parts")
    dealt = attach_groups(rows, sizes, "key", "size", total)
    at = F.xxhash64("node", "key")
    part = F.when(F.col("root") == F.col("home"), F.col("outs") + F.pmod(at, F.col("homes"))).otherwise(F.pmod(at, F.col("outs")))
    dealt = dealt.withColumn("part", part)
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("part") < F.col("outs"), F.col("outs") + F.col("homes")).otherwise(F.col("outs")) - 1)
    dealt = dealt.withColumn("other", F.explode(meets))
    return dealt.select("key", "node", "root", "n", "sketch", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))


def near_edges(members: DataFrame, roots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a > b, of a bucket's members that may reach the threshold by their sketches and that the
    stars haven't joined already.

    Buckets of up to NEAR + 1 members are covered by a window of predecessors. Of larger ones all sketches
    are compared in memory, block by block, and only those that pass are emitted, one row a member and group.
    Beyond BUCKET_ROWS members a bucket is dealt into parts by a hash, those of its most common root apart from
    the others, and every two parts meet but those of the common root, whose members are joined already. What
    bands repeat is one before the sets are met.
    """
    rows = members.filter("members > 2").select("key", "ord", "members", "m", F.col("m.id").alias("node"))
    rows = rows.join(bounded_broadcast(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = Window.partitionBy("key").orderBy("ord", "node").rowsBetween(-NEAR, -1)
    before = F.collect_list(F.struct("m", "root")).over(order)
    others = F.filter("before", lambda o: (o["root"] != F.col("root")) & _alike(F.col("m"), o["m"], percent))
    small = rows.filter(F.col("members") <= NEAR + 1).withColumn("before", before).select(F.col("node").alias("x"), F.transform(others, lambda o: o["m"]["id"]).alias("ys"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        ids, roots, n, part = (group[c].to_numpy() for c in ("node", "root", "n", "part"))
        sketch = np.stack(group["sketch"].to_numpy()).view(np.uint64)
        wide, half, out = n > PARITY_SHINGLES, SKETCH // 64, []
        lo, hi = group["lo"].iat[0], group["hi"].iat[0]
        left, right = (np.flatnonzero(part == lo), np.flatnonzero(part == hi)) if lo != hi else (np.arange(len(ids)), None)
        for at in range(0, len(left), 32):
            x = left[at : at + 32]
            y = left[: at + 32] if right is None else right
            apart = sketch[x, None] ^ sketch[None, y]
            alike = np.bitwise_count(apart).sum(axis=2, dtype=np.int64) * (100 + percent) <= (n[x, None] + n[None, y]) * (100 - percent)
            if wide[x].any() or wide[y].any():
                bins = np.bitwise_count(apart[:, :, :half] | apart[:, :, half:]).sum(axis=2, dtype=np.int64)
                alike = np.where(wide[x, None] & wide[None, y], bins <= SKETCH_BINS, alike | (wide[x, None] != wide[None, y]))
            sized = 100 * np.minimum(n[x, None], n[None, y]) >= percent * np.maximum(n[x, None], n[None, y])
            ok = alike & sized & (roots[x, None] != roots[None, y])
            if right is None:
                ok &= ids[x, None] > ids[None, y]
            out += [(ids[x[k]], ids[y][row]) for k, row in enumerate(ok) if row.any()]
        return pd.DataFrame(out, columns=["x", "ys"])

    large = rows.filter((F.col("members") > NEAR + 1) & (F.col("members") <= BUCKET_ROWS)).select("key", "node", "root", "m.n", "m.sketch", *(F.lit(0).cast("long").alias(c) for c in ("part", "lo", "hi")))
    huge = _part_pairs(rows.filter((F.col("members") > NEAR + 1) & (F.col("members") > BUCKET_ROWS)).select("key", "node", "root", "m.n", "m.sketch"), members.count())
    large = large.unionByName(huge).groupBy("key", "lo", "hi").applyInPandas(compare, "x long, ys array<long>")
    met = small.filter(F.size("ys") > 0).unionByName(large).groupBy("x").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    return _edges(met.select("x", F.explode("ys").alias("y")))


def confirmed_edges(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges`` whose full shingle sets reach the threshold. ``sets``: class_id, hashes (distinct longs)."""
    left = sets.select(F.col("class_id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("class_id").alias("b"), F.col("hashes").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    return edges.join(left, "a").join(right, "b").filter(shared * 100 >= union * percent).select("a", "b")


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, text_hash, n_shingles, component (a number of its own for each component), component_id
    (its smallest id) and many, whether the component holds more rows than this one."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    signed = materialize(texts.mapInPandas(_sign(width), _SIGNED), "minhash-signed")
    total = signed.count()
    some = signed.filter("n > 0")
    groups = materialize(
        some.groupBy("mark").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.first("orders").alias("orders")),
        "minhash-classes",
    )
    # a class is named by its smallest id; where that is null or leads another class too, by its mark
    twice = materialize(groups.groupBy("least_id").agg(F.count("*").alias("c")).filter("c > 1 and least_id is not null").select("least_id", F.lit(True).alias("twice")), "minhash-twice")
    other = -1 - F.shiftrightunsigned(F.xxhash64("mark"), 1)
    named = groups.join(bounded_broadcast(twice), "least_id", "left").withColumn("class_id", F.when(F.col("twice") | F.col("least_id").isNull(), other).otherwise(F.col("least_id"))).drop("twice")
    members = bucket_members(named)
    sets = _sets(texts, named.select("class_id", "least_id", "mark").join(members.select(F.col("m.id").alias("class_id")).distinct(), "class_id"), width)
    stars = materialize(confirmed_edges(star_edges(members, percent), sets, percent), "minhash-stars")
    nears = materialize(confirmed_edges(near_edges(members, _roots(stars), percent), sets, percent), "minhash-nears")
    roots = _roots(stars.unionByName(nears)).select(F.col("node").alias("class_id"), "root")
    joined = named.select("class_id", "least_id", "mark", "copies").join(bounded_broadcast(roots), "class_id", "left")
    alone = joined.filter("root is null").select("mark", "copies", F.col("class_id").alias("component"), F.col("least_id").alias("component_id"), (F.col("copies") > 1).alias("many"))
    met = joined.filter("root is not null")
    led = met.groupBy("root").agg(F.min("least_id").alias("component_id"))
    resolved = alone.unionByName(met.join(bounded_broadcast(led), "root").select("mark", "copies", F.col("root").alias("component"), "component_id", F.lit(True).alias("many")))
    found = attach_groups(some.select("doc_id", "text_hash", "n", "mark"), materialize(resolved, "minhash-resolved"), "mark", "copies", total)
    empty = signed.filter("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), F.lit(False).alias("many"))
    return found.select(empty.columns).unionByName(empty).withColumnRenamed("n", "n_shingles")


def _roots(edges: DataFrame) -> DataFrame:
    return components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets, confirmed
    on the full sets. Documents of equal sets are one class, so thousands of copies cost one member
    of each bucket. component_id is the smallest id reachable over links, kept says whether it is the
    document's own.

    Null text is as empty text: no shingles, linked with nothing. Null ids take part with what they
    are in but never lead a component unless all ids in it are null; then component_id is null and the
    rows are kept. Rows that repeat an id count each by its own text. No rows give no rows. Other
    columns are ignored.
    """
    return _linked(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _sets(texts: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """class_id and full shingle set (array of hashes) of the classes in ``ends`` (class_id, least_id, mark).

    Documents are read for their texts by the smallest ids of the classes, those without an id for the
    classes that have no other. The set's own mark tells its class.
    """

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in tidy(batches):
            sets = [shingles(t, width) for t in batch["t"]]
            yield pd.DataFrame({"mark": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "hashes": [s.view(np.int64) for s in sets]})

    ends = materialize(ends, "minhash-ends")
    n = ends.count()
    wanted = texts.join(bounded_broadcast(ends.select("least_id"), n), F.col("i") == F.col("least_id"), "left_semi").select("t")
    if ends.filter("least_id is null").limit(1).count():
        wanted = wanted.unionByName(texts.filter("i is null").select("t"))
    # a map over the rows that are left: a column function might be evaluated before the join, or twice
    sets = wanted.mapInPandas(full, "mark string, hashes array<long>")
    found = materialize(sets.join(bounded_broadcast(ends, n), "mark").select("class_id", "hashes"), "minhash-sets")
    return found if found.count() == n else found.dropDuplicates(["class_id"])


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all its columns, with one row of each component: a row of the smallest id.

    A row is told by its id and its text together, so where rows repeat an id each text is judged by
    itself. Where several rows of a component have its smallest id, or none has an id, one of them stays,
    which one isn't defined. Documents without words stay, all of them. Nulls, empty tables and other columns
    as in :func:`near_dedup`; columns of any name pass through.
    """
    found = materialize(_linked(docs, width, percent, id_col, text_col).filter("many").select("doc_id", "text_hash", "component", "component_id"), "minhash-many")
    leads = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("text_hash").alias("lead"))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    later = found.join(bounded_broadcast(leads), "component").withColumn("kept", own & (F.col("text_hash") == F.col("lead")))
    gone = later.groupBy("doc_id", "text_hash", "kept").agg(F.count("*").alias("rows")).filter("not kept or rows > 1")
    gone = materialize(gone.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t"), "kept"), "minhash-drop")
    return without(docs, gone, F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))
