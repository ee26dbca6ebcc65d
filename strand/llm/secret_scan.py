"""Secret scans: fixed patterns, and a randomness test battery that adds spans. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex")
#: Fixed patterns. Runs are taken whole and tested for length afterwards; for access and hex a minimum in
#: the pattern finds the same matches, as a run that is too short holds no longer one.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
ASSIGN_VALUE = 8
#: Tokens that the battery tests: runs of 16 and more letters, digits, + / _ -. Decimal numbers aren't: their digits are
#: as even as those of a secret, whatever they count.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?![0-9]+(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{16,}={0,2}"
#: Expected share of false spans among those that the battery adds, in each family of tokens.
FALSE_DISCOVERY = 0.01
#: Bounds of length classes. A family is an encoding and a length class, over the whole corpus: many short
#: candidates, or words, neither hide nor lift long or mixed ones.
LENGTHS = (32, 64)
#: Chances are compared on a scale of this many steps a power of ten, from 1 down to 1e-16.
STEPS = 20
#: What prose and names have: how often two letters agree, changes between classes of symbols in one case and in
#: both, and the share of vowels. Under randomness the encoding alone tells all of them.
PROSE_AGREE, PROSE_CHANGES, CAMEL_CHANGES, PROSE_VOWELS = 0.066, 0.2, 0.4, 0.38


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as structs of start, kind's rank and end (code points)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match")))
    rank = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,match:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        one = F.array(F.struct(begin.alias("start"), rank.alias("rank"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.concat(state["out"], one).alias("out"))  # matches of a text are few

    return F.aggregate(steps, start, step, lambda state: state["out"])


_NONE = "array<struct<start:int,rank:int,end:int,match:string>>"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Spans of a pattern; texts without a match are told apart by one scan that stops at the first."""
    return F.when(F.rlike(text, F.lit(pattern)), _spans(text, pattern, kind)).otherwise(F.array().cast(_NONE))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Zelen and Severo's polynomial, error below 1e-7)."""

    def tail(v: Column) -> Column:
        t = v["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        upper = F.exp(-v["z"] * v["z"] / 2) / math.sqrt(2 * math.pi) * poly
        return F.when(v["z"] >= 0, upper).otherwise(1 - upper)

    return _let(_let(z, lambda z: F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t"))), tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def battery(token: Column) -> Column:
    """Struct of tests of one token (string) against randomness over its inferred encoding, and against structure.

    The encoding is the smallest alphabet that holds the token: hex (16), one case (26), base 32, one case and
    digits (36), letters (52), or all (64). p_random is the smallest chance, times 3, of three tests of
    randomness: the chi-squared statistic of symbol counts, the runs of symbol classes (upper, lower, digit,
    other) and the serial correlation of neighbouring symbols. p_structured is the chance that a token of words
    looks as random as this one: its symbols as even, its classes changing as often, its vowels as few. It falls
    with length. grade is its place on the scale of STEPS.
    """
    one = F.lit(1)

    def symbols(body: Column) -> Column:
        is_in = lambda *sets: F.rlike(body, F.lit("^(" + "|".join(f"[{x}]+" for x in sets) + ")$"))
        a = (
            F.when(is_in("0-9a-f", "0-9A-F"), 16.0).when(is_in("a-z", "A-Z"), 26.0).when(is_in("A-Z2-7"), 32.0)
            .when(is_in("0-9a-z", "0-9A-Z"), 36.0).when(is_in("A-Za-z"), 52.0).otherwise(64.0)
        )
        vowels = F.length(F.regexp_replace(F.lower(body), "[^aeiou]", "")).cast("double")
        letters = F.length(F.regexp_replace(F.lower(body), "[^a-z]", "")).cast("double")
        return F.struct(F.length(body).cast("double").alias("n"), a.alias("a"), vowels.alias("vowels"), letters.alias("letters"), F.transform(F.split(body, ""), lambda c: F.ascii(c)).alias("codes"))

    def classes(v: Column) -> Column:
        # digit, upper, lower, other
        group = F.transform(v["codes"], lambda c: F.when(c.between(48, 57), 0).when(c.between(65, 90), 1).when(c.between(97, 122), 2).otherwise(3))
        mean = F.aggregate(v["codes"], F.lit(0.0), lambda s, c: s + c) / v["n"]
        off = _let(mean, lambda m: F.transform(v["codes"], lambda c: c - m))
        squares = F.aggregate(F.array_distinct(v["codes"]), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(v["codes"], lambda d: d == c)).cast("double"), 2))
        return F.struct(*[v[k].alias(k) for k in ("n", "a", "vowels", "letters")], group.alias("group"), off.alias("off"), squares.alias("squares"))

    def sums(v: Column) -> Column:
        later = F.size(v["group"]) - 1
        changes = _sum(F.zip_with(F.slice(v["group"], one, later), F.slice(v["group"], one + 1, later), lambda x, y: (x != y).cast("double")))
        same = F.aggregate(F.array(*[F.lit(k) for k in range(4)]), F.lit(0.0), lambda s, k: s + F.pow(F.size(F.filter(v["group"], lambda g: g == k)) / v["n"], 2))
        power = _sum(F.transform(v["off"], lambda x: x * x))
        products = _sum(F.zip_with(F.slice(v["off"], one, later), F.slice(v["off"], one + 1, later), lambda x, y: x * y))
        return F.struct(*[v[k].alias(k) for k in ("n", "a", "vowels", "letters")], (v["squares"] * v["a"] / v["n"] - v["n"]).alias("chi"), changes.alias("changes"),
                        same.alias("same"), (products / F.greatest(power, F.lit(1e-9))).alias("serial"))

    def deviations(v: Column) -> Column:
        n, a, free, same = v["n"], v["a"], v["a"] - 1, v["same"]
        spread = F.sqrt(F.greatest((n - 1) * same * (1 - same), F.lit(0.5)))
        uneven = F.lit(PROSE_AGREE) * a - 1
        even = -(v["chi"] - free - (n - 1) * uneven) / F.sqrt(2 * (free + 2 * (n - 1) * uneven))
        usual = F.when(a >= 52, CAMEL_CHANGES).otherwise(PROSE_CHANGES)
        changing = (v["changes"] - (n - 1) * usual) / F.sqrt((n - 1) * usual * (1 - usual))
        few_vowels = (PROSE_VOWELS * v["letters"] - v["vowels"]) / F.sqrt(F.greatest(v["letters"], one) * PROSE_VOWELS * (1 - PROSE_VOWELS))
        # one case has no classes to change, hex letters no vowels to miss
        structured = F.when(a == 26, (even + few_vowels) / math.sqrt(2)).when(a == 16, (even + changing) / math.sqrt(2)).otherwise((even + changing + few_vowels) / math.sqrt(3))
        return F.struct(
            n.cast("int").alias("n"), a.cast("int").alias("alphabet"), ((v["chi"] - free) / F.sqrt(2 * free * (1 - 1 / n))).alias("z_chi"),
            F.when(same > 0.999, 0.0).otherwise((v["changes"] - n * (1 - same)) / spread).alias("z_runs"), ((v["serial"] + 1 / n) * F.sqrt(n)).alias("z_serial"), structured.alias("z_structured"),
        )

    def chances(v: Column) -> Column:
        two_sided = [2 * _normal_tail(F.abs(v[z])) for z in ("z_runs", "z_serial")]
        upper = F.least(F.lit(1.0), 2 * _normal_tail(v["z_chi"]))
        return F.struct(
            *[v[k].alias(k) for k in ("n", "alphabet", "z_chi", "z_runs", "z_serial")],
            F.least(F.lit(1.0), 3 * F.least(*two_sided, upper)).alias("p_random"), _normal_tail(v["z_structured"]).alias("p_structured"),
        )

    def graded(v: Column) -> Column:
        grade = F.floor(-F.log10(F.greatest(F.least(v["p_structured"], F.lit(1.0)), F.lit(1e-16))) * STEPS).cast("int")
        length = sum(((v["n"] >= bound).cast("int") for bound in LENGTHS), F.lit(0))
        return F.struct((v["alphabet"] * (len(LENGTHS) + 1) + length).alias("family"), *[v[k].alias(k) for k in ("n", "alphabet", "p_random", "p_structured")], grade.alias("grade"))

    out = F.regexp_replace(token, "=+$", "")
    for stage in (symbols, classes, sums, deviations, chances, graded):
        out = _let(out, stage)
    return out


def discovery_limits(tested: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Least grade of a discovery by family: Benjamini and Hochberg's step-up over all tokens of the corpus.

    ``tested`` is one row a token (family, grade). Counts by grade are summed map-side; at most 321 grades a family are
    ranked, and one number a family reaches the driver. A grade's largest chance stands for all in it.
    """
    counts = tested.groupBy("family", "grade").agg(F.count("*").alias("c"))
    better = Window.partitionBy("family").orderBy(F.desc("grade"))
    ranked = counts.withColumns({"k": F.sum("c").over(better), "m": F.sum("c").over(Window.partitionBy("family"))})
    passing = ranked.filter(F.pow(F.lit(10.0), -F.col("grade") / STEPS) <= rate * F.col("k") / F.col("m"))
    return {r["family"]: r["least"] for r in passing.groupBy("family").agg(F.min("grade").alias("least")).collect()}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and added (array of start, end) of every row.

    Base spans are those of the fixed patterns; the battery adds spans of kind random: tokens that all of its
    tests leave random and that the control over the whole corpus tells from words. base_sha256 and spans list
    kind:start:end by start, then kind; offsets are code points of the whole text. Texts are scanned once; what the
    scan finds is written, so the control's limits and the result come from spans and grades, not from texts.

    Null text is empty. Ids may be null or repeat, each row stands by itself. No rows give no rows; other
    columns are ignored. No row is shuffled, only counts of grades, and no Python runs on the executors.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    t = F.col("t")
    assign = F.filter(_found(t, PATTERNS["assign"], "assign"), lambda s: F.length(F.regexp_extract(s["match"], PATTERNS["assign"], 2)) >= ASSIGN_VALUE)
    rows = rows.select(
        "doc_id", assign.alias("assign"), _found(t, PATTERNS["access"], "access").alias("access"), _found(t, PATTERNS["hex"], "hex").alias("hex"),
        _found(t, CANDIDATE, "random").alias("candidates"),
    )
    place = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    base = F.transform(F.array_sort(F.concat("assign", "access", "hex")), place)
    rows = rows.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        base.alias("base"), "candidates",
    )
    # a token inside a base span says nothing new
    fresh = F.filter("candidates", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    graded = lambda c: F.struct(place(c).alias("span"), battery(c["match"]).alias("test"))
    found = materialize(rows.withColumn("fresh", fresh).select("doc_id", "n_assign", "n_access", "n_hex", "base", F.transform("fresh", graded).alias("tested")), "secrets-found")
    limits = discovery_limits(found.select(F.explode("tested").alias("x")).select("x.test.family", "x.test.grade"), rate)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    added = none
    if limits:
        least = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        chosen = F.filter("tested", lambda x: (x["test"]["p_random"] >= 0.01) & F.coalesce(x["test"]["grade"] >= F.try_element_at(least, x["test"]["family"]), F.lit(False)))
        added = F.transform(chosen, lambda x: x["span"])
    rows = found.withColumn("added", added)
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("added"),
    )
