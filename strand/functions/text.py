"""Text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small English stop list (fixed values).
STOPWORDS = tuple("a an and are as at be by for from has he in is it its of on or that the this to was were will with".split())
#: Letters that have no decomposition to ASCII, and what stands for them (fixed values).
TRANSLITERATED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th",
    "ð": "d", "Ð": "D", "ı": "i", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "€": "EUR", " ": " ",
}


def word_count(text: Column) -> Column:
    """Words between white space; blank text has none."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def to_ascii(text: Column) -> Column:
    """Transliterated to ASCII, DEL dropped, newlines as spaces."""
    table = str.maketrans(TRANSLITERATED)

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            plain = unicodedata.normalize("NFKD", v.translate(table)).encode("ascii", "ignore").decode()
            return plain.replace("\x7f", "").replace("\n", " ")

        return values.map(one)

    return clean(text)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def lower_tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Lower-case words without stop words."""
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(tokens(F.lower(text)), lambda t: ~F.array_contains(stop, t))


def plain_tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Runs of letters and digits in lower case, without stop words, punctuation and line ends."""
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~F.array_contains(stop, t))


def normalise_token(token: Column) -> Column:
    """Lower case, digits as 0."""
    return F.regexp_replace(F.lower(token), "[0-9]", "0")


#: Bracket names of treebank tokens (fixed values).
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def clean_token(token: Column) -> Column:
    """Escapes of corpus tokens undone: bracket names, leading slashes of punctuation."""
    names = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])
    bare = F.regexp_replace(token, r"^/(?=[.?\-])", "")
    return F.coalesce(F.element_at(names, bare), bare)


def comment_fields(text: Column) -> Column:
    """``key: value`` lines of a comment as a map; repeats of a key are joined by a bar."""
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?m)^\s*[A-Za-z][A-Za-z ]*:\s*[^\n]*"), F.lit(0)),
        lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), "|")))


def clean_comment(text: Column) -> Column:
    """Spaces around colons squeezed and the long name of a field shortened."""
    padded = F.regexp_replace(text, r"\s*:\s*", ": ")
    return F.replace(squeeze(padded), F.lit("Other Reason"), F.lit("OtherReason"))


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def first_word(text: Column) -> Column:
    return F.get(tokens(text), F.lit(0))


def last_word(text: Column) -> Column:
    return F.element_at(tokens(text), -1)


def highlight(text: Column, answer: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """Every occurrence of a non-empty answer between marks."""
    return F.when(F.length(answer) > 0, F.replace(text, answer, F.concat(F.lit(before), answer, F.lit(after)))).otherwise(text)
