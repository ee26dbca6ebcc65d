"""Date functions: columns for single rules, and a pattern scanner for free text."""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = tuple(m.lower() for m in calendar.month_name)[1:]
WEEKDAYS = tuple(d.lower() for d in calendar.day_name)
#: Number words (fixed values).
NUMBERS = {
    w: n
    for n, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    )
} | {w: 20 + 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}


def number_words(text: Column) -> Column:
    """Sum of the number words and digits in a text."""
    known = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    value = lambda w: F.coalesce(F.element_at(known, w), F.when(F.rlike(w, F.lit("^[0-9]{1,9}$")), w).cast("int"), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda s, w: s + value(w))


def hour_24(hour: Column, half: Column, compat: bool = False) -> Column:
    """Hour of a 12-hour clock. With ``compat`` noon becomes 24 and only lower-case pm counts."""
    if compat:
        return F.when(half == "pm", hour + 12).otherwise(hour)
    half = F.lower(half)
    return F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)


def quarter_date(year: Column, quarter: Column, compat: bool = False) -> Column:
    """First day of a quarter; ``compat`` takes months 1, 3, 6 and 9."""
    month = F.when(quarter == 1, 1).otherwise((quarter - 1) * 3) if compat else (quarter - 1) * 3 + 1
    return F.make_date(year, month.cast("int"), F.lit(1))


def relative_weekday(base: Column, weekday: Column, which: str) -> Column:
    """The weekday (0 Monday) of this, the last or the next week: last before, next after the base date."""
    ahead = F.pmod(weekday - F.weekday(base), F.lit(7))
    if which == "next":
        return F.date_add(base, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))
    if which == "last":
        back = F.pmod(F.weekday(base) - weekday, F.lit(7))
        return F.date_sub(base, F.when(back == 0, 7).otherwise(back).cast("int"))
    return F.date_add(F.date_sub(base, F.weekday(base)), weekday.cast("int"))


def relative_unit(base: Column, n: Column, unit: str) -> Column:
    """``n`` units from the base. Months stay in the base's year: they stop at January and December."""
    if unit == "day":
        return F.date_add(base, n.cast("int"))
    if unit == "week":
        return F.date_add(base, (n * 7).cast("int"))
    year = F.year(base) + (n if unit == "year" else F.lit(0))
    month = F.greatest(F.lit(1), F.least(F.lit(12), F.month(base) + n)) if unit == "month" else F.month(base)
    first = F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
    return F.date_add(first, F.least(F.dayofmonth(base), F.dayofmonth(F.last_day(first))) - 1)


def adverb_date(base: Column, adverb: Column) -> Column:
    days = F.when(adverb.isin("today", "tonight"), 0).when(adverb == "yesterday", -1).when(adverb == "tomorrow", 1)
    return F.date_add(base, days)


def duration_date(base: Column, n: Column, unit: Column, direction: Column) -> Column:
    """``n`` units ago (ago, before, earlier) or ahead (after, later, from now)."""
    days = n * F.when(unit.startswith("day"), 1).when(unit.startswith("week"), 7).when(unit.startswith("month"), 30).when(unit.startswith("year"), 365)
    sign = F.when(direction.isin("ago", "before", "earlier", "previous"), -1).otherwise(1)
    return F.date_add(base, (days * sign).cast("int"))


def assembled(year: Column, month: Column, day: Column, base: Column) -> Column:
    """Date from parts, missing ones from the base, the day held within the month."""
    y, m, d = F.coalesce(year, F.year(base)), F.coalesce(month, F.month(base)), F.coalesce(day, F.dayofmonth(base))
    first = F.make_date(y.cast("int"), m.cast("int"), F.lit(1))
    return F.date_add(first, (F.least(d, F.dayofmonth(F.last_day(first))) - 1).cast("int"))


def excel_date(serial: Column) -> Column:
    """Day number of a spreadsheet, whose day 0 is 30 December 1899."""
    return F.date_add(F.to_date(F.lit("1899-12-30")), serial.cast("int"))


def days_between(first: Column, last: Column) -> Column:
    """Whole seconds as fractional days."""
    return F.floor(last.cast("timestamp").cast("double") - first.cast("timestamp").cast("double")) / F.lit(86400.0)


_DOW = "(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day|mon|tues?|wed|thurs?|thu|fri|sat|sun)"
_MON = "(?P<{}>" + "|".join(m if m == "may" else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?") + ")"
_TIME = r"(?:[\s,]+(?:at\s+)?(?P<{0}h>[0-9]{{1,2}})(?::(?P<{0}m>[0-9]{{2}}))?\s*(?P<{0}p>am|pm)?(?![0-9]))?"
_DAY = r"(?P<{}>[0-9]{{1,2}})(?:st|nd|rd|th)?"
_YEAR = "(?P<{}>(?:19|20)[0-9]{{2}})"
#: Forms in match order: each names the fields that it gives.
_FORMS = (
    rf"\b(?:{_DOW}[,\s]+)?{_DAY.format('d1')}(?:\s+of)?[\s,\-/]+{_MON.format('n1')}[\s,\-/]+{_YEAR.format('y1')}{_TIME.format('a')}",
    rf"\b(?:{_DOW}[,\s]+)?{_MON.format('n2')}[\s\-]+{_DAY.format('d2')}(?:[\s,]+{_YEAR.format('y2')})?(?![0-9]){_TIME.format('b')}",
    rf"\b(?P<q3>first|second|third|fourth|last)\s+quarter\s+of\s+{_YEAR.format('y3')}",
    rf"\b{_DAY.format('d4')}(?:\s+of)?\s+{_MON.format('n4')}\b",
    r"\b(?P<m5>[0-9]{1,2})/(?P<d5>[0-9]{1,2})(?:/(?P<y5>(?:19|20)[0-9]{2}))?(?![0-9/])",
    r"\b(?P<r6>today|yesterday|tomorrow|tonight)\b",
    rf"\b(?P<w7>this|last|next)\s+(?P<k7>{_DOW})\b",
    r"\b(?P<w8>this|last|next)\s+(?P<u8>year|month|week|day)\b",
    rf"\b{_YEAR.format('y9')}\b",
    rf"\b{_MON.format('n10')}\b",
)
_SCAN = re.compile("|".join(f"(?:{f})" for f in _FORMS), re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+$")


def _month(name: str) -> int:
    return next(k for k, m in enumerate(MONTHS, 1) if m.startswith(name.lower()[:3]))


def extract_dates(text: str | None, base: dt.date, max_defaults: int = 0) -> list[tuple[str, dt.datetime]]:
    """(matched text, time) of the dates of a text, left to right.

    A date counts if at most ``max_defaults`` of its year, month and day had to be taken from the base
    date; years before 1900 count as missing. The base date is always given, never the clock.
    """
    out = []
    for found in _SCAN.finditer((text or "").replace(".", "")):
        part = {_DIGITS.sub("", k) if k[0] not in "ab" or len(k) > 2 or not k[1:] in "hmp" else k[1:] + "t": v for k, v in found.groupdict().items() if v}
        year = int(part["y"]) if "y" in part else None
        month = _month(part["n"]) if "n" in part else int(part["m"]) if "m" in part else None
        day = int(part["d"]) if "d" in part else None
        if "q" in part:
            quarter = ("first", "second", "third", "fourth").index(part["q"].lower()) if part["q"].lower() != "last" else 3
            month, day = 3 * quarter + 1, 1
        if "r" in part:
            exact = base + dt.timedelta({"yesterday": -1, "tomorrow": 1}.get(part["r"].lower(), 0))
            year, month, day = exact.year, exact.month, exact.day
        if "k" in part:
            target = next(k for k, w in enumerate(WEEKDAYS) if w.startswith(part["k"].lower()[:3]))
            week = base - dt.timedelta(base.weekday()) + dt.timedelta(target)
            ahead, back = (target - base.weekday()) % 7 or 7, (base.weekday() - target) % 7 or 7
            exact = {"this": week, "next": base + dt.timedelta(ahead), "last": base - dt.timedelta(back)}[part["w"].lower()]
            year, month, day = exact.year, exact.month, exact.day
        elif "u" in part:
            n = {"this": 0, "next": 1, "last": -1}[part["w"].lower()]
            if part["u"].lower() in ("day", "week"):
                exact = base + dt.timedelta(n * (7 if part["u"].lower() == "week" else 1))
                year, month, day = exact.year, exact.month, exact.day
            else:
                year = base.year + (n if part["u"].lower() == "year" else 0)
                month = min(12, max(1, base.month + n)) if part["u"].lower() == "month" else base.month
                day = base.day
        if sum(x is None for x in (year, month, day)) > max_defaults:
            continue
        y, m = year or base.year, month or base.month
        if not 1 <= m <= 12:
            continue
        d = min(day or base.day, calendar.monthrange(y, m)[1])
        hour = int(part.get("ht", 0))
        if part.get("pt", "").lower() == "pm":
            hour = hour % 12 + 12
        if d < 1 or hour > 23 or int(part.get("mt", 0)) > 59:
            continue
        out.append((found.group().strip(), dt.datetime(y, m, d, hour, int(part.get("mt", 0)))))
    return out


def dates_in(text: Column, base: Column, max_defaults: int = 0) -> Column:
    """Array of (span, ts) of a text's dates."""

    @F.pandas_udf("array<struct<span:string,ts:timestamp_ntz>>")
    def scan(texts: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[{"span": s, "ts": t} for s, t in extract_dates(x, b, max_defaults)] for x, b in zip(texts, bases, strict=True)])

    return scan(text, base)
