"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behinds change no match (greedy runs leave no digit before a start); they keep scans linear
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches found from their @: the local part is the run before it, down to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        if found := _DOMAIN.match(text, at + 1):
            low = at
            while low > end and text[low - 1] in _LOCAL:
                low -= 1
            if low < at:
                end = found.end()
                yield "email", low, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Fixed patterns by kind, each leftmost and non-overlapping; matches that fail their test are dropped."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += (
        ("ip", m.start(), m.end()) for m in _IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    )
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15)
    return out


# ---- the semi-Markov field -------------------------------------------------------------------------

#: Longest segment of numbers, in groups of digits, and longest local part of a mail address (64 by its standard).
LONGEST = 8
LONGEST_LOCAL = 80
_DOT = r"(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20dot\x20|\.)"
_AT = r"(?:\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20|\x20@\x20|@)"
_TRIGGER = re.compile(r"[0-9]|@|\bat\b", re.IGNORECASE)
_HIDDEN_AT = re.compile(_AT, re.IGNORECASE)
_LOCAL_END = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*$", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z0-9-]+")
_NEXT_PART = re.compile(rf"{_DOT}([A-Za-z0-9-]+)", re.IGNORECASE)
_GROUP = re.compile(r"[0-9]+")
#: What may stand between two groups of digits of one number, and what may lead it.
_BETWEEN = re.compile(rf"(?:{_DOT}|[\x20()./-]){{1,3}}", re.IGNORECASE)
_LEAD = re.compile(r"(?:\+|\(\+?)$")
_IP_DOTS = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.IGNORECASE)
_PHONE_SHAPE = re.compile(
    r"\(?\+?[0-9]{1,4}\)?(?:[-.\x20/]?\(?[0-9]{2,4}\)?){1,3}[-.\x20/][0-9]{3,4}"
)
_GROUPED_CARD = re.compile(r"[0-9]{4}([.\x20/-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})")
_CUES = {
    "phone": re.compile(r"(?:phone|tel|call|mobile|fax|ring|dial|reach|contact)\W{0,3}(?:\w+\W+){0,2}$", re.IGNORECASE),
    "card": re.compile(r"(?:card|visa|credit|payment|pay)\W{0,3}(?:\w+\W+){0,2}$", re.IGNORECASE),
    "ip": re.compile(r"(?:\bip\b|host|server|address|ping|node)\W{0,3}(?:\w+\W+){0,2}$", re.IGNORECASE),
    "email": re.compile(r"(?:mail|contact|write|reach)\W{0,3}(?:\w+\W+){0,2}$", re.IGNORECASE),
}
FEATURES = (
    "bias", "cue", "phone_shape", "card_shape", "ip_shape", "luhn", "digits_short", "digits_phone", "digits_card", "leads_zero_or_plus", "even_groups",
    "spaces_only", "mixed_separators", "glued", "long_group", "date_shape", "cut_left", "cut_right", "bracketed_at", "word_at", "word_dot", "short_end", "parts",
)


def _features(text: str, kind: str, lo: int, hi: int) -> np.ndarray:
    """Whole-span features of one candidate segment: its shape, what it cuts through and what stands before it."""
    span = text[lo:hi]
    cue = bool(_CUES[kind].search(text[max(0, lo - 40) : lo]))
    glued = (lo > 0 and text[lo - 1].isalnum()) or (hi < len(text) and text[hi].isalnum())
    if kind == "email":
        at = _HIDDEN_AT.search(span)
        mark = at.group() if at else ""
        tail = re.split(_DOT, span[at.end() :] if at else span, flags=re.IGNORECASE)
        word_dot = " dot " in span.lower()
        more = bool(_NEXT_PART.match(text, hi))
        return np.array([
            1, cue, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, glued, 0, 0, bool(re.search(rf"{_DOT}$", text[max(0, lo - 6) : lo], re.IGNORECASE)), more,
            mark.strip()[:1] in "[({" and mark != "", mark.lower() == " at ", word_dot, 2 <= len(tail[-1]) <= 4 and tail[-1].isalpha(), len(tail) > 1,
        ], dtype=np.float64)
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    separators = set(span) & set(" .-/")
    before, after = text[max(0, lo - 2) : lo], text[hi : hi + 2]
    return np.array([
        1, cue, bool(_PHONE_SHAPE.fullmatch(span)), bool(_GROUPED_CARD.fullmatch(span)), bool(_IP_DOTS.fullmatch(span)) and all(int(g) <= 255 for g in groups),
        13 <= len(digits) <= 19 and luhn(digits), len(digits) < 9, 9 <= len(digits) <= 12, 13 <= len(digits) <= 19, span[0] in "+(0", len(set(map(len, groups))) == 1,
        separators == {" "}, len(separators) > 1, glued, max(map(len, groups)) > 8, bool(_DATE.search(span)),
        bool(re.search(r"[0-9][-./\x20(]$", before)), bool(re.match(r"[-./\x20)][0-9]", after)), 0, 0, 0, 0, 0,
    ], dtype=np.float64)


def _segments(text: str) -> list[Span]:
    """Candidate segments of the whole text, of a shape that some kind may have.

    Numbers: every run of up to LONGEST neighbouring groups of digits that has the digits of an address, a phone or a
    card. Mail: what stands before a hidden at, with every number of domain parts after it, so that the field
    chooses where the address begins and ends.
    """
    out: list[Span] = []
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text)]
    for i, (start, _) in enumerate(groups):
        lead = _LEAD.search(text, max(0, start - 2), start)
        begin = lead.start() if lead else start
        digits = 0
        for k in range(i, min(i + LONGEST, len(groups))):
            end = groups[k][1]
            if k > i and not _BETWEEN.fullmatch(text, groups[k - 1][1], groups[k][0]):
                break
            digits += end - groups[k][0]
            if digits > 19:
                break
            if k == i + 3 and _IP_DOTS.fullmatch(text, start, end):
                out.append(("ip", start, end))
            if k > i and 9 <= digits <= 15:
                out.append(("phone", begin, end))
            if digits >= 13:
                out.append(("card", start, end))
    for m in _HIDDEN_AT.finditer(text):
        local = _LOCAL_END.search(text, max(0, m.start() - LONGEST_LOCAL), m.start())
        part = _PART.match(text, m.end())
        if not local or not part:
            continue
        # without a dot it may still be an address, but only in brackets
        starts = [local.start(), *(local.start() + d.end() for d in re.finditer(_DOT, local.group(), re.IGNORECASE))][:4]
        ends = [part.end()]
        while len(ends) < 6 and (more := _NEXT_PART.match(text, ends[-1])):
            ends.append(more.end())
        out += (("email", a, b) for a in starts for b in ends[1:])
    return out


class Lattice:
    """The segmentations of one text: points in order, candidate segments from point to point, and steps over what
    is outside, which score 0. Candidates are bounded, so all work is linear in them."""

    def __init__(self, text: str, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: (s[2], s[1]))
        points = sorted({p for _, a, b in spans for p in (a, b)})
        place = {p: k for k, p in enumerate(points)}
        self.n = len(points)
        self.ends = [(place[a], place[b]) for _, a, b in self.spans]
        self.x = np.array([_features(text, *s) for s in self.spans]).reshape(len(spans), len(FEATURES))
        self.kinds = np.array([KINDS.index(k) for k, _, _ in self.spans], dtype=np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return (self.x * weights[self.kinds]).sum(axis=1)

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Log of the summed exp scores of all segmentations up to each point."""
        alpha = [0.0] * max(1, self.n)
        k = 0
        for p in range(1, self.n):
            terms = [alpha[p - 1]]
            while k < len(self.ends) and self.ends[k][1] == p:
                terms.append(alpha[self.ends[k][0]] + scores[k])
                k += 1
            top = max(terms)
            alpha[p] = top + math.log(sum(math.exp(t - top) for t in terms))
        return np.array(alpha)

    def marginals(self, scores: np.ndarray) -> tuple[float, np.ndarray]:
        """Log of the partition sum and each candidate's probability, by the forward and the backward pass."""
        alpha = self.forward(scores)
        total = alpha[-1]
        beta = [0.0] * max(1, self.n)
        by_start: dict[int, list[int]] = {}
        for k, (a, _) in enumerate(self.ends):
            by_start.setdefault(a, []).append(k)
        for p in range(self.n - 2, -1, -1):
            terms = [beta[p + 1], *(beta[self.ends[k][1]] + scores[k] for k in by_start.get(p, ()))]
            top = max(terms)
            beta[p] = top + math.log(sum(math.exp(t - top) for t in terms))
        found = [math.exp(alpha[a] + scores[k] + beta[b] - total) for k, (a, b) in enumerate(self.ends)]
        return float(total), np.array(found)

    def best(self, scores: np.ndarray) -> list[Span]:
        """The segmentation of the highest score: boundaries and kinds chosen jointly."""
        top, how, k = [0.0] * max(1, self.n), [-1] * max(1, self.n), 0
        for p in range(1, self.n):
            top[p] = top[p - 1]
            while k < len(self.ends) and self.ends[k][1] == p:
                if top[self.ends[k][0]] + scores[k] > top[p] + 1e-12:
                    top[p], how[p] = top[self.ends[k][0]] + scores[k], k
                k += 1
        out, p = [], self.n - 1
        while p > 0:
            if how[p] < 0:
                p -= 1
            else:
                out.append(self.spans[how[p]])
                p = self.ends[how[p]][0]
        return out[::-1]


def decode(text: str, weights: np.ndarray, barred: list[tuple[int, int]] = ()) -> list[Span]:
    """The best segmentation of the whole text by candidates that overlap nothing of ``barred`` (ascending)."""
    spans, bars = _segments(text), sorted(barred)
    if bars:
        starts, lasts = [a for a, _ in bars], list(accumulate((b for _, b in bars), max))
        spans = [s for s in spans if not (k := bisect.bisect_left(starts, s[2])) or lasts[k - 1] <= s[1]]
    if not spans:
        return []
    lattice = Lattice(text, spans)
    return lattice.best(lattice.scores(weights))


def _examples(n: int, seed: int) -> Iterator[tuple[str, list[Span]]]:
    """Made-up texts with known spans: addresses, phones and cards written in ways that the fixed patterns miss,
    among dates, counts, versions, prices, codes and plain sentences with "at" and "dot"."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 8)))

    def entity() -> tuple[str, str]:
        kind = pick("phone", "card", "ip", "email")
        if kind == "phone":
            form = pick("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "0{d} {c} {e}", "00{d} {a} {b} {c}", "1-{a}-{b}-{c}", "0{a} {b}{d} {a}")
            return kind, form.format(a=digits(3), b=digits(3), c=digits(4), d=digits(2), e=digits(4))
        if kind == "card":
            body = digits(15)
            body = next(body + str(c) for c in range(10) if luhn(body + str(c)))
            return kind, pick(".", "/").join(body[k : k + 4] for k in range(0, 16, 4))
        if kind == "ip":
            return kind, pick("[.]", "(.)", " dot ", "[dot]", "(dot)", " [.] ").join(str(x) for x in rng.integers(0, 256, 4))
        at, dot = pick(("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " dot "), (" @ ", "."), ("(at)", "(dot)"))
        domain = [word() for _ in range(rng.integers(1, 4))] + [pick("com", "org", "net", "edu", "de", "info")]
        return kind, pick(word(), word() + pick(".", "_") + word(), word() + digits(2)) + at + dot.join(domain)

    def decoy() -> str:
        return pick(
            lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)} {digits(2)}:{digits(2)}", lambda: digits(rng.integers(5, 24)),
            lambda: " ".join(digits(rng.integers(1, 6)) for _ in range(rng.integers(2, 7))), lambda: f"{digits(2)}.{digits(2)}.{digits(4)} {digits(2)}.{digits(2)}",
            lambda: word() + digits(rng.integers(8, 14)) + word(), lambda: f"{word()} at {word()} {word()}", lambda: f"{word()} at {word()}. {word().capitalize()} {word()}",
            lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
            lambda: f"{digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(4)}-{digits(4)} {digits(4)}-{digits(4)}", lambda: f"the dot {word()} at {word()} dot",
        )()

    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.integers(1, 5))) + " ", []
        for _ in range(rng.integers(1, 4)):
            if rng.random() < 0.5:
                kind, s = entity()
                text += pick("", "", {"phone": "call ", "card": "card ", "email": "mail to ", "ip": "host "}[kind])
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = decoy()
            text += s + pick(" ", ". ", ", ") + " ".join(word() for _ in range(rng.integers(1, 5))) + " "
        yield text, spans


def log_likelihood(data: list[tuple[Lattice, np.ndarray]], weights: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the true segmentations, less a ridge, and its gradient: features seen less expected."""
    value, gradient = -ridge / 2 * float((weights**2).sum()), -ridge * weights
    for lattice, truth in data:
        scores = lattice.scores(weights)
        total, chance = lattice.marginals(scores)
        value += (float(scores[truth].sum()) - total) / len(data)
        moved = -chance
        moved[truth] += 1
        np.add.at(gradient, lattice.kinds, moved[:, None] * lattice.x / len(data))
    return value, gradient


@lru_cache(maxsize=4)
def trained_weights(examples: int = 600, rounds: int = 45, seed: int = 7, ridge: float = 1e-4) -> np.ndarray:
    """Weights [kind, feature] of highest likelihood on made-up texts, by gradient steps of adapted size."""
    data = []
    for text, spans in _examples(examples, seed):
        barred = [(a, b) for _, a, b in base_spans(text)]
        found = [s for s in _segments(text) if not any(a < s[2] and s[1] < b for a, b in barred)]
        if found:
            lattice = Lattice(text, found)
            data.append((lattice, np.array([k for k, s in enumerate(lattice.spans) if s in spans], dtype=np.int64)))
    weights, mean, square = (np.zeros((len(KINDS), len(FEATURES))) for _ in range(3))
    for t in range(1, rounds + 1):
        _, gradient = log_likelihood(data, weights, ridge)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights + 0.4 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans that the field finds in the whole text and that overlap no base span."""
    return decode(text, weights, [(a, b) for _, a, b in base])


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start; equal spans once."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and, if asked for, redacted text.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans; ids
    may be null or repeat, each row stands by itself. No rows give no rows; other columns are ignored.
    Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    weights = trained_weights()

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,redacted:string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidy(batches):
            rows = []
            for text in texts:
                base = base_spans(text) if text else []
                more = added_spans(text, base, weights) if text and _TRIGGER.search(text) else []
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                spans = joined(base + more)
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), spans, _redacted(text, base + more) if redact else None))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    out = docs.select(F.col(id_col).alias("doc_id"), find(F.col(text_col)).alias("found")).select("doc_id", "found.*")
    return out if redact else out.drop("redacted")


def _redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span as its kind in brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])
