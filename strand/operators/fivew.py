"""Who, what, when, where, why and how of passages: an annotator protocol and a rule-based default."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strand.functions.dates import extract_dates

QUESTIONS = ("who", "what", "when", "where", "why", "how")
Token = dict[str, object]
Annotator = Callable[[str], list[Token]]
_WORD = re.compile(r"\w+|[^\w\s]")
_PLACE = frozenset("in at from near to".split())
_WHY, _HOW = frozenset("because since due therefore so".split()), frozenset("by with through via using".split())


def annotate(text: str) -> list[Token]:
    """Tokens with sentence, offsets, a coarse tag and entity: capitalised words inside a sentence are names,
    those after a place preposition places. The default where no model is given."""
    out, sent, fresh = [], 0, True
    for m in _WORD.finditer(text):
        word = m.group()
        name = word[:1].isupper() and not fresh and len(word) > 1
        before = out[-1]["word"].lower() if out else ""
        out.append({
            "index": len(out), "word": word, "sent": sent, "start": m.start(), "end": m.end(),
            "pos": "NNP" if name else "." if not word[0].isalnum() else "NN", "ner": ("LOCATION" if before in _PLACE else "PERSON") if name else "O",
        })
        fresh = word in ".!?"
        sent += fresh
    return out


def extract(tokens: list[Token], text: str, base: dt.date) -> dict[str, str]:
    """The best candidate of each question, the earliest winning; empty where there is none."""
    runs: list[tuple[str, list[Token]]] = []
    for t in tokens:
        if t["ner"] != "O" and runs and runs[-1][0] == t["ner"] and runs[-1][1][-1]["index"] == t["index"] - 1:
            runs[-1][1].append(t)
        elif t["ner"] != "O":
            runs.append((t["ner"], [t]))
    said = lambda run: " ".join(t["word"] for t in run)
    first = lambda kind: next((said(r) for k, r in runs if k == kind), "")
    rest = lambda marks: next((text[t["start"] : min((u["start"] for u in tokens[t["index"] :] if u["word"] in ".!?;"), default=len(text))].strip() for t in tokens if t["word"].lower() in marks), "")
    who = first("PERSON")
    after = next((r[-1]["index"] + 1 for k, r in runs if k == "PERSON"), 0)
    what = " ".join(t["word"] for t in tokens[after : after + 8] if t["pos"] != ".")
    dates = extract_dates(text, base)
    return dict(zip(QUESTIONS, (who, what, dates[0][0] if dates else "", first("LOCATION"), rest(_WHY), rest(_HOW)), strict=True))


def answers(passages: DataFrame, base: dt.date, annotator: Annotator = annotate, max_words: int = 2000, max_chars: int = 99_980) -> DataFrame:
    """(doc_id, who … how, error) of passages (doc_id, text). Passages that are too long, and any that the annotator
    fails on, keep their row with an error and empty answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text, error, found = text or "", None, dict.fromkeys(QUESTIONS, "")
                if len(text) > max_chars or len(text.split()) > max_words:
                    error = "too long"
                else:
                    try:
                        found = extract(annotator(text), text, base)
                    except Exception as e:  # one passage, not the batch
                        error = f"{type(e).__name__}: {e}"
                rows.append((doc, *found.values(), error))
            yield pd.DataFrame(rows, columns=["doc_id", *QUESTIONS, "error"])

    return passages.select("doc_id", "text").mapInPandas(run, "doc_id string, " + ", ".join(f"`{q}` string" for q in QUESTIONS) + ", error string")


def _slices(batches: Iterator[pd.DataFrame], chars: int = 200_000) -> Iterator[pd.DataFrame]:
    """Batches cut where the texts of one pass ``chars``: annotations take many times a text's memory, and a worker holds one slice's."""
    for batch in batches:
        ends = batch["text"].fillna("").str.len().cumsum().to_numpy() // chars
        for _, part in batch.groupby(ends, sort=True):
            yield part


def token_rows(passages: DataFrame, annotator: Annotator = annotate) -> DataFrame:
    """(doc_id, tokens): annotated tokens as an array of structs."""

    kind = passages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [annotator(t or "") for t in batch["text"]]})

    return passages.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, tokens array<struct<index:int,word:string,sent:int,start:int,end:int,pos:string,ner:string>>")


def entity_rows(found: DataFrame, valid: str = "error is null") -> DataFrame:
    """(doc_id, question, entity): non-empty who and where answers."""
    flat = found.filter(valid).select("doc_id", F.explode(F.create_map(F.lit("who"), F.col("who"), F.lit("where"), F.col("where"))).alias("question", "entity"))
    return flat.filter("entity <> ''")


def mention_spans(tokens: DataFrame, longest: int = 6) -> DataFrame:
    """(doc_id, sent, start, end, text): maximal runs of name tokens, and pronouns, within a sentence."""
    pronouns = F.lower("t.word").isin("he", "she", "it", "they", "him", "her", "them", "we", "i", "you")
    flat = tokens.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.*", (F.col("t.ner") != "O").alias("name"), pronouns.alias("pronoun")).filter("name or pronoun")
    from pyspark.sql import Window

    run = F.col("index") - F.row_number().over(Window.partitionBy("doc_id", "sent", "pronoun").orderBy("index"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("index", "word"))), lambda x: x["word"])
    grouped = flat.withColumn("run", F.when(F.col("pronoun"), F.col("index") + 1_000_000).otherwise(run)).groupBy("doc_id", "sent", "run").agg(F.min("index").alias("start"), (F.max("index") + 1).alias("end"), words.alias("words"))
    return grouped.filter(F.size("words") <= longest).select("doc_id", "sent", "start", "end", F.array_join("words", " ").alias("text"))


# ---- constituents -----------------------------------------------------------------------------------------

Parser = Callable[[list[Token]], str]
_VERBS = frozenset("is are was were be been has have had do does did will would can could may might shall should must said says".split())
_PREPOSITIONS = frozenset("in at from near to of on by with through via for into over under about".split())


def chunk_tree(tokens: list[Token]) -> str:
    """A shallow bracketed tree of one sentence: noun phrases, verb groups, and prepositions with the phrase that follows.
    The default where no parser is given."""
    kinds = []
    for t in tokens:
        word = str(t["word"]).lower()
        kinds.append("P" if word in _PREPOSITIONS else "V" if word in _VERBS else "." if t["pos"] == "." else "N")
    escape = {"(": "-LRB-", ")": "-RRB-"}
    leaves = [f"({t['pos']} {escape.get(str(t['word']), t['word'])})" for t in tokens]
    out, i = [], 0

    def run(start: int, kind: str) -> int:
        end = start
        while end < len(kinds) and kinds[end] == kind:
            end += 1
        return end

    while i < len(kinds):
        if kinds[i] == ".":
            out.append(leaves[i])
            i += 1
            continue
        if kinds[i] == "P":
            end = run(i + 1, "N")
            inner = f" (NP {' '.join(leaves[i + 1 : end])})" if end > i + 1 else ""
            out.append(f"(PP {leaves[i]}{inner})")
        else:
            end = run(i, kinds[i])
            out.append(f"({'VP' if kinds[i] == 'V' else 'NP'} {' '.join(leaves[i:end])})")
        i = end
    return f"(S {' '.join(out)})"


def constituents(passages: DataFrame, annotator: Annotator = annotate, parser: Parser = chunk_tree, longest: int = 300) -> DataFrame:
    """(doc_id, sent, tree, error): one tree a sentence. Sentences of more than ``longest`` tokens, and any that the parser
    fails on, keep their row with an error and no tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                sentences: dict[int, list[Token]] = {}
                for t in annotator(text or ""):
                    sentences.setdefault(int(t["sent"]), []).append(t)
                for sent, tokens in sentences.items():
                    tree, error = None, None
                    if len(tokens) > longest:
                        error = "too long"
                    else:
                        try:
                            tree = parser(tokens)
                        except Exception as e:  # one sentence, not the batch
                            error = f"{type(e).__name__}: {e}"
                    rows.append((doc, sent, tree, error))
            yield pd.DataFrame(rows, columns=["doc_id", "sent", "tree", "error"])

    return passages.select("doc_id", "text").mapInPandas(run, "doc_id string, sent int, tree string, error string")


# ---- environment ------------------------------------------------------------------------------------------


def environment(passages: DataFrame, base: dt.date, annotator: Annotator = annotate, near_days: int = 1) -> DataFrame:
    """(doc_id, question, rank, answer, score): candidates for where and when of each passage, best first.

    Places are runs of place names, dates those that the text names. A candidate's score is its share of mentions and
    how early it comes. Dates within ``near_days`` of a better one, and places that repeat a better one's words, are
    the same answer and go.
    """

    def ranked(found: list[tuple[str, int]], size: int, same) -> list[tuple[str, float]]:
        total = max(1, len(found))
        first: dict[str, int] = {}
        count: dict[str, int] = {}
        for said, at in found:
            first.setdefault(said, at)
            count[said] = count.get(said, 0) + 1
        scored = sorted(((0.5 * count[x] / total + 0.5 * (1 - first[x] / max(1, size)), -first[x], x) for x in count), reverse=True)
        out: list[tuple[str, float]] = []
        for score, _, said in scored:
            if not any(same(said, kept) for kept, _ in out):
                out.append((said, round(score, 6)))
        return out

    def near(a: str, b: str) -> bool:
        return abs((dt.date.fromisoformat(a) - dt.date.fromisoformat(b)).days) <= near_days

    def alike(a: str, b: str) -> bool:
        x, y = set(a.lower().split()), set(b.lower().split())
        return bool(x & y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                tokens = annotator(text)
                places: list[tuple[str, int]] = []
                for t in tokens:
                    if t["ner"] != "LOCATION":
                        continue
                    if places and t["index"] > 0 and tokens[t["index"] - 1]["ner"] == "LOCATION":
                        said, at = places.pop()
                        places.append((f"{said} {t['word']}", at))
                    else:
                        places.append((str(t["word"]), int(t["start"])))
                dates = [(when.date().isoformat(), max(0, text.find(said))) for said, when in extract_dates(text, base)]
                for question, found, same in (("where", places, alike), ("when", dates, near)):
                    rows += [(doc, question, k, said, score) for k, (said, score) in enumerate(ranked(found, len(text), same))]
            yield pd.DataFrame(rows, columns=["doc_id", "question", "rank", "answer", "score"])

    return passages.select("doc_id", "text").mapInPandas(run, "doc_id string, question string, rank int, answer string, score double")
