"""Word files, paragraph XML and coreference corpora as tables."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(spark: SparkSession, path: str, pattern: str = "*.docx", skip: str = "*meta.docx") -> DataFrame:
    """(doc_id, content): word files below ``path``, files of the skip pattern left out; found by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    skipped = skip.replace("*", "")
    return files.filter(~F.col("path").endswith(skipped)).select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("doc_id"), "content")


def parse_docx(content: bytes) -> tuple[list[str], list[dict]]:
    """Paragraph texts by index, and comments with their first and last paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        notes = ET.fromstring(z.read("word/comments.xml")) if "word/comments.xml" in z.namelist() else None
    paragraphs, spans = [], {}
    for index, p in enumerate(body.iter(f"{W}p")):
        paragraphs.append("".join(t.text or "" for t in p.iter(f"{W}t")))
        for kind, place in (("commentRangeStart", 0), ("commentRangeEnd", 1)):
            for mark in p.iter(f"{W}{kind}"):
                spans.setdefault(mark.get(f"{W}id"), [index, index])[place] = index
    comments = []
    for c in notes.iter(f"{W}comment") if notes is not None else ():
        key = c.get(f"{W}id")
        start, end = spans.get(key, (None, None))
        comments.append({"id": key, "author": c.get(f"{W}author"), "text": "".join(t.text or "" for t in c.iter(f"{W}t")), "start": start, "end": end})
    return paragraphs, comments


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, idx, text, error): one row a paragraph; a file that can't be read gives one row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc, i, t, None) for i, t in enumerate(parse_docx(content)[0])]
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    rows.append((doc, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "text", "error"]).astype({"idx": "Int32"})

    return files.mapInPandas(parse, "doc_id string, idx int, text string, error string")


def docx_comments(files: DataFrame) -> DataFrame:
    """(doc_id, comment_id, author, text, start, end): comments with the paragraphs they span; none where there are none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc, c["id"], c["author"], c["text"], c["start"], c["end"]) for c in parse_docx(content)[1]]
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    continue  # docx_paragraphs reports the file
            yield pd.DataFrame(rows, columns=["doc_id", "comment_id", "author", "text", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    return files.mapInPandas(parse, "doc_id string, comment_id string, author string, text string, start int, end int")


def make_docx(paragraphs: list[str], comments: list[tuple[int, int, str]] = ()) -> bytes:
    """A minimal word file, for tests and demonstrations."""
    space = f'xmlns:w="{W[1:-1]}"'
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    body = ""
    for i, text in enumerate(paragraphs):
        starts = "".join(f'<w:commentRangeStart w:id="{k}"/>' for k, (a, _, _) in enumerate(comments) if a == i)
        ends = "".join(f'<w:commentRangeEnd w:id="{k}"/>' for k, (_, b, _) in enumerate(comments) if b == i)
        body += f"<w:p>{starts}<w:r><w:t>{esc(text)}</w:t></w:r>{ends}</w:p>"
    notes = "".join(f'<w:comment w:id="{k}" w:author="a"><w:p><w:r><w:t>{esc(t)}</w:t></w:r></w:p></w:comment>' for k, (_, _, t) in enumerate(comments))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        if comments:
            z.writestr("word/comments.xml", f"<w:comments {space}>{notes}</w:comments>")
    return out.getvalue()


def annotations_json(comments: DataFrame) -> DataFrame:
    """(doc_id, json): a document's comments as a JSON list of extents, author and text."""
    one = F.struct(F.array(F.struct(F.col("start").alias("startPara"), F.col("end").alias("endPara"))).alias("extents"), "author", "text")
    return comments.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


# ---- coreference corpora -------------------------------------------------------------------------------


def parse_conll(text: str) -> list[tuple[str, str, int, int, str, str]]:
    """(doc, part, utterance, token, word, coref) of a corpus file; a blank line ends an utterance."""
    rows, doc, part, utt, tok = [], "", "", 0, 0
    for line in text.splitlines():
        if line.startswith("#begin document"):
            head = line[len("#begin document") :].strip()
            doc, _, tail = head.partition(";")
            doc, part, utt, tok = doc.strip("() "), tail.replace("part", "").strip(), 0, 0
        elif line.startswith("#end"):
            continue
        elif not line.strip():
            utt, tok = utt + (tok > 0), 0
        else:
            cells = line.split()
            rows.append((doc, part, utt, tok, cells[3] if len(cells) > 3 else cells[0], cells[-1]))
            tok += 1
    return rows


def coref_spans(tags: list[str]) -> list[tuple[str, int, int]]:
    """(label, first, last) from bracket expressions joined by bars; brackets of a label nest."""
    opened: dict[str, list[int]] = {}
    out = []
    for i, tag in enumerate(tags):
        for piece in tag.split("|") if tag not in ("-", "_", "") else ():
            label = piece.strip("()")
            if piece.startswith("("):
                opened.setdefault(label, []).append(i)
            if piece.endswith(")") and opened.get(label):
                out.append((label, opened[label].pop(), i))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def bracket_tags(n: int, spans: list[tuple[str, int, int]]) -> list[str]:
    """The inverse: a tag for each of n tokens."""
    tags: list[list[str]] = [[] for _ in range(n)]
    for label, first, last in sorted(spans, key=lambda s: (s[1], -s[2])):
        if first == last:
            tags[first].append(f"({label})")
        else:
            tags[first].append(f"({label}")
            tags[last].insert(0, f"{label})")
    return ["|".join(t) or "-" for t in tags]


_CONLL = "doc string, part string, utt int, tok int, word string, coref string"


def read_conll(spark: SparkSession, path: str, rows: int = 50_000) -> DataFrame:
    """Tokens of corpus files. Where a gold and an automatic file of a name exist, the gold one is read.

    Files are read by the documents framed in them, so a task holds documents and never a file, and hands on about ``rows`` tokens at once.
    """
    text = spark.read.text(path, lineSep="\n#end document", recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    stem = F.regexp_replace("path", r"[._](gold|auto)_conll.*$", "")
    files = text.select("path").distinct().withColumns({"stem": stem, "gold": F.col("path").contains("gold").cast("int")})
    best = files.groupBy("stem").agg(F.max_by("path", "gold").alias("path")).select("path")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "part", "utt", "tok", "word", "coref"]
        for batch in batches:
            held: list[tuple] = []
            for value in batch["value"]:
                held += parse_conll(value)
                if len(held) >= rows:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            yield pd.DataFrame(held, columns=names)

    return text.join(best, "path", "left_semi").select("value").mapInPandas(parse, _CONLL)


def conll_mentions(tokens: DataFrame) -> DataFrame:
    """(doc, part, utt, label, start, end), end inclusive, by matching brackets within an utterance."""

    @F.pandas_udf("array<struct<label:string,start:int,end:int>>")
    def match(tags: pd.Series) -> pd.Series:
        return pd.Series([[{"label": a, "start": b, "end": c} for a, b, c in coref_spans(list(t))] for t in tags])

    order = F.transform(F.array_sort(F.collect_list(F.struct("tok", "coref"))), lambda x: x["coref"])
    return tokens.groupBy("doc", "part", "utt").agg(order.alias("tags")).select("doc", "part", "utt", F.explode(match("tags")).alias("s")).select("doc", "part", "utt", "s.*")


def write_conll(tokens: DataFrame, path: str) -> None:
    """Tokens (doc, part, utt, tok, word, coref) as corpus text, one document's frame a record."""
    line = F.concat_ws("\t", "doc", "part", "tok", "word", "coref")
    utts = tokens.groupBy("doc", "part", "utt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    body = utts.groupBy("doc", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    body.select(F.concat(F.lit("#begin document ("), "doc", F.lit("); part "), "part", F.lit("\n"), "body", F.lit("\n\n#end document")).alias("value")).write.text(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of text lines: a word, then numbers."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("float")).alias("vec"))


