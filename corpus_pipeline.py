"""A corpus from raw documents to packed sequences, by five of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strand.llm.common import materialize, table
from strand.llm.exact_dedup import drop_exact_duplicates
from strand.llm.minhash import drop_near_duplicates
from strand.llm.mixing import mix_sources
from strand.llm.packing import pack
from strand.llm.quality import drop_low_quality, train
from strand.llm.queries import tokenizer_path

#: Near-duplicates here are judged on shingles of five words, at a similarity of 0.8 or more.
NEAR_WIDTH = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, doesn't reject.

    Each row is judged by its own text, empty and null ones like others, so null and repeated ids make no
    difference; without usable labels all rows stay. No rows give no rows, columns of any name pass.
    """
    return drop_low_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the smallest id.

    Null text is as empty text. A row is told by id and text, so where rows repeat an id each text is judged by
    itself; of rows that repeat both one stays. A null id loses to any id. Columns of any name pass.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id.

    Texts without words are near nothing and stay. Rows are told apart, null and repeated ids treated and columns
    passed as in ``exact_dedup``.
    """
    return drop_near_duplicates(docs, width=NEAR_WIDTH)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its own draw say.

    Null text has size 0, a null source is one of its own, a source without words is taken 0 times; rows that
    repeat an id draw alike. No rows give no rows, columns of any name pass.
    """
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Null text is one piece of the end id alone; null ids and copies of a document are packed each by itself. No
    rows give no rows. The columns are those of the packing, not of documents.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("packing", packing),
]

#: No SQL: the first stage trains trees and the last one runs a tokenizer. tests/llm holds the rows
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what its predecessor has kept, written in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
