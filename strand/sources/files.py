"""Line, JSON and key-value files, read and written by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR = "~|~"


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path, compression="gzip")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A declared schema: no pass over the data to guess one; broken lines give nulls."""
    return spark.read.schema(schema).json(path)


def round_trip_jsonl(rows: DataFrame, path: str) -> DataFrame:
    write_jsonl(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def append_dict(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path, compression="gzip")


def read_dict_dump(spark: SparkSession, path: str, schema: str, key: str, version: str) -> DataFrame:
    """Appended records, the last version of each key winning; maxima are taken map-side."""
    rows = spark.read.schema(schema).json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("v")).select(key, "v.*")


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).distinct()


def write_pairs(rows: DataFrame, path: str) -> None:
    """(key, value) strings as ``key~|~value`` lines."""
    rows.select(F.concat_ws(PAIR, "key", "value").alias("value")).write.text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"~\|~", 2)
    return spark.read.text(path).select(parts[0].alias("key"), parts[1].alias("value"))


def write_framed(rows: DataFrame, path: str, begin: str = "#begin ", end: str = "#end") -> None:
    """(doc, ord, text) as documents' lines between begin and end lines; a document's frame is one record."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    rows.groupBy("doc").agg(order.alias("lines")).select(
        F.concat(F.lit(begin), F.col("doc").cast("string"), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n" + end)).alias("value")
    ).write.text(path)
