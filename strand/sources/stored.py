"""Files kept by address and version, models written and read back, and made-up dates and labels."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strand.plans.cut import exists


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def entry_name(url: str, etag: str | None = None) -> str:
    """A file name for an address and its version: hashes of both, so a new version is a new entry."""
    parts = [hashlib.sha256(x.encode()).hexdigest() for x in (url, etag) if x]
    return ".".join(parts)


def version_of(spark: SparkSession, url: str) -> str:
    """What tells versions of a file apart: the store's own tag where it has one, else time and size."""
    fs, path = _file_system(spark, url)
    status = fs.getFileStatus(path)
    try:
        tag = status.getEtag()
    except Exception:  # not a store with tags
        tag = None
    return str(tag) if tag else f"{status.getModificationTime()}-{status.getLen()}"


def cached_path(spark: SparkSession, url: str, cache: str) -> str:
    """Where in the folder ``cache`` a copy of ``url`` is, copied first if this version isn't there.

    Addresses of any file system that Spark's Hadoop client reads (file, hdfs, s3a, http). A copy is written under
    another name and then renamed, so that none is seen half; beside it stands what it is a copy of.
    """
    version = version_of(spark, url)
    target = f"{cache}/{entry_name(url, version)}"
    if exists(spark, target):
        return target
    source_fs, source = _file_system(spark, url)
    fs, part = _file_system(spark, f"{target}.part")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, source, fs, part, False, True, spark._jsc.hadoopConfiguration())
    out = fs.create(_file_system(spark, f"{target}.json")[1], True)
    out.write(bytearray(json.dumps({"url": url, "etag": version}).encode()))
    out.close()
    fs.rename(part, _file_system(spark, target)[1])
    return target


def entry_source(spark: SparkSession, entry: str) -> tuple[str, str]:
    """Address and version of a cached copy."""
    text = "".join(r["value"] for r in spark.read.text(f"{entry}.json").collect())  # one small file
    found = json.loads(text)
    return found["url"], found["etag"]


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver in any file system."""
    fs, target = _file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(data))
    out.close()


def save_model(spark: SparkSession, path: str, layers: list[tuple[np.ndarray, np.ndarray]], vectors: DataFrame, settings: dict[str, float]) -> None:
    """A scorer's layers (weights, bias), its word vectors (any columns) and its settings under ``path``, as tables."""
    rows = [(k, name, [int(n) for n in a.shape], a.astype(float).ravel().tolist()) for k, layer in enumerate(layers) for name, a in zip(("weights", "bias"), layer, strict=True)]
    spark.createDataFrame(rows, "layer int, name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/layers")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame(sorted(settings.items()), "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], DataFrame, dict[str, float]]:
    """What :func:`save_model` wrote. Layers are a model's size and go to the driver; vectors stay a table."""
    found = {(r["layer"], r["name"]): np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/layers").collect()}
    layers = [(found[k, "weights"], found[k, "bias"]) for k in range(len(found) // 2)]
    settings = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()}
    return layers, spark.read.parquet(f"{path}/vectors"), settings


def mock_labels(passages: DataFrame, first: str = "2000-01-01", days: int = 3650, share: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``passages`` with a made-up date of creation and label: both follow from a hash of the id, so reruns agree."""
    draw = lambda at: F.conv(F.substring(F.md5(F.col(id_col).cast("string")), at, 8), 16, 10).cast("long")
    return passages.withColumns({"created": F.date_add(F.to_date(F.lit(first)), F.pmod(draw(1), F.lit(days)).cast("int")), "label": (F.pmod(draw(9), F.lit(share)) == 0).cast("int")})
