"""Spark's own Bloom filter expressions (those of its runtime join filters) as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.column import _to_java_column


def _utils(df: DataFrame):
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions


def build(df: DataFrame, column: str, items: int, bits: int) -> bytes | None:
    """Bloom filter over a long column, merged from one partial filter a task; None if there is no row."""
    utils, expressions = _utils(df)
    of = lambda c: utils.expression(_to_java_column(c))
    aggregate = expressions.aggregate.BloomFilterAggregate(
        of(F.col(column)), of(F.lit(items).cast("long")), of(F.lit(bits).cast("long"))
    )
    agg = ClassicColumn(utils.column(aggregate.toAggregateExpression()))
    found = df.agg(agg.alias("filter")).first()[0]
    return bytes(found) if found is not None else None


def might_contain(df: DataFrame, filter_bytes: bytes, value: Column) -> Column:
    """Whether ``value`` (long) may be among the filter's items; runs in generated code."""
    utils, expressions = _utils(df)
    test = expressions.BloomFilterMightContain(
        utils.expression(_to_java_column(F.lit(filter_bytes))), utils.expression(_to_java_column(value))
    )
    return ClassicColumn(utils.column(test))
