"""Small helpers over several frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def one_row(spark: SparkSession) -> DataFrame:
    """A frame of one row in one partition, to hang literal rows on."""
    return spark.range(0, 1, 1, 1)


def union_all(parts: Sequence[DataFrame], spark: SparkSession | None = None, schema: str | None = None) -> DataFrame:
    """Union by position, paired up as a tree so that building it stays cheap for many parts.

    Of no parts it is an empty frame of ``schema``.
    """
    parts = list(parts)
    if not parts:
        if spark is None or schema is None:
            raise ValueError("a union of nothing needs a schema")
        return spark.createDataFrame([], schema)
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2])
        parts = [left.unionAll(right) for left, right in pairs] + parts[len(parts) // 2 * 2 :]
    return parts[0]
