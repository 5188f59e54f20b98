"""Helpers shared by the corpus operators: picking columns, Arrow batches, row filters."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Where Python workers find this package, if it is not installed there.
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

# Rows that one step of a Python task holds at a time.
STEP_ROWS = 512


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])


def place(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name, else the first that differs by case only."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not alike:
        raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")
    return alike[0]


def by_place(df: DataFrame) -> DataFrame:
    """The frame with columns ``c0``, ``c1``, ...: names that clash can do no harm."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under just these names, whatever else ``df`` has."""
    return by_place(df).select(*(F.col(f"c{place(df, n)}").alias(n) for n in names))


def map_batches(df: DataFrame, schema: str, work: Callable[[Iterator[list[list]]], Iterator[list[list]]]) -> DataFrame:
    """``work`` gets steps of at most ``STEP_ROWS`` rows as lists of columns and yields lists of columns."""
    ready(df.sparkSession)
    out = StructType.fromDDL(schema)

    def run(batches):
        kinds = to_arrow_schema(out)
        for columns in work(_steps(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return df.mapInArrow(run, out)


def _steps(batches) -> Iterator[list[list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield [c.to_pylist() for c in batch.slice(at, STEP_ROWS).columns]


def filter_rows(df: DataFrame, column: str, judge: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows whose ``column`` value is accepted; all columns and their names stay.

    ``judge`` is called once per task and returns the function that judges a list of values.
    """
    ready(df.sparkSession)
    at, plain = place(df, column), by_place(df)

    def run(batches):
        accept = judge()
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                yield part.filter(pa.array(accept(part.column(at).to_pylist()), type=pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def file_system(folder: str):
    """(file system, path) of a folder's address, for tasks as for the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1))


def crc_remainder(key: str, modulus: int):
    """crc32 of a key written as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
