"""Projection of source columns onto target columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from martloom.functions import col
from martloom.spec import TableSpec

# Quoted texts and names, and the start of a subquery outside them.
QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")
SUBQUERY = re.compile(r"(?i)\(\s*(select|with|from|values|table)\b")


@dataclass(frozen=True)
class Mapping:
    target_table: str
    target_column: str
    source_file: str | None
    source_column: str | None
    transformation: str | None = None
    confidence: float = 1.0
    reason: str = ""


def select_mappings(mappings: Iterable[Mapping], table: str, source_file: str) -> list[Mapping]:
    """Mappings of one target table that read one source; of several for a target the last counts."""
    chosen: dict[str, Mapping] = {}
    for m in mappings:
        if m.target_table == table and m.source_file == source_file and m.source_column is not None:
            chosen[m.target_column] = m
    return list(chosen.values())


def map_columns(
    df: DataFrame, mappings: list[Mapping], spec: TableSpec | None = None, keep: Iterable[str] = ()
) -> DataFrame:
    """Select the mapped target columns, after any ``keep`` columns of the source.

    A transformation is a Spark SQL expression over the values of a row; one that Spark cannot
    resolve, or that is none of a single row (an aggregate, a window, a generator, a subquery), falls back to the
    plain source column, and a missing source column gives NULL. ``failing_mappings`` finds those
    that fail on a value.
    """
    if not mappings:
        raise ValueError("No selected mappings for this file and table")
    columns = [col(name) for name in keep]
    for m in mappings:
        value = _expression(df, m.transformation) if m.transformation else None
        if value is None:
            value = _source(df, m, spec)
        columns.append(value.alias(m.target_column))
    return df.select(columns)


def drop_empty(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """Drop the rows in which every mapped column is NULL."""
    return df.dropna("all", subset=[f"`{m.target_column}`" for m in mappings])


def _expression(df: DataFrame, text: str) -> Column | None:
    if SUBQUERY.search(QUOTED.sub("''", text)):
        return None
    try:
        # a condition takes what is made of one row only: no aggregates, windows or generators
        df.where(F.expr(f"({text}) is not null")).schema
        expression = F.expr(text)
        df.select(expression.alias("value")).schema
    except (AnalysisException, ParseException):
        return None
    return expression


def failing_mappings(df: DataFrame, mappings: Sequence[Mapping]) -> list[Mapping]:
    """Mappings whose transformation ends a job on some row: a zero divisor, a text that is no number.

    One aggregation evaluates them all; only when it fails is each looked at by itself.
    """
    tried = [(m, value) for m in mappings if m.transformation and (value := _expression(df, m.transformation)) is not None]
    if not tried or _evaluates(df, [value for _, value in tried]):
        return []
    return [m for m, value in tried if not _evaluates(df, [value])]


def without_failing(df: DataFrame, mappings: Sequence[Mapping]) -> list[Mapping]:
    """The mappings, with the plain column in place of a transformation that fails on some row of the source."""
    failing = failing_mappings(df, mappings)
    return [replace(m, transformation=None) if m in failing else m for m in mappings]


def _evaluates(df: DataFrame, values: Sequence[Column]) -> bool:
    marks = [F.bit_xor(F.xxhash64(v)).alias(f"v{i}") for i, v in enumerate(values)]
    try:
        df.agg(*marks).collect()
    except PySparkException as error:
        if isinstance(error, AnalysisException):
            raise
        return False
    return True


def _source(df: DataFrame, m: Mapping, spec: TableSpec | None) -> Column:
    if m.source_column in df.columns:
        return col(m.source_column)
    known = spec is not None and m.target_column in spec.column_names
    return F.lit(None).cast(spec.column(m.target_column).spark_type if known else T.StringType())
