"""Logical type of every column, decided from the data."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from martloom.functions import col
from martloom.functions.casts import NUMBER

BOOLEAN, INTEGER, FLOAT, DATE, STRING = "boolean", "integer", "float", "date", "string"

# Fixed values.
BOOLEAN_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"
DATE_SAMPLE = 50
DATE_FORMATS = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y-%m-%dT%H:%M:%S.%f%z",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y",
    "%d-%m-%Y",
    "%d.%m.%Y",
    "%d %b %Y",
    "%b %d, %Y",
)

# No date is longer; a longer text in a sample is replaced by a mark that is none.
LONGEST_DATE = 64
TOO_LONG = "(long text)"


def schema_type(data_type: T.DataType) -> str | None:
    """Logical type of a typed column; None for text, whose values decide."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, T.NumericType):
        return FLOAT
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return None if isinstance(data_type, T.StringType) else STRING


def infer_types(df: DataFrame, order_by: str | None = None, dates: bool = True) -> dict[str, str]:
    """Logical type per column, tried in the order boolean, integer, float, date, string.

    The first rows already show most text columns to be neither flags nor numbers.  Only the
    others are tested over all rows, in one aggregation without a data shuffle.  Columns left
    over are dates when their first non-null values all parse in one format; ``order_by`` says
    what "first" means, otherwise it is the order of the scan.
    """
    types = {f.name: schema_type(f.dataType) for f in df.schema.fields}
    texts = [name for name, kind in types.items() if kind is None]
    if not texts:
        return types
    sample = _first_rows(df, texts, order_by)
    open_columns = [n for n in texts if not sample[n] or _kind(sample[n]) != STRING]
    found = _whole_kinds(df, open_columns)
    for name in texts:
        types[name] = found.get(name) or STRING
    rest = [n for n in texts if types[n] == STRING and not (n in found and found[n] is None)] if dates else []
    # a column with few values in the first rows is looked up further down, unless these show already that it holds no dates
    sparse = [n for n in rest if len(sample[n]) < DATE_SAMPLE and (not sample[n] or _is_date(sample[n]))]
    sample |= first_texts(df, sparse, order_by)
    return types | {n: DATE for n in rest if sample[n] and _is_date(sample[n])}


def _first_rows(df: DataFrame, names: list[str], order_by: str | None) -> dict[str, list[str]]:
    """Non-null values of the first rows, by column; a bounded number of short texts."""
    keys = [col(order_by).alias("__ord")] if order_by else []
    rows = df.select(*keys, *[_short(col(n)).alias(f"c{i}") for i, n in enumerate(names)])
    rows = (rows.orderBy("__ord") if order_by else rows).take(DATE_SAMPLE)
    return {n: [r[f"c{i}"] for r in rows if r[f"c{i}"] is not None] for i, n in enumerate(names)}


def first_texts(df: DataFrame, names: list[str], order_by: str | None) -> dict[str, list[str]]:
    """The first non-null values of several columns, shortened, in one pass.

    Every task keeps the first few of each column before the rest meet, so a column's values are never gathered.
    Without ``order_by`` they come in the order of the scan.
    """
    if not names:
        return {}
    place = col(order_by) if order_by else F.monotonically_increasing_id()
    cells = [F.when(col(n).isNotNull(), F.struct(F.lit(i).alias("at"), F.col("__ord").alias("ord"), _short(col(n)).alias("value"))) for i, n in enumerate(names)]
    filled = df.select(place.alias("__ord"), *map(col, names)).select(F.inline(F.array_compact(F.array(*cells))))
    first = filled.withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy("ord"))).where(F.col("rank") <= DATE_SAMPLE)
    out: dict[str, list[str]] = {n: [] for n in names}
    for r in sorted(first.collect(), key=lambda r: r["rank"]):  # DATE_SAMPLE short texts a column at most
        out[names[r["at"]]].append(r["value"])
    return out


def _short(value: Column) -> Column:
    return F.when(F.length(value) > LONGEST_DATE, F.lit(TOO_LONG)).otherwise(value)


def _kind(values: list[str]) -> str:
    """What a sample could still be: numbers and flags are told apart over all rows."""
    if all(v in BOOLEAN_TOKENS for v in values):
        return BOOLEAN
    numeric = all(v == TOO_LONG or re.search(NUMBER, v) or re.search(INFINITY, v) for v in values)
    return FLOAT if numeric else STRING


def _is_date(values: list[str]) -> bool:
    return any(all(_parses(v.strip(), fmt) for v in values) for fmt in DATE_FORMATS)


def _parses(value: str, fmt: str) -> bool:
    try:
        datetime.strptime(value, fmt)
    except ValueError:
        return False
    return True


def _whole_kinds(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """Boolean, integer, float or string by all values of each column; None without any value."""
    if not names:
        return {}
    marks = df.select([_mark(col(name)).alias(f"m{i}") for i, name in enumerate(names)])
    row = marks.agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(len(names))]).first()
    return {name: None if row[f"m{i}"] is None else KIND_OF_MARKS.get(row[f"m{i}"], STRING) for i, name in enumerate(names)}


# One bit per kind of value; the bits seen in a column tell its type.
WHOLE_MARK, FLAG_MARK, REAL_MARK, WORD_MARK = 1, 2, 4, 8
KIND_OF_MARKS = {
    WHOLE_MARK: INTEGER,
    FLAG_MARK: BOOLEAN,
    REAL_MARK: FLOAT,
    WHOLE_MARK | REAL_MARK: FLOAT,
}


# Whole numbers with no more characters fit 64 bits.
SAFE_LENGTH = 18


def _mark(value: Column) -> Column:
    # patterns come before casts: a cast that fails costs far more than a pattern that does not match
    # a number is whole when it has neither point nor exponent
    whole = ~(F.contains(value, F.lit(".")) | F.contains(value, F.lit("e")) | F.contains(value, F.lit("E")))
    fits = (F.length(value) <= SAFE_LENGTH) | value.try_cast("bigint").isNotNull()
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        # a whole number beyond 64 bits stays text: a double would lose digits
        .when(value.rlike(NUMBER), F.when(~whole, F.lit(REAL_MARK)).when(fits, F.lit(WHOLE_MARK)).otherwise(F.lit(WORD_MARK)))
        .when(value.rlike(INFINITY), F.lit(REAL_MARK))
        .when(value.isin(*BOOLEAN_TOKENS), F.lit(FLAG_MARK))
        .otherwise(F.lit(WORD_MARK))
    )


def first_values(df: DataFrame, name: str, count: int | None, order_by: str | None = None) -> DataFrame:
    """The first non-null values of one column: a top-k, or a limit in scan order."""
    keys = [col(order_by)] if order_by else []
    rows = df.select(*[k.alias("ord") for k in keys], col(name).alias("value")).where(F.col("value").isNotNull())
    rows = rows.orderBy("ord") if order_by else rows
    return rows.limit(count) if count else rows


CAST_TYPE = {BOOLEAN: "boolean", INTEGER: "bigint", FLOAT: "double"}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to their inferred types; dates stay text, as read."""
    columns = []
    for f in df.schema.fields:
        target = CAST_TYPE.get(types.get(f.name, STRING))
        typed = isinstance(f.dataType, T.StringType) and target
        columns.append(col(f.name).try_cast(target).alias(f.name) if typed else col(f.name))
    return df.select(columns)
