"""Casts between the three type classes.

``lenient`` keeps the habit of loosely typed stores: text becomes the number it starts with,
or zero.  ``strict`` turns whatever is not wholly a number into NULL.  ``fit`` is the rule of
a load: only a lossless value passes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from martloom.functions.display import display
from martloom.spec import INTEGER, REAL

LENIENT, STRICT = "lenient", "strict"

# The number that a text starts with, and the limits of a 64-bit integer.
INTEGER_PREFIX = r"^\s*([+-]?[0-9]+)"
REAL_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
MAX_INTEGER = 9223372036854775807
MIN_INTEGER = -9223372036854775808
INTEGER_RANGE = 9.223372036854775807e18


def to_integer(column: Column, data_type: T.DataType, mode: str = LENIENT) -> Column:
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return column.cast("bigint")
    if _is_number(data_type):
        return _truncate(column.cast("double"))
    text = display(column, data_type)
    if mode == STRICT:
        return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
    prefix = F.regexp_extract(text, INTEGER_PREFIX, 1)
    number = prefix.try_cast("bigint")
    beyond = F.when(prefix.startswith("-"), F.lit(MIN_INTEGER)).otherwise(F.lit(MAX_INTEGER))
    return (
        F.when(text.isNull(), F.lit(None).cast("bigint"))
        .when(prefix == "", F.lit(0).cast("bigint"))
        .otherwise(F.coalesce(number, beyond))
    )


def to_real(column: Column, data_type: T.DataType, mode: str = LENIENT) -> Column:
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    if _is_number(data_type):
        return column.cast("double")
    text = display(column, data_type)
    if mode == STRICT:
        return F.when(text.rlike(NUMBER), text.try_cast("double"))
    prefix = F.regexp_extract(text, REAL_PREFIX, 1)
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(prefix.try_cast("double"), F.lit(0.0))
    )


def clean_text(column: Column, data_type: T.DataType) -> Column:
    """Text without outer spaces (other white space stays); blank text is NULL."""
    return F.nullif(F.trim(as_text(column, data_type)), F.lit(""))


def as_text(column: Column, data_type: T.DataType) -> Column:
    """Text form in a typed store, where a flag is 0 or 1."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("string")
    return display(column, data_type)


def staged(column: Column, data_type: T.DataType, type_class: str, mode: str = LENIENT) -> Column:
    """Cleaning expression of a staging model for a column of the given class."""
    if type_class == INTEGER:
        return to_integer(column, data_type, mode)
    if type_class == REAL:
        return to_real(column, data_type, mode)
    return clean_text(column, data_type)


def fit(column: Column, data_type: T.DataType, type_class: str) -> Column:
    """Value as it is stored in a target column; NULL when it would lose something."""
    if type_class == INTEGER:
        if isinstance(data_type, (T.IntegralType, T.BooleanType)):
            return column.cast("bigint")
        if _is_number(data_type):
            number = column.cast("double")
            return F.when(_is_whole(number), _truncate(number))
        text = display(column, data_type)
        number = F.when(text.rlike(NUMBER), text.try_cast("double"))
        return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint")).when(_is_whole(number), _truncate(number))
    if type_class == REAL:
        return to_real(column, data_type, STRICT)
    return as_text(column, data_type)


def _is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def _is_whole(number: Column) -> Column:
    return (number == F.floor(number)) & (F.abs(number) < INTEGER_RANGE)


def _truncate(number: Column) -> Column:
    return (
        F.when(F.isnan(number), F.lit(None).cast("bigint"))
        .when(number >= INTEGER_RANGE, F.lit(MAX_INTEGER))
        .when(number <= -INTEGER_RANGE, F.lit(MIN_INTEGER))
        .otherwise(number.try_cast("bigint"))
    )
