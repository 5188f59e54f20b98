"""Text forms of values of any type, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def display(column: Column, data_type: T.DataType) -> Column:
    """The text a person would read: JSON for nested values, plain decimals for numbers."""
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return real_text(column)
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return json_text(column, data_type)
    if isinstance(data_type, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def real_text(number: Column) -> Column:
    """``10000000.0`` rather than ``1.0E7``; exponents only from 1e15 up and below 1e-4."""
    shortest = number.cast("string")
    size = F.abs(number)
    plain = F.regexp_replace(shortest.try_cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    exponent = F.regexp_replace(F.regexp_replace(shortest, r"E(-?)([0-9])$", "E$10$2"), "E([0-9])", "E+$1")
    return (
        F.when((size >= 1e7) & (size < 1e15), plain)
        .when((size >= 1e-4) & (size < 1e-3), plain)
        .when((size >= 1e15) | ((size > 0) & (size < 1e-4)), F.lower(exponent))
        .otherwise(shortest)
    )


def json_text(column: Column, data_type: T.DataType) -> Column:
    """JSON with sorted keys and a space after ``,`` and ``:``; absent struct fields are left out."""
    if isinstance(data_type, T.StructType):
        entries = [
            F.concat(F.lit(_json_string(f.name) + ": "), json_text(column.getField(f.name), f.dataType))
            for f in sorted(data_type.fields, key=lambda f: f.name)
        ]
        body = F.array_join(F.array(*entries), ", ") if entries else F.lit("")
        return F.when(column.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))
    if isinstance(data_type, T.ArrayType):
        items = F.transform(column, lambda item: F.coalesce(json_text(item, data_type.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    if isinstance(data_type, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        pairs = F.transform(
            entries,
            lambda e: F.concat(
                json_text(e["key"].cast("string"), T.StringType()),
                F.lit(": "),
                F.coalesce(json_text(e["value"], data_type.valueType), F.lit("null")),
            ),
        )
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    if isinstance(data_type, T.BooleanType):
        return column.cast("string")
    if isinstance(data_type, T.NumericType):
        return display(column, data_type)
    # to_json of a one-item array escapes the text; the brackets are cut off again
    quoted = F.to_json(F.array(display(column, data_type)))
    return F.when(column.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _json_string(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)
