"""JSON scan: arrays, wrapped arrays, single objects and JSON Lines; flattening."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from martloom.functions import col
from martloom.operators.typing import FLOAT, INTEGER, apply_types, infer_types
from martloom.sources.files import BLOCK, FILE, all_files, as_written, distinct_by_case, file_column, literal_path, provenance_columns

LINES, ARRAY, OBJECT = "lines", "array", "object"
# A file of one line that is an object: JSON Lines with one row, or a document.
ONE_LINE, BROKEN = "one line", "broken"
# Fixed value: the message for a document without rows.
NOT_TABULAR = "JSON source must contain an object or array of objects"

# Something behind the end of an object that is none of what may follow inside a document.
BEHIND = r"\}\s*[^\s,}\]]"


def scan_json(
    spark: SparkSession, path: str, rows: int | None = None, provenance: bool = False, infer: bool = True
) -> DataFrame:
    """Read a JSON source; its form is found from all its files.

    Documents are flattened, with columns in the order in which their keys, at each level, are seen first.
    JSON Lines split into parallel tasks, keep nested values whole and turn text columns that
    hold only numbers into numbers.  Any other document is a single split, so large sources
    should come as JSON Lines or as many files.
    """
    form, keys = json_facts(spark, path)
    if form == LINES:
        df = _read(spark, path, provenance, multi_line=False)
        df = _in_order(df, _line_keys(spark, path, df.columns, keys))
    elif form == ARRAY:
        df = _read(spark, path, provenance, multi_line=True)
        df = flatten(df, _first_seen(_records(spark, path, None), df.schema))
    else:
        df = _object_rows(spark, path, provenance)
    if rows:
        df = df.limit(rows)
    return apply_types(df, number_types(df)) if form == LINES and infer else df


def is_lines(spark: SparkSession, path: str) -> bool:
    return json_form(spark, path) == LINES


def number_types(df: DataFrame) -> dict[str, str]:
    """Text columns that hold only numbers, and every other column as it is."""
    return {k: v for k, v in infer_types(df, dates=False).items() if v in (INTEGER, FLOAT)}


def json_form(spark: SparkSession, path: str) -> str:
    return json_facts(spark, path)[0]


def json_facts(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The one form of all files that are not empty, and the keys of the first line of the file with the first path.

    A file is JSON Lines when its first line is a whole object and more text follows. Files of
    one line follow the others, and are documents when there are no others. A mixture of forms is an error that
    names a file of each, and so is a line with anything behind its object.
    """
    line = F.ltrim(F.regexp_replace("value", "^﻿", ""))
    first = F.struct(
        F.monotonically_increasing_id().alias("row"),
        F.substring(line, 1, 1).alias("mark"),
        F.json_object_keys(line).alias("keys"),
        F.json_array_length(line).isNotNull().alias("array"),
    )
    behind = line.rlike(BEHIND) & F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))).isNull()
    found = (
        _text(spark, path)
        .where(F.trim("value") != "")
        .select(file_column("file"), F.when(F.col("_metadata.file_block_start") == 0, first).alias("first"), behind.alias("behind"))
        .groupBy("file")
        .agg(F.min("first").alias("first"), F.count("*").alias("lines"), F.count_if("behind").alias("behind"))
        .withColumn("file", as_written(F.col("file")))
    )
    more = F.col("lines") > 1
    kind = (
        F.when(~F.coalesce(F.col("first.mark"), F.lit("")).isin("[", "{") | (more & F.col("first.array")), BROKEN)
        .when(F.col("first.mark") == "[", ARRAY)
        .when(F.col("first.keys").isNotNull(), F.when(F.col("behind") > 0, BROKEN).when(more, LINES).otherwise(ONE_LINE))
        .otherwise(OBJECT)
    )
    by_kind = found.groupBy(kind.alias("kind")).agg(F.min("file").alias("file"), F.min(F.struct("file", "first.keys")).alias("start"))
    rows = by_kind.collect()
    forms = {r["kind"]: r["file"] for r in rows}
    if BROKEN in forms:
        raise ValueError(f"{NOT_TABULAR}: {forms[BROKEN]}")
    if not forms:
        raise ValueError(NOT_TABULAR)
    whole = sorted(set(forms) - {ONE_LINE})
    if len(whole) > 1:
        raise ValueError(f"JSON files of different forms: {', '.join(f'{k} in {forms[k]}' for k in whole)}")
    return (whole[0] if whole else OBJECT), min(r["start"] for r in rows)["keys"] or []


def _text(spark: SparkSession, path: str, **options) -> DataFrame:
    return all_files(spark).text(literal_path(spark, path), **options)


def flatten(df: DataFrame, order: dict[str, list[str]] | None = None) -> DataFrame:
    """Nested objects as dotted columns, plain columns first; lists stay whole.

    ``order`` has the keys of each object in their order, by dotted path ("" for the rows).
    """
    return df.select([path.alias(name) for path, name in _leaves(df.schema, None, "", order or {})])


def _leaves(schema: T.StructType, parent: Column | None, prefix: str, order: dict) -> Iterator[tuple[Column, str]]:
    nested = []
    rank = {key: i for i, key in enumerate(order.get(prefix.removesuffix("."), []))}
    for f in sorted(schema.fields, key=lambda f: rank.get(f.name, len(rank))):
        value = col(f.name) if parent is None else parent.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            nested.append((f, value))
        else:
            yield value, prefix + f.name
    for f, value in nested:
        yield from _leaves(f.dataType, value, f"{prefix}{f.name}.", order)


def _read(spark: SparkSession, path: str, provenance: bool, multi_line: bool) -> DataFrame:
    places = provenance_columns() if provenance else []
    reader = all_files(spark).option("multiLine", multi_line)
    try:
        df = reader.json(literal_path(spark, path)).select("*", *places)
        alike = distinct_by_case(df.columns) != df.columns
    except AnalysisException as error:
        if error.getCondition() not in ("COLUMN_ALREADY_EXISTS", "AMBIGUOUS_REFERENCE"):
            raise
        alike = True
    if alike:
        df = _by_case(spark, path, multi_line, places)
    if not set(df.columns) - {FILE, BLOCK}:
        raise ValueError(NOT_TABULAR)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{NOT_TABULAR}: {path}")
    return df


def _by_case(spark: SparkSession, path: str, multi_line: bool, places: Sequence[Column]) -> DataFrame:
    """Keys that differ by case only as columns of their own, named so that Spark tells them apart."""
    apart = spark.newSession()  # names by case in a session of its own: others may be reading in this one
    apart.conf.set("spark.sql.caseSensitive", "true")
    schema = all_files(apart).option("multiLine", multi_line).json(literal_path(spark, path)).schema
    text = _text(spark, path, wholetext=multi_line).where(F.trim("value") != "").select("value", *places)
    record = F.from_json("value", schema)
    if multi_line:
        array = F.substring(F.ltrim("value"), 1, 1) == "["
        record = F.explode(F.when(array, F.from_json("value", T.ArrayType(schema))).otherwise(F.array(record)))
    extra = [FILE, BLOCK] if places else []
    rows = text.select(record.alias("__record"), *extra).select("__record.*", *extra)
    return rows.toDF(*distinct_by_case(schema.names), *extra)


def _object_rows(spark: SparkSession, path: str, provenance: bool) -> DataFrame:
    """Rows of object documents: the first list in document order, or the object itself.

    Documents of one folder must agree on which list that is.
    """
    df = _read(spark, path, provenance, multi_line=True)
    lists = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    keys = _documents(spark, path).select(F.json_object_keys("value").alias("keys"))
    in_lists = F.filter("keys", lambda k: k.isin(*lists)) if lists else F.array().cast("array<string>")
    found = keys.select(F.get(in_lists, F.lit(0)).alias("key")).distinct().head(2)
    if len(found) > 1:
        raise ValueError(f"Object documents with different lists of rows: {path}")
    key = found[0]["key"]
    if key is None:
        return flatten(df, _first_seen(_records(spark, path, None), df.schema))
    element = lists[key].elementType
    if not isinstance(element, T.StructType):
        # an empty list has no rows; a list of anything but objects is no table
        if df.where(F.size(col(key)) > 0).isEmpty():
            return df.limit(0)
        raise ValueError(NOT_TABULAR)
    extra = [FILE, BLOCK] if provenance else []
    rows = df.select(F.explode(col(key)).alias("__item"), *extra).select("__item.*", *extra)
    return flatten(rows, _first_seen(_records(spark, path, key), rows.schema))


def _in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns in the order in which the source shows them first."""
    rank = {key: i for i, key in enumerate(keys)}
    return df.select([col(n) for n in sorted(df.columns, key=lambda n: rank.get(n, len(rank)))])


def _line_keys(spark: SparkSession, path: str, columns: list[str], first: list[str]) -> list[str]:
    """Keys in order; all lines are looked at only when the first one lacks several columns."""
    if len({*columns} - {*first, FILE, BLOCK}) <= 1:
        return first
    lines = _text(spark, path).where(F.trim("value") != "")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return _first_seen(lines.select(place.alias("place"), F.col("value").alias("record")), T.StructType()).get("", [])


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file that is not empty as one text."""
    whole = _text(spark, path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.where(F.trim("value") != "")


def _records(spark: SparkSession, path: str, key: str | None) -> DataFrame:
    """(place, record) of the objects of all documents; with ``key`` of the list below it."""
    value = F.col("value")
    if key is None:
        array = F.substring(F.ltrim(F.regexp_replace(value, "^﻿", "")), 1, 1) == "["
        items = F.when(array, F.from_json(value, "array<string>")).otherwise(F.array(value))
    else:
        schema = T.StructType([T.StructField(key, T.ArrayType(T.StringType()))])
        items = F.from_json(value, schema).getField(key)
    found = _documents(spark, path).select("file", F.posexplode(items).alias("row", "record"))
    return found.select(F.struct("file", "row").alias("place"), "record")


def _first_seen(records: DataFrame, schema: T.StructType) -> dict[str, list[str]]:
    """Keys of the rows and of every object below them, by first position; as many rows as keys."""
    objects = [F.struct(F.lit(name).alias("at"), F.json_object_keys(text).alias("keys")) for name, text in _objects(schema, F.col("record"), "")]
    at = records.select("place", F.inline(F.array(*objects))).select("place", "at", F.posexplode("keys").alias("pos", "key"))
    seen = at.groupBy("at", "key").agg(F.min(F.struct("place", "pos")).alias("first")).orderBy("first").collect()
    order: dict[str, list[str]] = {}
    for row in seen:
        order.setdefault(row["at"], []).append(row["key"])
    return order


def _objects(schema: T.StructType, text: Column, prefix: str) -> Iterator[tuple[str, Column]]:
    """Dotted path and text of the rows and of each nested object."""
    yield prefix, text
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType) and "'" not in f.name:
            inner = F.get_json_object(text, f"$['{f.name}']")
            yield from _objects(f.dataType, inner, f"{prefix}.{f.name}" if prefix else f.name)
