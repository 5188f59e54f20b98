"""CSV scan: header, missing-value tokens, type inference.

Every file of a source is read by its own header, and as lines or as one document, whichever its
quotes ask for. Both are found in one pass over the lines of all files, combined per file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from martloom.functions import col
from martloom.functions.missing import na_to_null
from martloom.operators.typing import apply_types, infer_types
from martloom.sources.files import BLOCK, FILE, all_files, as_written, distinct_by_case, file_column, leaf_files, literal_path, provenance_columns

BAD_ROW = "__bad_row"

# A line that ends inside a quoted value: whole fields, each with its comma, and then a quote that nothing closes.
# A quote opens a value at the start of a field only; two quotes inside one stand for a quote, and what follows its end belongs
# to the field. Every part is possessive, so lines of any length are matched without going back.
OPEN_LINE = r'^(?:[^",][^,]*+,|,|"(?:[^"]++|"")*+"[^,]*+,)*+"(?:[^"]++|"")*+$'


@dataclass(frozen=True)
class Group:
    """Files that are read alike: the cells of their header, whether values hold line breaks, and what to read."""

    header: tuple[str | None, ...]
    multi_line: bool
    paths: list[str]


def scan_csv(
    spark: SparkSession,
    path: str,
    rows: int | None = None,
    multi_line: bool | None = None,
    infer: bool = True,
    schema: T.StructType | str | None = None,
    provenance: bool = False,
) -> DataFrame:
    """Read a CSV source, a file or a folder of files at any depth, which may have the same columns in different orders.

    Values are read as text, missing-value tokens become NULL, and types are inferred from all
    rows read.  With ``schema`` the inference pass is left out and columns are cast by name.
    Short rows are padded with NULL; a row with more cells than the header is an error, and so
    is a file with other columns.
    ``multi_line`` is looked up in each file when not given: only a line break inside quotes
    needs it, and it makes a file a single split. A scan bounded by ``rows`` reads the first files, in
    the order of their paths, until it has as many rows.
    """
    if rows:
        df = _first_rows(spark, path, rows, multi_line, provenance)
    else:
        df = _union([_part(spark, g, provenance, path) for g in read_groups(spark, literal_path(spark, path), multi_line)])
    names = df.columns[: len(df.columns) - 2 * provenance]
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        extra = [F.col(FILE), F.col(BLOCK)] if provenance else []
        return df.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in fields], *extra)
    return apply_types(df, infer_types(df.select(*map(col, names)), dates=False)) if infer else df


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first_rows(spark: SparkSession, path: str, rows: int, multi_line: bool | None, provenance: bool) -> DataFrame:
    """The first rows, from as few files as hold them: one file, then two more, four more and so on."""
    files, parts, step, left = leaf_files(spark, path), [], 1, rows
    while left > 0 and files:
        some, files, step = files[:step], files[step:], step * 2
        paths = [literal_path(spark, f) for f in some]
        known = multi_line
        if known is None and len(some) == 1:
            known = has_quoted_breaks(spark, paths[0], left)
        groups = read_groups(spark, paths, known, parts == [] and not files)
        _alike([*(p.columns[: len(p.columns) - 2 * provenance] for p in parts[:1]), *(header_names(g.header) for g in groups)], path)
        for group in groups:
            part = _part(spark, group, provenance, path).limit(left)
            parts.append(part)
            left -= part.count() if files or len(groups) > 1 else 0
    if not parts:
        raise ValueError(f"No columns to parse from file: {path}")
    return _union(parts).limit(rows)


def read_groups(spark: SparkSession, path: str | list[str], multi_line: bool | None = None, required: bool = True) -> list[Group]:
    """How to read the files behind a path, those with the first path first; no group means that all are empty.

    Files are listed only where they differ; a source whose files are alike stays one path.
    """
    lines = all_files(spark).text(path).where("value <> ''")
    some = lines.select("value").first()
    if some is None:
        if required:
            raise ValueError(f"No columns to parse from file: {path}")
        return []
    at = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    opens = F.lit(bool(multi_line)) if multi_line is not None else _opens(F.col("value"))
    # one column of ids: a second one, asked for on some rows only, would count only those
    marked = lines.select(file_column("file"), at.alias("at"), (F.col("value") == some["value"]).alias("alike"), opens.alias("open"))
    marked = marked.withColumn("known", F.when(F.col("alike"), F.col("at")))
    each = marked.groupBy("file").agg(F.min("at").alias("at"), F.min("known").alias("known"), F.count_if("open").alias("open"))
    # a row per file, as many as Spark's own listing holds
    found = each.select(as_written(F.col("file")).alias("file"), F.col("at").eqNullSafe(F.col("known")).alias("same"), (F.col("open") > 0).alias("open")).collect()
    first = {r["file"]: some["value"] for r in found if r["same"]} | _first_lines(spark, [r["file"] for r in found if not r["same"]])
    open_files = {r["file"] for r in found if r["open"]}
    by_line: dict[tuple, list[str]] = {}
    for file in sorted(first):
        # a header that goes on after its line is told apart by file
        own = file if file in open_files and first[file].count('"') % 2 else None
        by_line.setdefault((first[file], file in open_files, own), []).append(file)
    groups: dict[tuple, list[str]] = {}
    for (_, is_open, _), files in by_line.items():
        groups.setdefault((_header(spark, files[0], first[files[0]], is_open), is_open), []).extend(files)
    listed = sorted(groups.items(), key=lambda g: min(g[1]))
    _alike([header_names(cells) for (cells, _), _ in listed], path)
    if len(listed) == 1:
        return [Group(*listed[0][0], [path] if isinstance(path, str) else path)]
    return [Group(cells, is_open, [literal_path(spark, f) for f in files]) for (cells, is_open), files in listed]


def _first_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First lines of the files that do not start like the others."""
    if not files:
        return {}
    lines = all_files(spark).text([literal_path(spark, f) for f in files]).where("value <> ''")
    start = lines.where("_metadata.file_block_start = 0").select(file_column("file"), "value", F.monotonically_increasing_id().alias("at"))
    found = start.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    return {r["file"]: r["line"] for r in found.select(as_written(F.col("file")).alias("file"), "line").collect()}


def _header(spark: SparkSession, file: str, line: str, multi_line: bool) -> tuple[str | None, ...]:
    """The cells of the first line; only one with quotes is left to the reader of the values."""
    if '"' not in line:
        return tuple(cell or None for cell in line.split(","))
    reader = _options(spark, multi_line).option("header", False)
    return tuple(reader.csv(literal_path(spark, file)).head(1)[0])


def _alike(names: list[list[str]], path) -> None:
    """All files have the same columns, in whatever order."""
    for other in names[1:]:
        if sorted(other) != sorted(names[0]):
            raise ValueError(f"Part files with different columns in {path}: {', '.join(names[0])} and {', '.join(other)}")


def _options(spark: SparkSession, multi_line: bool):
    return all_files(spark).option("escape", '"').option("enforceSchema", True).option("multiLine", multi_line)


def _part(spark: SparkSession, group: Group, provenance: bool, path: str) -> DataFrame:
    """The rows of files that are read alike, as text."""
    names = header_names(group.header)
    positions = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    with_bad = positions.add(T.StructField(BAD_ROW, T.StringType()))
    reader = _options(spark, group.multi_line).option("header", True).option("columnNameOfCorruptRecord", BAD_ROW)
    raw = reader.schema(with_bad).csv(group.paths)
    cells = [F.col(f"_{i}") for i in range(len(names))]
    cells[0] = F.when(_too_many_cells(len(names)), F.raise_error(_message(path, len(names)))).otherwise(cells[0])
    values = [na_to_null(cell).alias(name) for cell, name in zip(cells, names)]
    return raw.select(*values, *(provenance_columns() if provenance else []))


def _too_many_cells(count: int) -> Column:
    """Spark marks rows of another length; short ones are padded, but a longer one would lose cells."""
    schema = ", ".join(f"c{i} string" for i in range(count + 1))
    longer = F.from_csv(F.col(BAD_ROW), schema, {"escape": '"'}).getField(f"c{count}").isNotNull()
    return F.col(BAD_ROW).isNotNull() & longer


def _message(path: str, count: int) -> Column:
    return F.concat(F.lit(f"Error tokenizing data: expected {count} fields in {path}, saw more: "), F.col(BAD_ROW))


def has_quoted_breaks(spark: SparkSession, path: str, rows: int | None = None) -> bool:
    """True when a quoted value goes on after its line; with ``rows``, within as many lines and the header."""
    text = all_files(spark).text(path)
    text = text.limit(rows + 1) if rows else text
    return not text.where(_opens(F.col("value"))).isEmpty()


def _opens(line: Column) -> Column:
    """A line that, read from its start, ends inside quotes; without one in a file, every record is a line."""
    return F.contains(line, F.lit('"')) & line.rlike(OPEN_LINE)


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Column names by position: blanks are numbered, repeats get ``.1``, ``.2``."""
    names: list[str] = []
    for position, cell in enumerate(cells):
        base = cell if cell else f"Unnamed: {position}"
        name, repeat = base, 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return distinct_by_case(names)
