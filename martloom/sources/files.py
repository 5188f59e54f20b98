"""Finding source files and choosing the reader by suffix."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

from martloom.operators.typing import infer_types
from martloom.session import hadoop_path, list_folder, path_exists

SUFFIXES = (".csv", ".json")

# Provenance columns a scan can carry along for raw landing.
FILE, BLOCK = "__file", "__block"


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def list_sources(spark: SparkSession, folder: str) -> list[str]:
    """Source files of a folder by suffix, sorted by name.

    A folder named like a source (``orders.csv/part-...``) is one source in many part files.
    """
    entries = list_folder(spark, folder)
    return [f"{folder.rstrip('/')}/{name}" for name, _ in entries if suffix(name) in SUFFIXES]


def all_files(spark: SparkSession) -> DataFrameReader:
    """A reader of files at any depth below a path; folders named ``key=value`` are folders like others."""
    return spark.read.option("recursiveFileLookup", True)


def leaf_files(spark: SparkSession, path: str) -> list[str]:
    """The files behind a source path, as Spark lists them, in the order of their paths."""
    return sorted(unquote(f) for f in all_files(spark).text(literal_path(spark, path)).inputFiles())


def literal_path(spark: SparkSession, path: str) -> str:
    """A path for Spark's readers, which take patterns: one that exists as it is written stands for itself."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path) if re.search(r"[\\{}\[\]*?]", path) and path_exists(spark, path) else path


def file_column(name: str) -> Column:
    """The path of the file that a row came from, as Spark encodes it; ``as_written`` decodes it, once a file and not once a row."""
    return F.col("_metadata.file_path").alias(name)


def as_written(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def scan(
    spark: SparkSession,
    path: str,
    rows: int | None = None,
    provenance: bool = False,
    infer: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read one source, a file or a folder of part files, as a flat frame.

    ``rows`` bounds the scan (0 or None reads everything); ``provenance`` appends the file, as
    ``file_column`` gives it, and the start of the file block each row came from.  ``multi_line`` tells whether CSV values
    hold line breaks, which saves a pass that looks for them.
    """
    from martloom.sources.delimited import scan_csv
    from martloom.sources.json import scan_json

    kind = suffix(path)
    if kind == ".csv":
        return scan_csv(spark, path, rows=rows, multi_line=multi_line, provenance=provenance, infer=infer)
    if kind == ".json":
        return scan_json(spark, path, rows=rows, provenance=provenance, infer=infer)
    raise ValueError(f"Unsupported file type: {kind}")


def source_types(texts: DataFrame, path: str) -> dict[str, str]:
    """Types of text columns read without inference, by the rules of the source's format."""
    from martloom.sources.json import is_lines, number_types

    if suffix(path) == ".csv":
        return infer_types(texts, dates=False)
    return number_types(texts) if is_lines(texts.sparkSession, path) else {}


def provenance_columns() -> list[Column]:
    """File, as Spark encodes its path, and start of the block."""
    return [file_column(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]


def path_below(spark: SparkSession, path: str, file: Column) -> Column:
    """The path of a file, given as Spark encodes it, below the source; its name when the source is the file."""
    _, jpath = hadoop_path(spark, path)
    uri = jpath.toUri()
    root = (uri.getAuthority() or "").lstrip("/") + "/" + uri.getRawPath().strip("/") + "/"
    whole = F.regexp_replace(file, "^[A-Za-z0-9+.-]+:/*", "")
    root = root.lstrip("/")
    below = F.when(F.startswith(whole, F.lit(root)), F.substring(whole, len(root) + 1, 1 << 20))
    return F.coalesce(as_written(below), F.substring_index(file, "/", -1))


def distinct_by_case(names: list[str]) -> list[str]:
    """Names that Spark tells apart: one that equals an earlier one but for its case gets blanks behind it.

    Identifiers made from the names do not show the blanks.
    """
    taken: set[str] = set()
    out = []
    for name in names:
        while name.lower() in taken:
            name += " "
        taken.add(name.lower())
        out.append(name)
    return out
