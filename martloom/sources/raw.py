"""Raw landing: one table per source with provenance and row numbers in file order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from martloom.functions import col
from martloom.functions.display import json_text
from martloom.functions.names import raw_table_name, unique_identifiers
from martloom.operators.frames import union_all
from martloom.operators.numbering import number_rows, stage_for_numbering
from martloom.operators.typing import apply_types
from martloom.session import drop_scratch, run_together, scratch_path
from martloom.sources.files import BLOCK, FILE, path_below, scan, source_types

SOURCE_FILE, LOADED_AT, ROW_NUMBER = "_source_file", "_loaded_at", "_raw_row_number"
RAW_COLUMNS = (SOURCE_FILE, LOADED_AT, ROW_NUMBER)


@dataclass(frozen=True)
class RawTable:
    """A landed source: its file name, table name, folder and rows."""

    source: str
    table: str
    path: str
    frame: DataFrame

    def read(self) -> DataFrame:
        return self.frame

    def data(self) -> DataFrame:
        """The rows without provenance."""
        return self.frame.drop(*RAW_COLUMNS)


def load_time() -> str:
    """One UTC timestamp for a whole load."""
    return datetime.now(timezone.utc).isoformat()


def raw_frame(
    spark: SparkSession,
    path: str,
    loaded_at: str | None = None,
    scratch: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """The rows of one source as they land: provenance, row number, normalised names.

    The source is parsed once, into a staged table; types are then inferred from its columns
    and row numbers counted from its file blocks.
    """
    scanned = scan(spark, path, provenance=True, infer=False, multi_line=multi_line)
    data = [f for f in scanned.schema.fields if f.name not in (FILE, BLOCK)]
    names = unique_identifiers(f.name for f in data)
    encoded = [encode_nested(f).alias(name) for f, name in zip(data, names)]
    staged = stage_for_numbering(scanned.select(*encoded, FILE, BLOCK), "raw", scratch)
    typed = source_types(staged.select(*[col(n) for n, f in zip(names, data) if _is_text(f)]), path)
    named = {SOURCE_FILE: path_below(spark, path, F.col(FILE))}
    numbered = apply_types(number_rows(staged, ROW_NUMBER, restart=[FILE], blocks=[BLOCK], of_run=named), typed)
    return numbered.select(
        SOURCE_FILE, F.lit(loaded_at or load_time()).alias(LOADED_AT), ROW_NUMBER, *map(col, names)
    )


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def encode_nested(f: T.StructField):
    """JSON text for a list, map or object; other values unchanged."""
    if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return json_text(col(f.name), f.dataType)
    return col(f.name)


def land_raw(
    spark: SparkSession, path: str, root: str, loaded_at: str | None = None, multi_line: bool | None = None
) -> RawTable:
    """Replace ``root/raw_<source>`` with the rows of one source."""
    table = raw_table_name(path)
    target = f"{root.rstrip('/')}/{table}"
    scratch = scratch_path(spark, "raw")
    frame = raw_frame(spark, path, loaded_at, scratch, multi_line)
    frame.write.mode("overwrite").parquet(target)
    drop_scratch(spark, scratch)
    return RawTable(path.rstrip("/").rsplit("/", 1)[-1], table, target, spark.read.schema(frame.schema).parquet(target))


def land_all(spark: SparkSession, paths: Sequence[str], root: str, loaded_at: str | None = None) -> list[RawTable]:
    """Land several sources with one load time, a few at the same time."""
    moment = loaded_at or load_time()
    return run_together([partial(land_raw, spark, path, root, moment) for path in paths])


def raw_counts(tables: list[RawTable]) -> DataFrame:
    """Rows landed per table and file."""
    counts = [
        t.read().groupBy(SOURCE_FILE).agg(F.count("*").alias("rows")).select(
            F.lit(t.table).alias("table"), F.col(SOURCE_FILE).alias("source_file"), "rows"
        )
        for t in tables
    ]
    return union_all(counts)
