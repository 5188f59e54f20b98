"""Counts, summaries and first rows of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.functions import col
from martloom.operators.frames import union_all

# Layer names in reports, and prefixes of generated models.
SOURCE_LAYER, STAGING_LAYER, MART_LAYER = "loaded/source", "dbt staging", "dbt mart"
GENERATED_NAMES = r"(?i)^(sqlite_|stg_|mart_)"
INSPECT_ROWS = 100


def layer_of(name: str) -> str:
    if name.startswith("stg_"):
        return STAGING_LAYER
    return MART_LAYER if name.startswith("mart_") else SOURCE_LAYER


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, labelled with the layer the name stands for."""
    return union_all(
        [
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(layer_of(name)).alias("layer"), F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in frames.items()
        ],
        SparkSession.active(),
        "layer string, table_name string, row_count bigint",
    )


def table_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Name, rows and columns of the user tables, without generated models, by name."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.array(*map(F.lit, df.columns)).alias("columns")
        )
        for name, df in frames.items()
    ]
    every = union_all(parts, SparkSession.active(), "table string, rows bigint, columns array<string>")
    return every.where(~F.col("table").rlike(GENERATED_NAMES)).orderBy("table")


def inspect(df: DataFrame, order_by: Sequence[str], rows: int = INSPECT_ROWS) -> DataFrame:
    """The first rows by key: a top-k, not a full sort."""
    return df.orderBy(*map(col, order_by)).limit(rows)
