"""Staging, mart and enriched models as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from martloom.functions import col
from martloom.functions.casts import LENIENT, staged
from martloom.functions.names import identifier
from martloom.operators.joins import DEAL, deal, hot_keys_for, join_parent
from martloom.sources.store import TableStore
from martloom.spec import Relationship, TableSpec


def staging_name(table: str) -> str:
    return "stg_" + identifier(table, "model")


def mart_name(table: str) -> str:
    return "mart_" + identifier(table, "model")


def enriched_name(table: str) -> str:
    return mart_name(table) + "_enriched"


def build_staging(df: DataFrame, spec: TableSpec, mode: str = LENIENT) -> DataFrame:
    """One projection: every column cast to its class, text trimmed and blanks made NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        [staged(col(c.name), types[c.name], c.type_class, mode).alias(c.name) for c in spec.columns]
    )


def register_staging(df: DataFrame, table: str) -> DataFrame:
    """Staging models are views."""
    df.createOrReplaceTempView(staging_name(table))
    return df


def build_mart(staging: DataFrame) -> DataFrame:
    return staging.select("*")


def write_mart(spark: SparkSession, df: DataFrame, name: str, root: str, seen: Observation | None = None) -> DataFrame:
    """Marts are tables; a new version takes the place of the last one once it is written whole. ``seen`` observes its ``rows``."""
    return TableStore(spark, root).publish(name, df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("rows")))


def read_mart(spark: SparkSession, name: str, root: str) -> DataFrame:
    return TableStore(spark, root).read(name)


def build_enriched(
    child: TableSpec,
    relationships: Sequence[Relationship],
    specs: dict[str, TableSpec],
    frames: dict[str, DataFrame],
    small_parent: int | None = None,
) -> DataFrame:
    """Child rows with the columns of every parent, by one-hop left joins.

    Parent columns are prefixed with the parent's name, its join columns left out.  Keys that
    hold much of the child are spread over tasks before joins with large parents; small
    parents are left to Spark's own broadcast.
    """
    links = [r for r in relationships if r.child_table == child.name]
    parents = [(frames[r.parent_table], r.child_columns) for r in links]
    hot = hot_keys_for(frames[child.name], parents, small_parent)
    result = deal(frames[child.name]) if hot else frames[child.name]
    names = list(child.column_names)
    for i, link in enumerate(links, start=1):
        added = _parent_columns(link, specs[link.parent_table], names)
        parent = frames[link.parent_table].select(*map(col, [*link.parent_columns, *added]))
        alias = f"parent_{i}"
        joined = join_parent(
            result, parent, link.child_columns, link.parent_columns, "left", hot.get(tuple(link.child_columns)), alias
        )
        kept = names + ([DEAL] if hot else [])
        result = joined.select(
            *[col(c, "child").alias(c) for c in kept], *[col(c, alias).alias(out) for c, out in added.items()]
        )
        names += added.values()
    return result.select(*map(col, names))


def _parent_columns(link: Relationship, parent: TableSpec, taken: Sequence[str]) -> dict[str, str]:
    """Parent column to output name; a second link to a parent adds the child column to the name."""
    prefix = identifier(link.parent_table, "model")
    wanted = [c for c in parent.column_names if c not in link.parent_columns]
    names = {c: f"{prefix}_{c}" for c in wanted}
    if set(names.values()) & set(taken):
        names = {c: f"{prefix}_{'_'.join(link.child_columns)}_{c}" for c in wanted}
    return names


def build_layers(
    specs: Sequence[TableSpec], frames: dict[str, DataFrame], relationships: Sequence[Relationship], mode: str = LENIENT
) -> dict[str, DataFrame]:
    """Every staging, mart and enriched model, by name."""
    by_name = {spec.name: spec for spec in specs}
    staging = {spec.name: build_staging(frames[spec.name], spec, mode) for spec in specs}
    models = {staging_name(name): df for name, df in staging.items()}
    models |= {mart_name(name): build_mart(df) for name, df in staging.items()}
    for child in dict.fromkeys(r.child_table for r in relationships):
        models[enriched_name(child)] = build_enriched(by_name[child], relationships, by_name, staging)
    return models
