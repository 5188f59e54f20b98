"""Keys, relationships and schemas proposed from profiles, names and the data itself.

Profiles are one row per column, so the rules over them are small; what they nominate is then
measured over the whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from martloom.functions.names import identifier, identifier_column, singular, table_name, table_name_column
from martloom.operators.checks import inclusion
from martloom.operators.frames import union_all
from martloom.spec import Relationship, TableSpec, table

# Where a relationship comes from.
DECLARED, INFERRED = "declared_fk", "inferred_name_match"

# Declared type per logical type; every other type is TEXT.
SQL_TYPES = {"integer": "INTEGER", "float": "REAL", "boolean": "INTEGER"}


def propose_pks(catalog: DataFrame) -> DataFrame:
    """The first ``...id`` column without nulls of every source, with its measured uniqueness."""
    name = identifier_column(F.col("column_name"))
    candidates = catalog.where(name.endswith("id") & (F.col("null_pct") == 0) & (F.col("distinct_count") > 0))
    first = F.row_number().over(W.partitionBy("source_file").orderBy("ordinal"))
    return candidates.withColumn("place", first).where(F.col("place") == 1).select(
        "source_file",
        table_name_column(F.col("source_file")).alias("table_name"),
        name.alias("column_name"),
        F.round(F.col("distinct_count") / F.col("row_count"), 4).alias("unique_ratio"),
    )


def propose_schema(catalog: DataFrame) -> DataFrame:
    """One row per proposed target column: type, NOT NULL, primary key, foreign key.

    A column named like the key of another table references it; of several the first by file.
    """
    keys = propose_pks(catalog)
    own = keys.select(F.col("table_name").alias("own_table"), F.col("column_name").alias("own_key"))
    other = keys.select(
        F.col("source_file").alias("ref_file"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column")
    )
    sql_type = F.lit("TEXT")
    for kind, declared in SQL_TYPES.items():
        sql_type = F.when(F.col("inferred_type") == kind, declared).otherwise(sql_type)
    columns = catalog.select(
        table_name_column(F.col("source_file")).alias("table_name"),
        "ordinal",
        identifier_column(F.col("column_name")).alias("column_name"),
        sql_type.alias("sql_type"),
        "null_pct",
    )
    keyed = columns.join(
        own, (F.col("table_name") == F.col("own_table")) & (F.col("column_name") == F.col("own_key")), "left"
    )
    linked = keyed.join(
        other, (F.col("column_name") == F.col("ref_column")) & (F.col("table_name") != F.col("ref_table")), "left"
    )
    primary = F.col("own_key").isNotNull()
    first = F.row_number().over(W.partitionBy("table_name", "ordinal").orderBy("ref_file"))
    return linked.withColumn("place", first).where(F.col("place") == 1).select(
        "table_name",
        "ordinal",
        "column_name",
        "sql_type",
        (~primary & (F.col("null_pct") == 0)).alias("not_null"),
        primary.alias("primary_key"),
        "ref_table",
        "ref_column",
    )


def schema_specs(schema: DataFrame) -> list[TableSpec]:
    """Specs of a proposed schema; the frame has one row per column."""
    rows = schema.orderBy("table_name", "ordinal").collect()
    specs = []
    for name in dict.fromkeys(r["table_name"] for r in rows):
        own = [r for r in rows if r["table_name"] == name]
        specs.append(
            table(
                name,
                [(r["column_name"], r["sql_type"]) for r in own],
                primary_key=[r["column_name"] for r in own if r["primary_key"]],
                not_null=[r["column_name"] for r in own if r["not_null"]],
                foreign_keys={r["column_name"]: (r["ref_table"], r["ref_column"]) for r in own if r["ref_table"]},
            )
        )
    return specs


def extend_schema(existing: Sequence[TableSpec], proposed: Sequence[TableSpec]) -> list[TableSpec]:
    """Existing tables, with new columns added as nullable ones, followed by the new tables."""
    by_name = {spec.name.lower(): spec for spec in proposed}
    result = []
    for spec in existing:
        new = by_name.pop(spec.name.lower(), None)
        known = {c.lower() for c in spec.column_names}
        extra = [c for c in new.columns if c.name.lower() not in known] if new else []
        added = tuple(type(c)(c.name, c.sql_type) for c in extra)
        result.append(TableSpec(spec.name, spec.columns + added, spec.foreign_keys))
    return result + list(by_name.values())


def propose_fks(catalog: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Proposed foreign keys with the share of child rows that resolve.

    ``frames`` holds the sources by file name, with their own column names.
    """
    rows = catalog.select("source_file", "ordinal", "column_name").orderBy("source_file", "ordinal").collect()
    keys = {r["source_file"]: r["column_name"] for r in propose_pks(catalog).orderBy("source_file").collect()}
    parts = []
    for row in rows:
        child, name = row["source_file"], identifier(row["column_name"])
        parent = next((f for f, key in keys.items() if f != child and key == name), None)
        if parent is None:
            continue
        ref = next(c for c in frames[parent].columns if identifier(c) == name)
        measured = inclusion(frames[child], [row["column_name"]], frames[parent], [ref])
        parts.append(
            measured.select(
                F.lit(table_name(child)).alias("child_table"),
                F.lit(name).alias("child_column"),
                F.lit(table_name(parent)).alias("parent_table"),
                F.lit(name).alias("parent_column"),
                "child_rows",
                "matched_rows",
                "inclusion",
            )
        )
    schema = (
        "child_table string, child_column string, parent_table string, parent_column string, "
        "child_rows bigint, matched_rows bigint, inclusion double"
    )
    return union_all(parts, catalog.sparkSession, schema)


def infer_relationships(specs: Sequence[TableSpec]) -> list[Relationship]:
    """Declared foreign keys, then ``..._id`` columns whose name points at another table.

    A name points at a table when it equals its key, or when what is left without ``_id`` is
    the table's name with or without its plural s.  The first such table counts.
    """
    found: dict[tuple, Relationship] = {}

    def add(relationship: Relationship) -> None:
        r = relationship
        found.setdefault((r.child_table, r.child_columns, r.parent_table, r.parent_columns), r)

    for spec in specs:
        for fk in spec.foreign_keys:
            add(Relationship(spec.name, fk.columns, fk.ref_table, fk.ref_columns, DECLARED))
    parents = [(spec.name, spec.primary_key[0]) for spec in specs if spec.primary_key]
    for spec in specs:
        for column in spec.columns:
            if column.primary_key or not column.name.endswith("_id"):
                continue
            base = column.name.removesuffix("_id")
            match = next(
                (
                    (parent, key)
                    for parent, key in parents
                    if parent != spec.name and (column.name == key or base in (parent, singular(parent)))
                ),
                None,
            )
            if match:
                add(Relationship(spec.name, (column.name,), match[0], (match[1],), INFERRED))
    return list(found.values())


def relationship_frame(relationships: Sequence[Relationship], frames: dict[str, DataFrame]) -> DataFrame:
    """The edges of the model, each with its measured inclusion."""
    schema = "child_table string, child_column string, parent_table string, parent_column string, source string, inclusion double"
    return union_all(
        [
            inclusion(frames[r.child_table], r.child_columns, frames[r.parent_table], r.parent_columns).select(
                F.lit(r.child_table).alias("child_table"),
                F.lit(r.child_column).alias("child_column"),
                F.lit(r.parent_table).alias("parent_table"),
                F.lit(r.parent_column).alias("parent_column"),
                F.lit(r.source).alias("source"),
                "inclusion",
            )
            for r in relationships
        ],
        SparkSession.active(),
        schema,
    )


def target_columns(specs: Sequence[TableSpec], spark: SparkSession) -> DataFrame:
    """The specs as rows, one per column."""
    rows = [
        (s.name, i, c.name, c.sql_type, c.nullable, c.primary_key) for s in specs for i, c in enumerate(s.columns)
    ]
    schema = "table string, ordinal int, column string, sql_type string, nullable boolean, primary_key boolean"
    return spark.createDataFrame(rows, schema)


