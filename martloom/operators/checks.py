"""Model tests and referential checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.functions import col
from martloom.operators.frames import union_all
from martloom.operators.joins import deal, hot_keys_for, join_parent
from martloom.session import run_together
from martloom.spec import Relationship, TableSpec

NOT_NULL, UNIQUE, RELATIONSHIPS = "not_null", "unique", "relationships"


def has_keys(columns: Sequence[str]) -> Column:
    """True when no key part is NULL."""
    present = col(columns[0]).isNotNull()
    for name in columns[1:]:
        present &= col(name).isNotNull()
    return present


def key_counts(df: DataFrame, columns: Sequence[str], count: str = "rows") -> DataFrame:
    """Rows per complete key.  Combined on the map side, so a hot key leaves each task as one row."""
    return df.where(has_keys(columns)).groupBy(*map(col, columns)).agg(F.count("*").alias(count))


def null_failures(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(col(column).isNull()).alias("failures"))


def unique_failures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of keys held by more than one row; rows with a NULL key part are left out."""
    return key_counts(df, columns).agg(F.count_if(F.col("rows") > 1).alias("failures"))


def orphan_keys(
    child: DataFrame,
    child_keys: Sequence[str],
    parent: DataFrame,
    parent_keys: Sequence[str],
    unique_parent: bool = False,
) -> DataFrame:
    """Child keys without a parent, with the number of child rows of each.

    Both sides are reduced to one row per key before they meet, whatever the skew; a parent
    whose key is known to be unique needs no reduction.
    """
    keys = key_counts(child, child_keys)
    known = _keys_only(parent, parent_keys)
    known = known if unique_parent else known.distinct()
    return join_parent(keys, known, child_keys, parent_keys, "left_anti")


def relationship_failures(
    child: DataFrame,
    child_keys: Sequence[str],
    parent: DataFrame,
    parent_keys: Sequence[str],
    unique_parent: bool = False,
) -> DataFrame:
    """Number of child rows with a complete key and no parent."""
    orphans = orphan_keys(child, child_keys, parent, parent_keys, unique_parent)
    return orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("failures"))


def orphan_rows(
    child: DataFrame,
    child_keys: Sequence[str],
    parent: DataFrame,
    parent_keys: Sequence[str],
    small_parent: int | None = None,
) -> DataFrame:
    """The child rows themselves; hot keys are spread before an unbroadcast join."""
    keyed = child.where(has_keys(child_keys))
    hot = hot_keys_for(keyed, [(parent, child_keys)], small_parent).get(tuple(child_keys))
    dealt = keyed if hot is None else deal(keyed)
    known = _keys_only(parent, parent_keys).distinct()
    orphans = join_parent(dealt, known, child_keys, parent_keys, "left_anti", hot)
    return orphans.select(*map(col, child.columns))


def inclusion(
    child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> DataFrame:
    """Share of keyed child rows, and of distinct child keys, that have a parent."""
    keys = key_counts(child, child_keys)
    known = _keys_only(parent, parent_keys).distinct().withColumn("found", F.lit(True))
    joined = join_parent(keys, known, child_keys, parent_keys, "left")
    total, found = F.sum(F.col("rows")), F.sum(F.when(F.col("found"), F.col("rows")))
    return joined.agg(
        F.coalesce(total, F.lit(0)).alias("child_rows"),
        F.coalesce(found, F.lit(0)).alias("matched_rows"),
        F.count("*").alias("child_keys"),
        F.count("found").alias("matched_keys"),
        F.round(F.coalesce(found / total, F.lit(0.0)), 4).alias("inclusion"),
    )


@dataclass(frozen=True)
class ModelTest:
    kind: str
    table: str
    columns: tuple[str, ...]
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()

    def failures(self, frames: dict[str, DataFrame]) -> DataFrame:
        df = frames[self.table]
        if self.kind == NOT_NULL:
            return null_failures(df, self.columns[0])
        if self.kind == UNIQUE:
            return unique_failures(df, self.columns)
        return relationship_failures(df, self.columns, frames[self.parent], self.parent_columns)


def derive_tests(specs: Sequence[TableSpec], relationships: Sequence[Relationship]) -> list[ModelTest]:
    """Primary keys are not null and unique, NOT NULL columns not null, relationships resolve.

    A composite key is unique as a whole.
    """
    tests = []
    for spec in specs:
        key = spec.primary_key
        tests += [ModelTest(NOT_NULL, spec.name, (name,)) for name in [*key, *spec.required]]
        if key:
            tests.append(ModelTest(UNIQUE, spec.name, tuple(key)))
        tests += [
            ModelTest(RELATIONSHIPS, spec.name, r.child_columns, r.parent_table, r.parent_columns)
            for r in relationships
            if r.child_table == spec.name
        ]
    return tests


def run_tests(tests: Sequence[ModelTest], frames: dict[str, DataFrame], prefix: str = "stg_") -> DataFrame:
    """One row per test.  All not-null tests of a table share one scan of the tested columns."""
    parts = []
    for table in dict.fromkeys(t.table for t in tests if t.kind == NOT_NULL):
        columns = [t.columns[0] for t in tests if t.kind == NOT_NULL and t.table == table]
        counts = [F.count_if(col(c).isNull()).alias(f"f{i}") for i, c in enumerate(columns)]
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("failures")) for i, c in enumerate(columns)]
        counted = frames[table].agg(*counts).select(F.inline(F.array(*rows)))
        parts.append(_result(counted, NOT_NULL, prefix + table, F.col("column"), None))

    def part(t: ModelTest) -> DataFrame:
        parent = f"{prefix}{t.parent}.{', '.join(t.parent_columns)}" if t.parent else None
        return _result(t.failures(frames), t.kind, prefix + t.table, F.lit(", ".join(t.columns)), parent)

    # plans are put together at the same time; they run as one
    every = parts + run_together([partial(part, t) for t in tests if t.kind != NOT_NULL])
    schema = "test string, model string, column string, parent string, failures bigint, status string"
    return union_all(every, SparkSession.active(), schema)


def _result(failures: DataFrame, kind: str, model: str, column: Column, parent: str | None) -> DataFrame:
    return failures.select(
        F.lit(kind).alias("test"),
        F.lit(model).alias("model"),
        column.alias("column"),
        F.lit(parent).cast("string").alias("parent"),
        F.col("failures").cast("bigint").alias("failures"),
        F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"),
    )


def _keys_only(parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parent.where(has_keys(keys)).select(*map(col, keys))
