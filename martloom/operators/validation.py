"""Validation of loaded tables, and the contract between a spec and the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.functions import col
from martloom.functions.casts import fit
from martloom.operators.checks import has_keys, relationship_failures, unique_failures
from martloom.operators.frames import one_row, union_all
from martloom.spec import ForeignKey, TableSpec

PART = "table string, row_count bigint, fk_violations bigint, null_violations bigint, unreadable bigint"


def row_metrics(spec: TableSpec) -> dict[str, Column]:
    """What validation wants to know of the rows alone; it can be observed while they are written."""
    nulls = [F.count_if(col(name).isNull()) for name in spec.required]
    keyed = {f"keyed{i}": F.count_if(has_keys(fk.columns)) for i, fk in enumerate(spec.foreign_keys)}
    return {"rows": F.count(F.lit(1)), "nulls": sum(nulls, F.lit(0)), **keyed}


def validate_tables(
    specs: Sequence[TableSpec], frames: dict[str, DataFrame], spark: SparkSession, observed: dict[str, dict] | None = None
) -> DataFrame:
    """Row count, foreign key and NOT NULL violations and a status per table.

    A table without a frame, or with a key to a parent column that is not unique, is an error.
    Every count is a partial aggregate; the parts are added up per table at the end. ``observed`` has the
    metrics of tables whose rows were counted as they were written.
    """
    observed = observed or {}
    by_name = {spec.name: spec for spec in specs}
    parts = []
    for spec in specs:
        df = frames.get(spec.name)
        if df is None:
            parts.append(_part(one_row(spark), spec.name, unreadable=F.lit(1)))
            continue
        metrics, known = row_metrics(spec), observed.get(spec.name)
        if known:
            parts.append(_part(one_row(spark), spec.name, rows=F.lit(known["rows"]), nulls=F.lit(known["nulls"])))
        else:
            counts = df.agg(metrics["rows"].alias("rows"), metrics["nulls"].alias("nulls"))
            parts.append(_part(counts, spec.name, rows=F.col("rows"), nulls=F.col("nulls")))
        for i, fk in enumerate(spec.foreign_keys):
            if known and (fk.ref_table not in frames or not known[f"keyed{i}"]):
                parts.append(_part(one_row(spark), spec.name, fks=F.lit(known[f"keyed{i}"])))
                if fk.ref_table not in frames:
                    continue
            loaded_key = _is_key(by_name.get(fk.ref_table), fk)
            if not known or known[f"keyed{i}"]:
                parts.append(_part(fk_violations(df, fk, frames, loaded_key), spec.name, fks=F.col("failures")))
            parent = frames.get(fk.ref_table)
            if parent is not None and not loaded_key:
                repeated = unique_failures(parent, fk.ref_columns)
                parts.append(_part(repeated, spec.name, unreadable=F.col("failures")))
    total = union_all(parts, spark, PART).groupBy("table").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("fk_violations").alias("fk_violations"),
        F.sum("null_violations").alias("null_violations"),
        F.sum("unreadable").alias("unreadable"),
    )
    clean = (F.col("fk_violations") == 0) & (F.col("null_violations") == 0)
    status = F.when(F.col("unreadable") > 0, "error").when(clean, "ok").otherwise("warning")
    return total.select("table", "row_count", "fk_violations", "null_violations", status.alias("status"))


def fk_violations(
    child: DataFrame, fk: ForeignKey, frames: dict[str, DataFrame], unique_parent: bool = False
) -> DataFrame:
    """Child rows with a complete key and no parent; all of them when the parent is missing."""
    parent = frames.get(fk.ref_table)
    if parent is None:
        return child.agg(F.count_if(has_keys(fk.columns)).alias("failures"))
    return relationship_failures(child, fk.columns, parent, fk.ref_columns, unique_parent)


def fk_report(specs: Sequence[TableSpec], frames: dict[str, DataFrame]) -> DataFrame:
    """Violations per foreign key constraint."""
    parts = [
        fk_violations(frames[spec.name], fk, frames).select(
            F.lit(spec.name).alias("table"),
            F.lit(", ".join(fk.columns)).alias("column"),
            F.lit(fk.ref_table).alias("parent"),
            F.col("failures").alias("fk_violations"),
        )
        for spec in specs
        for fk in spec.foreign_keys
    ]
    return union_all(parts, SparkSession.active(), "table string, column string, parent string, fk_violations bigint")


def contract_check(specs: Sequence[TableSpec], frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Differences between specs and data: (table, column, finding, count), one row each.

    Names are compared without case.  Type mismatches are counted in one scan per table, and
    each referenced parent key is checked for repeats.
    """
    parts = []
    lowered = {spec.name.lower(): spec for spec in specs}
    for spec in specs:
        df = frames.get(spec.name)
        if df is None:
            missing = F.array(F.struct(F.lit(spec.name).alias("column"), F.lit("missing_table").alias("finding"), F.lit(1).alias("count")))
            parts.append(_finding(one_row(spark).select(F.inline(missing)), spec.name))
            continue
        present = {f.name.lower(): f for f in df.schema.fields}
        fixed = [(c.name, "missing_column") for c in spec.columns if c.name.lower() not in present]
        known = [(c, present[c.name.lower()]) for c in spec.columns if c.name.lower() in present]
        mismatches = [
            F.struct(
                F.lit(c.name).alias("column"),
                F.lit("type_mismatch").alias("finding"),
                F.count_if(_loses(col(f.name), f, c.type_class)).alias("count"),
            )
            for c, f in known
        ]
        if mismatches:
            counted = df.agg(F.array(*mismatches).alias("found")).select(F.inline("found"))
            parts.append(_finding(counted.where(F.col("count") > 0), spec.name))
        for fk in spec.foreign_keys:
            names = {c.lower() for c in spec.column_names}
            fixed += [(c, "missing_fk_column") for c in fk.columns if c.lower() not in names]
            parent = lowered.get(fk.ref_table.lower())
            if parent is None:
                fixed.append((fk.ref_table, "missing_parent_table"))
                continue
            parent_names = {c.lower() for c in parent.column_names}
            absent = [c for c in fk.ref_columns if c.lower() not in parent_names]
            fixed += [(f"{parent.name}.{c}", "missing_parent_column") for c in absent]
            frame = frames.get(parent.name)
            if not absent and frame is not None and {c.lower() for c in fk.ref_columns} <= _lower(frame.columns):
                repeated = unique_failures(frame, fk.ref_columns).where(F.col("failures") > 0)
                where = f"{parent.name}.{', '.join(fk.ref_columns)}"
                parts.append(
                    repeated.select(
                        F.lit(spec.name).alias("table"),
                        F.lit(where).alias("column"),
                        F.lit("parent_key_not_unique").alias("finding"),
                        F.col("failures").alias("count"),
                    )
                )
        if fixed:
            rows = [F.struct(F.lit(c).alias("column"), F.lit(f).alias("finding"), F.lit(1).alias("count")) for c, f in fixed]
            parts.append(_finding(one_row(spark).select(F.inline(F.array(*rows))), spec.name))
    return union_all(parts, spark, "table string, column string, finding string, count bigint")


def _loses(value: Column, f, type_class: str) -> Column:
    return value.isNotNull() & fit(value, f.dataType, type_class).isNull()


def _finding(df: DataFrame, table: str) -> DataFrame:
    return df.select(F.lit(table).alias("table"), "column", "finding", F.col("count").cast("bigint").alias("count"))


def _is_key(parent: TableSpec | None, fk: ForeignKey) -> bool:
    return parent is not None and sorted(fk.ref_columns) == sorted(parent.primary_key)


def _lower(names) -> set[str]:
    return {name.lower() for name in names}


def _part(df: DataFrame, table: str, rows=None, fks=None, nulls=None, unreadable=None) -> DataFrame:
    def count(value: Column | None, name: str) -> Column:
        return (F.lit(0) if value is None else value).cast("bigint").alias(name)

    return df.select(
        F.lit(table).alias("table"),
        count(rows, "row_count"),
        count(fks, "fk_violations"),
        count(nulls, "null_violations"),
        count(unreadable, "unreadable"),
    )
