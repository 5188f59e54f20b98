"""Loading files into target tables: typed rows, per-file acceptance, row quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.functions import col
from martloom.functions.casts import fit
from martloom.operators.checks import has_keys
from martloom.operators.conflicts import FILE, conflicting_files
from martloom.operators.joins import deal, hot_keys, join_parent
from martloom.session import stage
from martloom.spec import TableSpec

ROW = "__row"
TYPE_FINDING, NULL_FINDING = "__type", "__null"

REPORT = "table string, source_file string, rows bigint, replaced bigint, status string, reason string"

# Statuses and reasons of a load.
LOADED, SKIPPED, ERROR = "loaded", "skipped", "error"
NO_MAPPING = "No selected mappings for this file and table"
ALL_EMPTY = "All transformed rows were empty"


@dataclass(frozen=True)
class FileStatus:
    table: str
    source_file: str
    rows: int
    status: str
    reason: str
    replaced: int = 0


def union_files(parts: Sequence[DataFrame]) -> DataFrame:
    """Append files by column name; columns a file lacks are NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def fit_rows(df: DataFrame, spec: TableSpec, keep: Sequence[str] = (FILE, ROW)) -> DataFrame:
    """Rows as the target stores them, with the first type and NOT NULL finding of each row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    values, losses, nulls = [], [], []
    for c in spec.columns:
        if c.name not in types:
            value = F.lit(None).cast(c.spark_type)
        else:
            value = fit(col(c.name), types[c.name], c.type_class)
            losses.append(F.when(col(c.name).isNotNull() & value.isNull(), F.lit(c.name)))
        if c.name in spec.required:
            nulls.append(F.when(value.isNull(), F.lit(c.name)))
        values.append(value.alias(c.name))

    def first(findings: list[Column]) -> Column:
        return F.coalesce(*findings, F.lit(None).cast("string"))

    kept = [col(k) for k in keep if k in types]
    return df.select(*kept, *values, first(losses).alias(TYPE_FINDING), first(nulls).alias(NULL_FINDING))


def file_facts(fitted: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Rows and first findings of each file, in one aggregation."""
    return fitted.groupBy(FILE).agg(F.count("*").alias("rows"), F.min(TYPE_FINDING).alias("loss"), F.min(NULL_FINDING).alias("null"), *extra)


def judge_files(facts: DataFrame, spec: TableSpec, conflicts: DataFrame | None = None) -> DataFrame:
    """(file, rows, status, reason): each file is accepted or rejected as a whole.

    A file is rejected by any row that breaks its type, NOT NULL or, where ``conflicts`` names files, the
    uniqueness of the key within the file or against files accepted before it.
    """
    column = lambda kind, name: F.concat(F.lit(f"{kind}: {spec.name}."), name)
    reason = F.when(F.col("null").isNotNull(), column("NOT NULL constraint failed", "null"))
    reason = reason.when(F.col("loss").isNotNull(), column("datatype mismatch", "loss"))
    if conflicts is not None:
        broken = ", ".join(f"{spec.name}.{c}" for c in spec.primary_key)
        facts = facts.join(conflicts.withColumn("conflict", F.lit(True)), FILE, "left")
        reason = reason.when(F.col("conflict"), F.lit(f"UNIQUE constraint failed: {broken}"))
    judged = facts.withColumn("reason", F.coalesce(reason, F.lit("")))
    rejected = F.col("reason") != ""
    return judged.select(
        FILE,
        F.when(rejected, 0).otherwise(F.col("rows")).cast("bigint").alias("rows"),
        F.when(rejected, ERROR).otherwise(LOADED).alias("status"),
        "reason",
    )


def defective_files(facts: DataFrame) -> DataFrame:
    """Files with a row that breaks its type or NOT NULL."""
    return facts.where(F.col("null").isNotNull() | F.col("loss").isNotNull()).select(FILE)


def file_statuses(fitted: DataFrame, spec: TableSpec, replace: bool = False) -> list[FileStatus]:
    """The judgement of every file as a list, in the order of their names; with ``replace`` keys may repeat."""
    facts = stage(file_facts(fitted), "facts")
    conflicts = conflicting_files(fitted, spec.primary_key, defective_files(facts)) if spec.primary_key and not replace else None
    judged = judge_files(facts, spec, conflicts).collect()
    return [FileStatus(spec.name, r[FILE], r["rows"], r["status"], r["reason"]) for r in sorted(judged, key=lambda r: r[FILE])]


def accepted_rows(fitted: DataFrame, statuses: Sequence[FileStatus] | DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of the accepted files, with FILE and ROW still on them."""
    if isinstance(statuses, DataFrame):
        kept_rows = fitted.join(statuses.where(F.col("status") != LOADED).select(FILE), FILE, "left_anti")
    else:
        kept_rows = _without(fitted, {s.source_file for s in statuses if s.status != LOADED})
    kept = [c for c in fitted.columns if c in (FILE, ROW)]
    return kept_rows.select(*kept, *map(col, spec.column_names))


def _without(rows: DataFrame, files: set[str]) -> DataFrame:
    """Rows of other files; Spark decides by the size of the list how to join it."""
    if not files:
        return rows
    names = rows.sparkSession.createDataFrame(pa.table({FILE: sorted(files)}))  # of known size
    return rows.join(names, FILE, "left_anti")


def quarantine(fitted: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Split rows instead of files: (good rows, bad rows with a reason).

    Of several rows with one key the first by file and row is good.
    """
    reason = F.when(F.col(NULL_FINDING).isNotNull(), F.concat(F.lit("not_null: "), NULL_FINDING)).when(
        F.col(TYPE_FINDING).isNotNull(), F.concat(F.lit("type: "), TYPE_FINDING)
    )
    judged = fitted.withColumn("reason", reason)
    columns = [FILE, ROW, *spec.column_names]
    bad = judged.where(F.col("reason").isNotNull()).select(*map(col, columns), "reason")
    good = judged.where(F.col("reason").isNull()).select(*map(col, columns))
    key = spec.primary_key
    if not key:
        return good, bad
    place = F.struct(FILE, ROW)
    repeated = (
        good.where(has_keys(key))
        .groupBy(*[col(k).alias(f"__{k}") for k in key])
        .agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
        .where(F.col("__n") > 1)
    )
    hot = hot_keys(good, [key]).get(tuple(key))
    dealt = good if hot is None else deal(good)
    marked = join_parent(dealt, repeated, key, [f"__{k}" for k in key], "left", hot)
    later = F.col("__first").isNotNull() & (F.struct(col(FILE, "child"), col(ROW, "child")) != F.col("__first"))
    marked = marked.select(*[col(c, "child").alias(c) for c in columns], later.alias("__later"))
    duplicates = marked.where("__later").select(*map(col, columns), F.lit("duplicate_key").alias("reason"))
    return marked.where("not __later").select(*map(col, columns)), bad.unionByName(duplicates)


def status_frame(statuses: Sequence[FileStatus], spark: SparkSession) -> DataFrame:
    """The load report: one row per table and file, with rows written and stored rows replaced."""
    rows = [(s.table, s.source_file, s.rows, s.replaced, s.status, s.reason) for s in statuses]
    return spark.createDataFrame(rows, REPORT)


def total_rows(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))
