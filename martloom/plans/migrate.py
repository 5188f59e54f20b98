"""The migration run: mapped sources into a fresh and into a persistent store."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import partial, reduce
from operator import and_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from martloom.functions import col
from martloom.operators.checks import has_keys
from martloom.operators.conflicts import conflicting_files, repeated_keys
from martloom.operators.discovery import target_columns
from martloom.operators.frames import union_all
from martloom.operators.keys import generate_keys, last_wins
from martloom.operators.loading import (
    ALL_EMPTY,
    FILE,
    NO_MAPPING,
    NULL_FINDING,
    REPORT,
    ROW,
    SKIPPED,
    TYPE_FINDING,
    FileStatus,
    accepted_rows,
    defective_files,
    fit_rows,
    judge_files,
    status_frame,
    union_files,
)
from martloom.operators.mapping import Mapping, failing_mappings, map_columns, select_mappings
from martloom.operators.validation import row_metrics, validate_tables
from martloom.session import counts_of, drop_scratch, run_together, scratch_path, stage, stage_counted
from martloom.sources.raw import load_time
from martloom.sources.store import TableStore
from martloom.spec import TableSpec

# Marks a row in which no mapped column has a value.
EMPTY = "__empty"


@dataclass(frozen=True)
class Source:
    """A source by file name; ``order`` is the column that numbers its rows.

    A source of many part files names the column that tells them apart in ``file``; each part
    is then accepted or rejected by itself.
    """

    name: str
    frame: DataFrame
    order: str
    file: str | None = None


@dataclass(frozen=True)
class Migration:
    report: DataFrame
    validation: DataFrame
    project_report: DataFrame | None


def migrate(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    sources: Sequence[Source],
    mappings: Sequence[Mapping],
    session_store: TableStore,
    project_store: TableStore | None = None,
    tables: Iterable[str] = (),
    report_path: str | None = None,
) -> Migration:
    """Load every selected target (all when none is named) from every source with mappings.

    The session store is recreated and takes whole files or none of their rows; the project
    store keeps what it has and replaces rows by key.  Sources are best landed raw first, so
    the passes over them read Parquet columns and not text.  Rows are counted as they are written, and what
    they show to be absent (findings, repeated keys, missing keys) is not looked for again.
    """
    wanted = set(tables)
    selected = [spec for spec in specs if not wanted or spec.name in wanted]
    if wanted and not selected:
        raise ValueError(f"Unknown tables: {', '.join(sorted(wanted))}")
    observed: dict[str, dict] = {}

    def load(spec: TableSpec) -> tuple[DataFrame | None, DataFrame | None]:
        own, mapped = sources if spec in selected else [], mappings
        rows, skipped, names = table_batch(spec, own, mapped)
        left_out = status_frame(skipped, spark) if skipped else None
        if rows is None:
            session_store.write(spec, spark.createDataFrame([], spec.spark_schema))
            return left_out, None
        # mapped and fitted once; both stores and all counts read the result
        scratch = scratch_path(spark, "batch")
        try:
            batch = read_batch(rows, spec, scratch)
        except PySparkException:
            # a transformation may have failed on a value: where one did, its file takes the plain column
            mapped = runnable_mappings(spec, own, mappings)
            if mapped == list(mappings):
                raise
            drop_scratch(spark, scratch)
            batch = read_batch(table_batch(spec, own, mapped)[0], spec, scratch)
        found, observed[spec.name] = load_recreate(session_store, spec, batch)
        kept = load_upsert(project_store, spec, batch) if project_store is not None else None
        drop_scratch(spark, scratch)
        absent = spark.createDataFrame([(n,) for n in names], f"{FILE} string").join(batch.facts, FILE, "left_anti")
        nothing = [(batch.facts.where("rows = 0").select(FILE), ALL_EMPTY), (absent, NO_MAPPING)]
        empty = [report_rows(df, spec, F.lit(0), F.lit(0), F.lit(SKIPPED), F.lit(reason)) for df, reason in nothing]
        return union_all([*([left_out] if left_out is not None else []), found, *empty]), kept

    results = run_together([partial(load, spec) for spec in specs])
    report = union_all([found for found, _ in results if found is not None], spark, REPORT)
    loaded = {spec.name: session_store.read(spec.name) for spec in selected}
    validation = validate_tables(selected, loaded, spark, observed)
    project_report = union_all([kept for _, kept in results if kept is not None], spark, REPORT) if project_store is not None else None
    if report_path:
        report, validation = write_report(spark, report_path, report, validation, mappings, sources, selected)
    return Migration(report, validation, project_report)


def write_report(
    spark: SparkSession,
    path: str,
    report: DataFrame,
    validation: DataFrame,
    mappings: Sequence[Mapping],
    sources: Sequence[Source],
    selected: Sequence[TableSpec],
) -> tuple[DataFrame, DataFrame]:
    """Write the run as JSON, a folder per part; returns the load report and the validation as written."""
    mapping_rows = [tuple(asdict(m).values()) for m in mappings]
    schema = (
        "target_table string, target_column string, source_file string, source_column string, "
        "transformation string, confidence double, reason string"
    )
    names = [[s.name for s in sources], [s.name for s in selected]]
    run = spark.createDataFrame(
        [(load_time(), *names)], "timestamp string, source_files array<string>, selected_tables array<string>"
    )
    parts = {
        "run": run,
        "rows_loaded": report,
        "mappings": spark.createDataFrame(mapping_rows, schema),
        "target_columns": target_columns(selected, spark),
        "validation": validation,
    }
    run_together([partial(df.write.mode("overwrite").json, f"{path.rstrip('/')}/{name}") for name, df in parts.items()])
    written = [spark.read.schema(df.schema).json(f"{path.rstrip('/')}/{name}") for name, df in (("rows_loaded", report), ("validation", validation))]
    return written[0], written[1]


def table_batch(
    spec: TableSpec, sources: Sequence[Source], mappings: Sequence[Mapping]
) -> tuple[DataFrame | None, list[FileStatus], list[str]]:
    """All mapped rows of one target with their file and row, the sources left out, and the files known by name."""
    parts, skipped, names = [], [], []
    for source in sorted(sources, key=lambda s: s.name):
        chosen = select_mappings(mappings, spec.name, source.name)
        if not chosen:
            skipped.append(FileStatus(spec.name, source.name, 0, SKIPPED, NO_MAPPING))
            continue
        file = col(source.file) if source.file else F.lit(source.name)
        numbered = source.frame.withColumns({FILE: file, ROW: col(source.order)})
        mapped = map_columns(numbered, chosen, spec, keep=(FILE, ROW))
        empty = reduce(and_, (col(m.target_column).isNull() for m in chosen))
        parts.append(fit_rows(mapped.withColumn(EMPTY, empty), spec, (FILE, ROW, EMPTY)))
        names += [] if source.file else [source.name]
    return (union_files(parts) if parts else None), skipped, names


def runnable_mappings(spec: TableSpec, sources: Sequence[Source], mappings: Sequence[Mapping]) -> list[Mapping]:
    """The mappings without the transformations of this target that fail on a value of their source."""
    failing = [m for s in sources for m in failing_mappings(s.frame, select_mappings(mappings, spec.name, s.name))]
    return [replace(m, transformation=None) if m in failing else m for m in mappings]


@dataclass(frozen=True)
class Batch:
    """The staged rows of one target, what was seen of them, their files, and how many keys repeat among them."""

    rows: DataFrame
    facts: DataFrame
    defects: bool
    keyless: int
    repeated: DataFrame | None


def read_batch(mapped: DataFrame, spec: TableSpec, path: str) -> Batch:
    """Stage the rows of a target; those without any value only count for their file."""
    filled = ~F.col(EMPTY)
    bad = F.col(TYPE_FINDING).isNotNull() | F.col(NULL_FINDING).isNotNull()
    missing = F.count_if(filled & col(spec.generated_key).isNull()) if spec.generated_key else F.lit(0)
    staged, seen = stage_counted(mapped, "batch", path, bad=F.count_if(filled & bad), keyless=missing)
    findings = [F.min(F.when(filled, F.col(c))).alias(name) for c, name in ((TYPE_FINDING, "loss"), (NULL_FINDING, "null"))]
    facts = stage(staged.groupBy(FILE).agg(F.count_if(filled).alias("rows"), *findings), "facts")
    rows = staged.where(filled).drop(EMPTY)
    repeated = repeated_keys(rows, spec.primary_key) if spec.primary_key else None
    return Batch(rows, facts, bool(seen["bad"]), seen["keyless"], repeated)


def report_rows(files: DataFrame, spec: TableSpec, rows: Column, replaced: Column, status: Column, reason: Column) -> DataFrame:
    """The load report's rows of some files."""
    return files.select(
        F.lit(spec.name).alias("table"),
        F.col(FILE).alias("source_file"),
        rows.cast("bigint").alias("rows"),
        replaced.cast("bigint").alias("replaced"),
        status.alias("status"),
        reason.alias("reason"),
    )


def load_recreate(store: TableStore, spec: TableSpec, batch: Batch) -> tuple[DataFrame, dict]:
    """Replace the target by the accepted files; the report, and what was observed of the rows."""
    conflicts = None
    if batch.repeated is not None:
        defective = defective_files(batch.facts) if batch.defects else None
        conflicts = conflicting_files(batch.rows, spec.primary_key, defective, batch.repeated)
    judged = judge_files(batch.facts.where("rows > 0"), spec, conflicts)
    rows = accepted_rows(batch.rows, judged, spec) if batch.defects or conflicts is not None else batch.rows
    if batch.keyless:
        rows = _numbered(rows, spec, None)
    seen, metrics = Observation(), row_metrics(spec)
    store.write(spec, rows, seen, **metrics)
    return report_rows(judged, spec, F.col("rows"), F.lit(0), F.col("status"), F.col("reason")), counts_of(seen, *metrics)


def load_upsert(store: TableStore, spec: TableSpec, batch: Batch) -> DataFrame:
    """Replace rows of the target by key, the last file and row of a key winning.

    The report tells the rows written, after repeats within the batch, and how many of them
    replaced a stored row.
    """
    judged, rows = judge_files(batch.facts.where("rows > 0"), spec), batch.rows
    if batch.defects:
        rows = accepted_rows(rows, judged, spec)
    if batch.repeated is not None:
        rows = last_wins(rows.select(FILE, ROW, *map(col, spec.column_names)), spec.primary_key, [FILE, ROW])
    known = store.exists(spec.name)
    if batch.keyless:
        top = store.read(spec.name).agg(F.max(col(spec.generated_key))).first()[0] if known else None
        rows = _numbered(rows, spec, top)
    if batch.defects or batch.repeated is not None or batch.keyless:
        rows = stage(rows, "upsert")
    stored = store.read(spec.name) if known and spec.primary_key else None
    written = _per_file(rows, stored, spec) if stored is not None or batch.repeated is not None else None
    store.upsert(spec, rows)
    if written is None:
        return report_rows(judged, spec, F.col("rows"), F.lit(0), F.col("status"), F.col("reason"))
    counted = judged.drop("rows").join(written, FILE, "left").fillna(0, ["rows", "replaced"])
    return report_rows(counted, spec, F.col("rows"), F.col("replaced"), F.col("status"), F.col("reason"))


def _per_file(rows: DataFrame, stored: DataFrame | None, spec: TableSpec) -> DataFrame:
    """Rows of each file, and how many of them have a stored row to replace."""
    known = F.lit(False)
    if stored is not None:
        keys = stored.where(has_keys(spec.primary_key)).select(*map(col, spec.primary_key), F.lit(True).alias("__stored"))
        rows, known = rows.join(keys, spec.primary_key, "left"), F.coalesce("__stored", F.lit(False))
    return stage(rows.groupBy(FILE).agg(F.count("*").alias("rows"), F.count_if(known).alias("replaced")), "written")


def _numbered(rows: DataFrame, spec: TableSpec, top: int | None) -> DataFrame:
    """Number the rows without a key in file and row order."""
    return generate_keys(rows, spec.generated_key, order=[FILE, ROW], start=top)
