"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Runtime settings the jobs are designed for.  AQE turns shuffled joins into broadcasts once
# the real size is known, merges small partitions and splits skewed ones.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Folders handed to sessions that name none, by application.
_HANDED: dict[str, str] = {}

# Independent jobs submitted at the same time, so small tables do not leave executors idle.
CONCURRENT_JOBS = 4

Result = TypeVar("Result")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def use_scratch(spark: SparkSession, folder: str) -> None:
    """Hand a folder for intermediate tables to a session that names none."""
    _HANDED[spark.sparkContext.applicationId] = folder.rstrip("/")


def has_scratch(spark: SparkSession) -> bool:
    return bool(spark.conf.get(CHECKPOINT_DIR, None)) or spark.sparkContext.applicationId in _HANDED


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else the one that was handed in."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or _HANDED.get(spark.sparkContext.applicationId)
    if not root:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; never used twice."""
    return f"{scratch_root(spark)}/martloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the scratch folder (``path`` below it, if given) and read it back.

    Cuts the lineage with a real table, so values that depend on how the input was split
    (partition ids, running ids) stay the same for every later reader, also when executors
    are lost and tasks run again.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str, path: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """Like ``stage``, with ``rows`` and further metrics of the rows as they were written; no job of its own counts them."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(name) for name, m in metrics.items()))
    return stage(counted, label, path), counts_of(seen, "rows", *metrics)


def counts_of(seen: Observation, *names: str) -> dict[str, int]:
    """What was observed of rows that have been written; of rows that Spark knew to be none, nothing was."""
    try:
        return {name: seen.get[name] for name in names}
    except Py4JJavaError:  # the plan was empty before it ran, so there are no metrics
        return dict.fromkeys(names, 0)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that no reader needs any more."""
    if not path.startswith(scratch_root(spark) + "/martloom/"):
        raise ValueError(f"not a scratch path: {path}")
    drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    fs.delete(jpath, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) pair for listing folders on whatever storage the cluster uses."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file from the driver, replacing what is there."""
    fs, jpath = hadoop_path(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """One small file as text; None if it is not there."""
    fs, jpath = hadoop_path(spark, path)
    if not fs.exists(jpath):
        return None
    source = fs.open(jpath)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_path(spark, path)
    return fs.exists(jpath)


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Sorted (name, is_folder) entries of a folder; empty when it does not exist."""
    fs, jpath = hadoop_path(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted((entry.getPath().getName(), entry.isDirectory()) for entry in fs.listStatus(jpath))


def run_together(actions: Sequence[Callable[[], Result]], workers: int = CONCURRENT_JOBS) -> list[Result]:
    """Run independent Spark actions at the same time; results in the order given."""
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(lambda action: action(), actions))
