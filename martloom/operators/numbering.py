"""Dense row numbers without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from martloom.functions import col
from martloom.session import stage, stage_counted

# The offsets table has one row per task or file block, some 150 bytes each; it is broadcast up
# to this many rows and joined without a hint beyond.
BROADCAST_ROWS = 1_000_000

TASK, STEP = "__task", "__step"


def stage_for_numbering(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write the rows once together with the task that produced them and their place in it.

    How a scan is split depends on the cluster at that moment, so the places are pinned in a
    written table before anything is counted.
    """
    return stage(
        df.withColumns({TASK: F.spark_partition_id(), STEP: F.monotonically_increasing_id()}),
        label,
        path,
    )


def number_rows(
    staged: DataFrame,
    name: str,
    restart: Sequence[str] = (),
    blocks: Sequence[str] = (),
    start: Column | int = 0,
    of_run: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Number staged rows ``start+1, start+2, ...`` in task order, from anew for each ``restart`` key.

    A run of rows is what one task read of one block.  Runs are counted (combined on the map
    side), a running total over the few runs gives each its offset, and every row adds its
    place in the run to that offset.  The rows themselves are neither sorted nor shuffled.
    ``of_run`` has further columns, made from ``restart`` and ``blocks`` once a run.
    """
    keys = [TASK, *restart, *blocks]
    runs, seen = stage_counted(staged.groupBy(*map(col, keys)).agg(F.min(STEP).alias("__low"), F.count("*").alias("__rows")), "runs")
    order = [col(b) for b in blocks] + [F.col("__low")]
    made = [value.alias(new) for new, value in (of_run or {}).items()]
    before = F.sum("__rows").over(W.partitionBy(*map(col, restart)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    offsets = runs.select(*map(col, keys), "__low", F.coalesce(before, F.lit(0)).alias("__before"), *made)
    if seen["rows"] <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    first = start if isinstance(start, Column) else F.lit(start)
    number = (first + F.col("__before") + F.col(STEP) - F.col("__low") + 1).cast("bigint")
    kept = [col(c) for c in staged.columns if c not in (TASK, STEP)]
    return staged.join(offsets, keys, "inner").select(*kept, *map(col, of_run or {}), number.alias(name))
