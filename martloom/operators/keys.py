"""Primary keys at load time: last write wins, generated keys, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from martloom.functions import col
from martloom.operators.checks import has_keys
from martloom.operators.numbering import number_rows, stage_for_numbering
from martloom.session import drop_scratch, scratch_path, stage


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of every key; rows with a NULL key part are all kept.

    An aggregate rather than a ranking window: each task first reduces its rows to one per key,
    so a key that holds a third of all rows is not gathered in one task. Rows are structs here, for
    which Spark sorts a task's own rows by key (spilling if need be) before it reduces them.
    """
    rest = [c for c in df.columns if c not in key]
    moment = F.struct(*[col(o) if isinstance(o, str) else o for o in order])
    packed = F.struct(*map(col, rest)) if rest else F.lit(True)
    keyed = (
        df.where(has_keys(key))
        .groupBy(*map(col, key))
        .agg(F.max_by(packed, moment).alias("__last"))
        .select(*[col(c) if c in key else F.col("__last").getField(c).alias(c) for c in df.columns])
    )
    return keyed.unionByName(df.where(~has_keys(key)))


def upsert(existing: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace whole rows by key; ``batch`` has one row per key.

    Columns the batch lacks become NULL in replaced rows.  Existing rows without a key meet no
    batch row, so they pass beside the join and cannot pile up in it.
    """
    return replaced(existing.where(has_keys(key)), batch, key).unionByName(
        existing.where(~has_keys(key)), allowMissingColumns=True
    )


def replaced(keyed: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    names = list(key)
    keys = batch.where(has_keys(key)).select(*map(col, names))
    return keyed.join(keys, names, "left_anti").select(*map(col, keyed.columns)).unionByName(
        batch, allowMissingColumns=True
    )


def generate_keys(df: DataFrame, key: str, order: Sequence[str] = (), start: int | None = None) -> DataFrame:
    """Fill a missing integer key with dense numbers above the largest one in use.

    ``start`` is the largest key of the table loaded into, if any.  With ``order`` the numbers
    follow that order over all rows: a range-partitioned sort, numbered in parallel.
    """
    if key not in df.columns:
        df = df.withColumn(key, F.lit(None).cast("bigint"))
    columns = df.columns
    top = df.agg(F.max(col(key))).first()[0]
    known = max((v for v in (top, start) if v is not None), default=0)
    missing = df.where(col(key).isNull()).select(*[col(c) for c in columns if c != key])
    scratch = None
    if order:
        # the place in the scan comes last, so that range partitions can split rows of equal order;
        # it is the place in a written table, which stays the same when a task runs again
        scratch = scratch_path(df.sparkSession, "keyless")
        missing = stage(missing, "keyless", scratch)
        placed = missing.withColumn("__place", F.monotonically_increasing_id())
        missing = placed.orderBy(*map(col, order), "__place").drop("__place")
    sorted_rows = stage_for_numbering(missing, "keys")
    if scratch:
        drop_scratch(df.sparkSession, scratch)
    numbered = number_rows(sorted_rows, key, start=known)
    return df.where(col(key).isNotNull()).unionByName(numbered.select(*map(col, columns)))
