"""Equi-joins that stay balanced when a few keys hold much of the child table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from martloom.functions import col

# Parents up to this size in bytes, by Spark's estimate, are left to Spark as they are: it
# broadcasts them when their size allows, and otherwise splits skewed partitions at run time.
SMALL_PARENT_BYTES = 64 << 20

# A hot key holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE of them.
HOT_SHARE = 2000
TRACKED_ITEMS = 20_000

# DEAL is the place of a row in its scan, SALT the part of a hot key it was dealt to.
DEAL, SALT = "__deal", "__salt"


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """One number for the tuple of key columns, equal for equal keys whatever their width; null if one is missing."""
    values = []
    for k in keys:
        kind, value = df.schema[k].dataType, col(k)
        if isinstance(kind, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            value = value.cast("double") + F.lit(0.0)  # one zero
        values.append(value)
    missing = [F.col("`" + k.replace("`", "``") + "`").isNull() for k in keys]
    return F.when(~reduce(or_, missing), F.xxhash64(*values))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "whole"
    return "real" if isinstance(kind, (T.FractionalType, T.DecimalType)) else kind.simpleString()


def hot_keys(child: DataFrame, keys: Sequence[Sequence[str]]) -> dict[tuple[str, ...], dict[int, float]]:
    """For each tuple of columns the hashes of all its hot keys with their share of the rows.

    One pass with one sketch per tuple.  The sketch only decides which keys get spread out;
    results do not depend on its accuracy.  A tuple without hot keys is left out; one where only
    missing keys are many has none listed.
    """
    tuples = list(dict.fromkeys(tuple(k) for k in keys))
    if not tuples:
        return {}
    marked = child.select(*(key_hash(child, k).alias(f"h{i}") for i, k in enumerate(tuples)))
    sketches = [F.expr(f"approx_top_k(h{i}, {HOT_SHARE}, {TRACKED_ITEMS})").alias(f"k{i}") for i in range(len(tuples))]
    row = marked.agg(F.count("*").alias("rows"), *sketches, *(F.count_if(F.col(f"h{i}").isNull()).alias(f"n{i}") for i in range(len(tuples)))).first()
    found = {}
    for i, k in enumerate(tuples):
        least = row["rows"] / HOT_SHARE
        hot = {x["item"]: x["count"] / row["rows"] for x in row[f"k{i}"] if x["item"] is not None and x["count"] >= least > 0}
        if hot or row[f"n{i}"] >= least > 0:
            found[k] = hot
    return found


def hot_keys_for(
    child: DataFrame, parents: Sequence[tuple[DataFrame, Sequence[str]]], small: int | None = None
) -> dict[tuple[str, ...], dict[int, float]]:
    """Hot keys of the joins whose parent is too large to be broadcast."""
    limit = SMALL_PARENT_BYTES if small is None else small
    wide = [tuple(columns) for parent, columns in parents if _estimated_bytes(parent) > limit]
    return hot_keys(child, wide)


def _estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate, for which nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def deal(child: DataFrame) -> DataFrame:
    """Note the place of every row, so that even equal rows can be dealt out.

    To be called where the child is read from a table: a task that runs again sees the same
    rows in the same order there, and later joins reuse the noted place.
    """
    return child.withColumn(DEAL, F.monotonically_increasing_id())


def spread(
    child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str], hot: dict[int, float]
) -> tuple[DataFrame, DataFrame]:
    """Add a salt to both sides: hot child rows are dealt out, their parent rows repeated.

    A key with a share s of the rows is dealt to s times the number of shuffle partitions, so
    every part is about as large as an ordinary partition.  Only parent rows of hot keys are
    repeated, altogether at most about once per partition, whatever the size of the parent.
    Rows without a key are dealt out too; they match nothing anyway.  Places are hashed, for
    keys may come at regular distances.
    """
    partitions = int(child.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = [(key, max(2, round(share * partitions))) for key, share in hot.items()]
    parts = F.broadcast(child.sparkSession.createDataFrame(listed, "__hot bigint, __parts int"))  # at most HOT_SHARE rows
    own, other = key_hash(child, child_keys), key_hash(parent, parent_keys)
    salts = F.when(F.col("__key").isNull(), F.lit(partitions)).otherwise(F.coalesce("__parts", F.lit(1)))
    salted = child.withColumn("__key", own).join(parts, F.col("__key") == F.col("__hot"), "left")
    salted = salted.withColumn(SALT, F.pmod(F.xxhash64(DEAL), salts).cast("int")).drop("__key", "__hot", "__parts")
    copies = parent.withColumn("__key", other).join(parts, F.col("__key") == F.col("__hot"), "left")
    copies = copies.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return salted, copies.drop("__key", "__hot", "__parts")


def join_parent(
    child: DataFrame,
    parent: DataFrame,
    child_keys: Sequence[str],
    parent_keys: Sequence[str],
    how: str,
    hot: dict | None = None,
    alias: str = "parent",
) -> DataFrame:
    """Join ``child`` and ``parent`` (aliased) on their keys, spreading the hot ones.

    ``hot`` (also when empty: keyless rows) spreads a dealt child; None joins as it is, and so
    do keys whose types only a cast makes comparable.
    """
    alike = all(_family(child.schema[c].dataType) == _family(parent.schema[p].dataType) for c, p in zip(child_keys, parent_keys, strict=True))
    salted = hot is not None and alike
    if salted:
        child, parent = spread(child, parent, child_keys, parent_keys, hot)
    child, parent = child.alias("child"), parent.alias(alias)
    condition = _all_equal(child_keys, parent_keys, alias)
    if salted:
        condition &= col(SALT, "child") == col(SALT, alias)
    return child.join(parent, condition, how)


def _all_equal(child_keys: Sequence[str], parent_keys: Sequence[str], alias: str) -> Column:
    pairs = [col(c, "child") == col(p, alias) for c, p in zip(child_keys, parent_keys, strict=True)]
    condition = pairs[0]
    for pair in pairs[1:]:
        condition &= pair
    return condition
