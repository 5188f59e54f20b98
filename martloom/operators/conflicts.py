"""Which files a load rejects because their keys repeat, decided in Spark.

Files are taken in the order of their names; one is rejected if a key repeats in it, or if it shares
a key with an accepted file before it. Rows are first reduced to the sets of files that share a key: what a
key adds to a set that is known already decides nothing. The (file, set) pairs are dealt out in
ranges of files, so a task decides all its files in order, but for those that depend on files of
earlier ranges that are open still. A round decides at least the first open range; most decide all.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from martloom.functions import col
from martloom.operators.checks import key_counts
from martloom.session import stage, stage_counted

# Pairs of file and set that one task holds; a single file's pairs stay together.
PAIRS_PER_RANGE = 500_000

# The file of a row; sets are told apart by size and two sums of hashes, of 64 bits each and more.
FILE, SET, RANGE = "__source", "__set", "__range"


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """Staged keys that more than one row holds; None if there are none."""
    twice = key_counts(rows, key).where("rows > 1").drop("rows")
    staged, seen = stage_counted(twice, "repeated")
    return staged if seen["rows"] else None


def contested_keys(rows: DataFrame, key: Sequence[str], repeated: DataFrame) -> tuple[DataFrame, int, int]:
    """Staged (file, n, files, set) of the repeated keys, with the number of those that repeat in a file and over files."""
    names = list(key)
    held = rows.join(repeated, names, "left_semi").groupBy(*map(col, names), FILE).agg(F.count("*").alias("n"))
    over = W.partitionBy(*map(col, names))
    total = [F.sum(F.xxhash64(F.lit(seed), FILE).cast("decimal(20,0)")).over(over) for seed in (1, 2)]
    files = F.count("*").over(over)
    marked = held.withColumns({"files": files, SET: F.concat_ws(":", files, *total)}).select(FILE, "n", "files", SET)
    staged, seen = stage_counted(marked, "contested", inside=F.count_if(F.col("n") > 1), shared=F.count_if(F.col("files") > 1))
    return staged, seen["inside"], seen["shared"]


def conflicting_files(
    rows: DataFrame, key: Sequence[str], defective: DataFrame | None = None, repeated: DataFrame | None = None
) -> DataFrame | None:
    """Names of the files whose keys repeat; None if there are none.

    ``defective`` files are rejected for other reasons; ``repeated`` has the keys that repeat, where they are known.
    """
    repeated = repeated_keys(rows, key) if repeated is None else repeated
    if repeated is None:
        return None
    contested, inside, shared = contested_keys(rows, key, repeated)
    repeating = contested.where("n > 1").select(FILE).distinct()
    if not shared:
        return repeating
    bad = repeating if defective is None else repeating.unionByName(defective.select(FILE)).distinct()
    pairs = contested.where("files > 1").select(FILE, SET).distinct()
    pairs = pairs.join(bad, FILE, "left_anti") if inside or defective is not None else pairs
    late = late_files(pairs, -(-shared // PAIRS_PER_RANGE))
    return repeating.unionByName(late).distinct() if inside else late


def late_files(pairs: DataFrame, ranges: int) -> DataFrame:
    """Files that share a set with an accepted file before them."""
    spark = pairs.sparkSession
    if ranges <= 1:  # one task decides all
        alone = pairs.withColumns({RANGE: F.lit(0), "taken": F.lit(False), "blocked": F.lit(False)})
        return stage(_decided(alone), "decided").where("not accepted").select(FILE)
    dealt = pairs.repartitionByRange(ranges, FILE).withColumn(RANGE, F.spark_partition_id())
    open_, seen = stage_counted(dealt, "pairs")
    taken: DataFrame | None = None
    rejected: list[DataFrame] = []
    while seen["rows"]:
        decided = stage(_round(open_, taken), "decided")
        rejected.append(decided.where("not accepted").select(FILE))
        won = open_.join(decided.where("accepted"), FILE, "left_semi").select(SET).distinct()
        taken = won if taken is None else stage(taken.unionByName(won), "taken")
        open_, seen = stage_counted(open_.join(decided, FILE, "left_anti"), "pairs")
    schema = f"{FILE} string"
    return rejected[0] if len(rejected) == 1 else _all(rejected) if rejected else spark.createDataFrame([], schema)


def _all(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def _round(open_: DataFrame, taken: DataFrame | None) -> DataFrame:
    """(file, accepted) of the files that can be decided now."""
    first = open_.groupBy(SET).agg(F.min(RANGE).alias("first"))
    known = open_.join(first, SET).withColumn("blocked", F.col("first") < F.col(RANGE)).drop("first")
    if taken is None:
        known = known.withColumn("taken", F.lit(False))
    else:
        known = known.join(taken.withColumn("taken", F.lit(True)), SET, "left").fillna(False, ["taken"])
    return _decided(known)


def _decided(known: DataFrame) -> DataFrame:
    return known.groupBy(RANGE).applyInPandas(decide, f"{FILE} string, accepted boolean")


def _decider():
    # a local function goes to the workers as it is, wherever they find this package
    file_column, set_column = FILE, SET

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        """The files of one range in their order."""
        taken = set(rows.loc[rows["taken"], set_column])
        blocked = set(rows.loc[rows["blocked"], set_column])
        out = []
        for file, sets in rows.sort_values(file_column, kind="stable").groupby(file_column, sort=False)[set_column]:
            own = set(sets)
            if not taken.isdisjoint(own):
                out.append((file, False))
            elif not blocked.isdisjoint(own):
                blocked |= own
            else:
                out.append((file, True))
                taken |= own
        return pd.DataFrame(out, columns=[file_column, "accepted"])

    return decide


decide = _decider()
