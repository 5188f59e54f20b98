"""Key summaries: every key of a table that tests and reports ask for, counted in one scan.

The summary of a table has a row for each key set and key, with the number of rows that hold it. One
aggregation over grouping sets makes it (combined on the map side, so a hot key leaves a task as one
row), and NULLs and rows are counted while its input passes by. Uniqueness, relationships, inclusion
and foreign keys are then questions to staged summaries; the tables are not read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from martloom.functions import col
from martloom.operators.checks import NOT_NULL, RELATIONSHIPS, UNIQUE, ModelTest
from martloom.operators.frames import union_all
from martloom.session import counts_of, run_together, stage

Columns = tuple[str, ...]


@dataclass(frozen=True)
class KeySummary:
    """What one scan of a table found: staged (set, k0, k1, ..., rows), rows, and NULLs of some columns."""

    sets: dict[Columns, int]
    keys: DataFrame
    columns: dict[str, str]
    rows: int
    nulls: dict[str, int]

    def of(self, columns: Columns) -> DataFrame:
        """(k0, k1, ..., rows) of the complete keys of one set, in the order of ``columns``."""
        held = [F.col(self.columns[c]) for c in columns]
        chosen = self.keys.where(F.col("set") == self.sets[_sorted(columns)])
        for h in held:
            chosen = chosen.where(h.isNotNull())
        return chosen.select(*(h.alias(f"k{i}") for i, h in enumerate(held)), "rows")

    def types(self, columns: Columns) -> tuple:
        return tuple(self.keys.schema[self.columns[c]].dataType for c in columns)


def _sorted(columns: Iterable[str]) -> Columns:
    return tuple(sorted(columns))


def summarise(df: DataFrame, sets: Iterable[Sequence[str]], null_columns: Iterable[str] = ()) -> KeySummary:
    """Count the keys of several sets of columns, and the NULLs of columns, in one scan."""
    wanted = list(dict.fromkeys(_sorted(s) for s in sets))
    used = sorted({c for s in wanted for c in s})
    nulls = list(dict.fromkeys(null_columns))
    seen = Observation()
    counted = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(nulls)]
    rows = df.select(*(col(c) for c in dict.fromkeys([*used, *nulls]))).observe(seen, F.count(F.lit(1)).alias("rows"), *counted)
    if not wanted:
        rows.write.format("noop").mode("overwrite").save()
        keys = df.sparkSession.createDataFrame([], "set int, rows bigint")
    else:
        names = {c: f"c{i}" for i, c in enumerate(used)}
        short = rows.select(*(col(c).alias(n) for c, n in names.items()))
        places = [[F.col(names[c]) for c in s] for s in wanted]
        # grouping_id has a bit for each column that a set leaves out
        bits = [sum(1 << (len(used) - 1 - used.index(c)) for c in used if c not in s) for s in wanted]
        grouped = short.groupingSets(places, *names.values()).agg(F.grouping_id(*names.values()).alias("bits"), F.count(F.lit(1)).alias("rows"))
        at = F.array_position(F.array(*(F.lit(b).cast("bigint") for b in bits)), F.col("bits")).cast("int") - 1
        keys = stage(grouped.select(at.alias("set"), *names.values(), "rows"), "keys")
    found = counts_of(seen, "rows", *(f"n{i}" for i in range(len(nulls))))
    return KeySummary(
        {s: i for i, s in enumerate(wanted)},
        keys,
        {c: f"c{i}" for i, c in enumerate(used)},
        found["rows"],
        {c: found[f"n{i}"] for i, c in enumerate(nulls)},
    )


@dataclass
class Asked:
    sets: list[Columns] = field(default_factory=list)
    nulls: list[str] = field(default_factory=list)


def summarise_for(tests: Sequence[ModelTest], frames: dict[str, DataFrame]) -> dict[str, KeySummary]:
    """One summary for each table that tests ask about, a few tables at the same time."""
    asked: dict[str, Asked] = {}
    for t in tests:
        own = asked.setdefault(t.table, Asked())
        if t.kind == NOT_NULL:
            own.nulls.append(t.columns[0])
            continue
        own.sets.append(t.columns)
        if t.kind == RELATIONSHIPS:
            asked.setdefault(t.parent, Asked()).sets.append(t.parent_columns)
    made = run_together([partial(summarise, frames[name], a.sets, a.nulls) for name, a in asked.items()])
    return dict(zip(asked, made, strict=True))


def orphans(links: Sequence[tuple[KeySummary, Columns, KeySummary, Columns]], spark: SparkSession) -> DataFrame:
    """(link, rows, matched_rows, keys, matched_keys) of every link, by its place in the list.

    Links whose keys are of the same types meet in one join, which has a row for each key on either side.
    """
    by_types: dict[tuple, list[int]] = {}
    for i, (child, columns, parent, referred) in enumerate(links):
        by_types.setdefault((child.types(columns), parent.types(referred)), []).append(i)
    parts = []
    for places in by_types.values():
        held = union_all([links[i][0].of(links[i][1]).select(F.lit(i).alias("link"), "*") for i in places])
        known = union_all([links[i][2].of(links[i][3]).drop("rows").select(F.lit(i).alias("link"), "*", F.lit(True).alias("known")) for i in places])
        names = held.columns[:-1]
        condition = [held[n] == known[n] for n in names]
        joined = held.join(known, condition, "left").select(held["link"], held["rows"], F.coalesce(known["known"], F.lit(False)).alias("known"))
        parts.append(joined)
    counted = union_all(parts, spark, "link int, rows bigint, known boolean").groupBy("link").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("known"), F.col("rows")).otherwise(0)).alias("matched_rows"),
        F.count("*").alias("keys"),
        F.count_if("known").alias("matched_keys"),
    )
    every = union_all([spark.range(1).select(F.lit(i).alias("link")) for i in range(len(links))], spark, "link int")
    return every.join(counted, "link", "left").fillna(0)


def test_results(tests: Sequence[ModelTest], summaries: dict[str, KeySummary], spark: SparkSession, prefix: str = "stg_") -> DataFrame:
    """One row per test, as ``run_tests`` gives them, from summaries alone."""
    known = [(i, summaries[t.table].nulls[t.columns[0]]) for i, t in enumerate(tests) if t.kind == NOT_NULL]
    counts = spark.createDataFrame(known, "test_id int, failures bigint")
    unique = [(i, t) for i, t in enumerate(tests) if t.kind == UNIQUE]
    if unique:
        repeats = union_all([summaries[t.table].of(t.columns).select(F.lit(i).alias("test_id"), (F.col("rows") > 1).alias("twice")) for i, t in unique])
        counts = counts.unionAll(repeats.groupBy("test_id").agg(F.count_if("twice").alias("failures")))
    linked = [(i, t) for i, t in enumerate(tests) if t.kind == RELATIONSHIPS]
    if linked:
        found = orphans([(summaries[t.table], t.columns, summaries[t.parent], t.parent_columns) for _, t in linked], spark)
        ids = F.element_at(F.array(*(F.lit(i) for i, _ in linked)), F.col("link") + 1)
        counts = counts.unionAll(found.select(ids.alias("test_id"), (F.col("rows") - F.col("matched_rows")).alias("failures")))
    listed = [
        (i, t.kind, prefix + t.table, ", ".join(t.columns), f"{prefix}{t.parent}.{', '.join(t.parent_columns)}" if t.parent else None)
        for i, t in enumerate(tests)
    ]
    named = spark.createDataFrame(listed, "test_id int, test string, model string, column string, parent string")
    failures = F.coalesce("failures", F.lit(0)).cast("bigint")
    status = F.when(failures == 0, "pass").otherwise("fail").alias("status")
    return named.join(counts, "test_id", "left").select("test", "model", "column", "parent", failures.alias("failures"), status)


def inclusions(links: Sequence[tuple[KeySummary, Columns, KeySummary, Columns]], spark: SparkSession) -> DataFrame:
    """``orphans`` with the share of keyed rows that have a parent."""
    share = F.when(F.col("rows") > 0, F.col("matched_rows") / F.col("rows")).otherwise(0.0)
    return orphans(links, spark).withColumn("inclusion", F.round(share, 4))
