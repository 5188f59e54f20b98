"""Which source column fills which target column, judged by shared values and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from martloom.functions import col
from martloom.operators.frames import one_row, union_all
from martloom.operators.mapping import Mapping
from martloom.operators.profiling import value_key
from martloom.session import drop_scratch, scratch_path, stage
from martloom.spec import TableSpec

# Weights of value overlap and name likeness, and the least score of a proposal [our choice].
OVERLAP_WEIGHT, NAME_WEIGHT, THRESHOLD = 0.7, 0.3, 0.35

# Columns per bit mask word.
WORD = 62


def column_overlap(sources: dict[str, DataFrame], targets: dict[str, DataFrame]) -> DataFrame:
    """Distinct values shared by every pair of a source and a target column with any in common.

    Every value is reduced to the set of columns that hold it, as bit masks joined with OR on
    the map side already.  Equal sets are then counted, and only those few counted sets are
    spread into column pairs: no self-join on values, and a value held by a third of all cells
    is one row per task.
    """
    columns = [("source", t, c) for t, df in sources.items() for c in df.columns]
    columns += [("target", t, c) for t, df in targets.items() for c in df.columns]
    words = -(-len(columns) // WORD)
    position = {c: i for i, c in enumerate(columns)}
    parts = []
    for side, frames in (("source", sources), ("target", targets)):
        for name, df in frames.items():
            values = [
                F.struct(
                    F.lit(position[side, name, f.name] // WORD).alias("word"),
                    F.lit(1 << position[side, name, f.name] % WORD).cast("bigint").alias("bit"),
                    value_key(col(f.name), f.dataType).alias("value"),
                )
                for f in df.schema.fields
            ]
            parts.append(df.select(F.inline(F.array(*values))).where(F.col("value").isNotNull()))
    masks = [f"m{w}" for w in range(words)]
    none = F.lit(0).cast("bigint")
    by_value = union_all(parts).groupBy("value").agg(
        *[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(none)).alias(m) for w, m in enumerate(masks)]
    )
    # stored once: a row per set of columns that share values, read three times below
    spark = by_value.sparkSession
    scratch = scratch_path(spark, "sets")
    sets = stage(by_value.groupBy(*masks).agg(F.count("*").alias("values")), "sets", scratch)

    def members(side: str):
        held = [
            F.when(F.col(masks[i // WORD]).bitwiseAND(F.lit(1 << i % WORD).cast("bigint")) != 0, F.lit(i))
            for i, c in enumerate(columns)
            if c[0] == side
        ]
        return F.array_compact(F.array(*held))

    held = sets.select("values", members("source").alias("s"), members("target").alias("t"))
    sizes = (
        held.select("values", F.explode(F.concat("s", "t")).alias("id")).groupBy("id").agg(F.sum("values").alias("size"))
    )
    pairs = (
        held.select("values", F.explode("s").alias("s"), "t")
        .select("values", "s", F.explode("t").alias("t"))
        .groupBy("s", "t")
        .agg(F.sum("values").alias("shared"))
    )
    names = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for _, t, c in columns])
    # both sides of these joins have at most one row per column (pair)
    found = (
        pairs.join(sizes.select(F.col("id").alias("s"), F.col("size").alias("source_distinct")), "s")
        .join(sizes.select(F.col("id").alias("t"), F.col("size").alias("target_distinct")), "t")
        .select(
            names[F.col("s")]["table"].alias("source_table"),
            names[F.col("s")]["column"].alias("source_column"),
            names[F.col("t")]["table"].alias("target_table"),
            names[F.col("t")]["column"].alias("target_column"),
            "shared",
            F.round(F.col("shared") / F.col("source_distinct"), 4).alias("overlap"),
            F.round(F.col("shared") / (F.col("source_distinct") + F.col("target_distinct") - F.col("shared")), 4).alias(
                "likeness"
            ),
        )
    )
    result = stage(found, "overlap")  # a row per pair of columns, for which the sets need not stay
    drop_scratch(spark, scratch)
    return result


def propose_mappings(
    sources: dict[str, DataFrame], targets: dict[str, DataFrame], threshold: float = THRESHOLD
) -> DataFrame:
    """The best source column of every target column, or none with confidence 0.

    The score weighs the overlap of the distinct values with the likeness of the names.
    """
    left, right = F.lower("source_column"), F.lower("target_column")
    longest = F.greatest(F.length(left), F.length(right))
    alike = 1 - F.levenshtein(left, right) / longest
    score = F.round(F.lit(OVERLAP_WEIGHT) * F.col("likeness") + F.lit(NAME_WEIGHT) * alike, 4)
    best = W.partitionBy("target_table", "target_column").orderBy(
        F.desc("confidence"), "source_table", "source_column"
    )
    scored = (
        column_overlap(sources, targets)
        .withColumn("confidence", score)
        .where(F.col("confidence") >= threshold)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") == 1)
    )
    wanted = [
        F.struct(F.lit(t).alias("target_table"), F.lit(c).alias("target_column"))
        for t, df in targets.items()
        for c in df.columns
    ]
    spark = next(iter(targets.values())).sparkSession
    return (
        one_row(spark)
        .select(F.inline(F.array(*wanted)))
        .join(scored, ["target_table", "target_column"], "left")
        .select(
            "target_table",
            "target_column",
            F.col("source_table").alias("source_file"),
            "source_column",
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )
    )


def proposed_list(proposal: DataFrame, specs: Sequence[TableSpec]) -> list[Mapping]:
    """Mappings of a proposal, one per target column.

    A foreign key takes the source of the key it refers to, where that comes from the same file
    as the rest of its table.
    """
    rows = {(r["target_table"], r["target_column"]): r for r in proposal.collect()}
    result = []
    for spec in specs:
        files = [r["source_file"] for (t, _), r in rows.items() if t == spec.name and r["source_file"]]
        main = max(sorted(set(files)), key=files.count) if files else None
        refs = {c: (fk.ref_table, ref) for fk in spec.foreign_keys for c, ref in zip(fk.columns, fk.ref_columns)}
        for name in spec.column_names:
            row = rows.get((spec.name, name))
            parent = rows.get(refs.get(name))
            reason = "shared values and similar name"
            if parent is not None and parent["source_file"] and parent["source_file"] == main:
                row, reason = parent, "same source as the referenced key"
            if row is None or row["source_column"] is None:
                result.append(Mapping(spec.name, name, None, None, None, 0.0, "no source column fits"))
            else:
                result.append(
                    Mapping(spec.name, name, row["source_file"], row["source_column"], None, row["confidence"], reason)
                )
    return result
