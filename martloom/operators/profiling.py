"""Column profiles: type, null share, distinct count, sample values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from martloom.functions import col
from martloom.functions.display import display
from martloom.operators.frames import one_row, union_all
from martloom.operators.typing import first_values, infer_types
from martloom.session import run_together

SAMPLE_VALUES = 5
# Parts of the rows whose first places bound the samples.
SAMPLE_PARTS = 64

# The exact form that counts only what may be a key. A sketch errs by 5% (one standard deviation), so a
# unique column falls below this share of its rows once in millions.
CANDIDATES = "candidates"
NEARLY_UNIQUE = 0.75

# Longer texts are told apart by their SHA-256, so the shuffle carries 32 bytes and not the text.
DIGEST_FROM = 64


def value_key(value: Column, data_type: T.DataType) -> Column:
    """Short stand-in for a display string; equal exactly when the strings are."""
    text = display(value, data_type)
    if isinstance(data_type, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return F.when(F.length(text) >= DIGEST_FROM, F.concat(F.lit("\u0000"), F.sha2(text, 256))).otherwise(text)
    return text


def typed_key(value: Column, data_type: T.DataType) -> tuple[Column, Column, Column]:
    """The value as a whole number, a real number or a text, whichever keeps it apart most cheaply."""
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint"), real, text
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return whole, F.nanvl(value.cast("double"), F.lit(None).cast("double")), text  # NaN is a missing value
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return whole, real, value.cast("string")
    if isinstance(data_type, (T.ArrayType, T.StructType)) and "map<" not in data_type.simpleString():
        return whole, real, F.sha2(F.to_json(value), 256)
    return whole, real, value_key(value, data_type)


def long_form(df: DataFrame) -> DataFrame:
    """(ordinal, whole, real, text) rows, one per cell; at most one of the three is not NULL."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        cells += [F.lit(i), *typed_key(col(f.name), f.dataType)]
    return df.select(F.stack(F.lit(len(df.columns)), *cells).alias("ordinal", "whole", "real", "text"))


def column_counts(df: DataFrame, exact: bool | str = True, named: Sequence[str] = ()) -> DataFrame:
    """(ordinal, row_count, nulls, distinct_count) per column.

    Exact counts take one shuffle of (ordinal, value) pairs that were combined on the map side;
    the second aggregation starts from distinct pairs and moves one row per task and column.
    ``exact=False`` keeps one sketch per column instead and shuffles only those. ``exact=CANDIDATES`` keeps
    sketches too, and then counts exactly the columns that they show to be nearly unique, which may be
    keys, and the ``named`` ones: rows, nulls and what is unique are exact for all columns, and the shuffle is
    that of the candidates.
    """
    if exact == CANDIDATES:
        return _candidate_counts(df, named)
    if exact:
        cells = long_form(df).groupBy("ordinal", "whole", "real", "text").agg(F.count("*").alias("n"))
        filled = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
        counted = cells.select("ordinal", "n", filled.alias("filled")).unionAll(_no_cells(df))
        return counted.groupBy("ordinal").agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(F.col("filled"), F.lit(0)).otherwise(F.col("n"))).alias("nulls"),
            F.count_if("filled").alias("distinct_count"),
        )
    stats = []
    for i, f in enumerate(df.schema.fields):
        value = _no_nan(col(f.name), f.dataType)
        counted = value_key(value, f.dataType) if isinstance(f.dataType, T.MapType) else value
        stats.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.count("*").alias("row_count"),
                F.count_if(value.isNull()).alias("nulls"),
                F.approx_count_distinct(counted).alias("distinct_count"),
            )
        )
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def _candidate_counts(df: DataFrame, named: Sequence[str]) -> DataFrame:
    sketched = column_counts(df, False).collect()  # a row per column
    chosen = [r["ordinal"] for r in sketched if df.columns[r["ordinal"]] in named or 0 < NEARLY_UNIQUE * (r["row_count"] - r["nulls"]) <= r["distinct_count"]]
    rest = [tuple(r) for r in sketched if r["ordinal"] not in chosen]
    found = df.sparkSession.createDataFrame(rest, "ordinal int, row_count bigint, nulls bigint, distinct_count bigint")
    if not chosen:
        return found
    counted = column_counts(df.select(*(col(df.columns[i]) for i in sorted(chosen))))
    places = F.element_at(F.array(*(F.lit(i) for i in sorted(chosen))), F.col("ordinal") + 1)
    return found.unionByName(counted.withColumn("ordinal", places))


def profile(
    df: DataFrame,
    source: str,
    sample_rows: int = 0,
    order_by: str | None = None,
    samples: bool = False,
    exact: bool | str = True,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Catalogue rows of one source, a row per column.

    All rows count by default; ``sample_rows`` profiles the first rows only.  The columns of an
    empty source are reported with zero rows and no nulls.
    """
    if sample_rows:
        df = (df.orderBy(col(order_by)) if order_by else df).limit(sample_rows)
    types = types or infer_types(df, order_by)
    names = F.array(*[F.lit(n) for n in df.columns])
    kinds = F.array(*[F.lit(types[n]) for n in df.columns])
    share = F.col("nulls") / F.nullif(F.col("row_count"), F.lit(0))
    result = column_counts(df, exact).select(
        F.lit(source).alias("source_file"),
        "ordinal",
        F.get(names, "ordinal").alias("column_name"),
        F.get(kinds, "ordinal").alias("inferred_type"),
        F.bround(F.coalesce(share, F.lit(0.0)), 4).alias("null_pct"),
        "distinct_count",
        "row_count",
    )
    if samples:
        taken = sample_values(df, order_by).withColumnRenamed("column_name", "sampled_column")
        result = result.join(taken, F.col("column_name") == F.col("sampled_column"), "left").drop("sampled_column")
        result = result.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    return result


def sample_values(df: DataFrame, order_by: str | None = None, count: int = SAMPLE_VALUES) -> DataFrame:
    """The first non-null values of every column as text, repeats included; NaN is no value.

    In scan order a column is a limit, which reads no further than it must. By ``order_by`` there
    are two passes for all columns together: rows are dealt to ``SAMPLE_PARTS`` parts by the hash of their
    place, and the ``count`` smallest of the parts' first places bound those of the samples; the
    second pass reads up to there, which is little more than the samples.
    """
    values = [_no_nan(col(f.name), f.dataType) for f in df.schema.fields]
    if order_by is None:
        plain = df.select(*(v.alias(f.name) for v, f in zip(values, df.schema.fields, strict=True)))
        return union_all([_listed(_first_in_scan(plain, f, count)) for f in df.schema.fields])
    place = col(order_by)
    part = F.pmod(F.xxhash64(place), F.lit(SAMPLE_PARTS)).alias("part")
    firsts = df.groupBy(part).agg(*(F.min(F.when(v.isNotNull(), place)).alias(f"m{i}") for i, v in enumerate(values)))
    bounds = firsts.agg(*(F.get(F.array_sort(F.collect_list(f"m{i}")), F.lit(count - 1)) for i in range(len(values)))).first()
    cells = []
    for f, value, bound in zip(df.schema.fields, values, bounds, strict=True):
        cell = F.struct(F.lit(f.name).alias("column_name"), place.alias("ord"), display(value, f.dataType).alias("value"))
        early = value.isNotNull()
        if bound is not None:
            early &= place.isNull() | (place <= F.lit(bound))
        cells.append(F.when(early, cell))
    if all(bound is not None for bound in bounds):
        df = df.where(place.isNull() | (place <= F.lit(max(bounds))))
    first = W.partitionBy("column_name").orderBy("ord")
    near = df.select(F.inline(F.array_compact(F.array(*cells)))).withColumn("place", F.row_number().over(first))
    return _listed(near.where(F.col("place") <= count).select("column_name", F.col("place").alias("ord"), "value"))


def _first_in_scan(df: DataFrame, f: T.StructField, count: int) -> DataFrame:
    text = display(F.col("value"), f.dataType).alias("value")
    return first_values(df, f.name, count).select(F.lit(f.name).alias("column_name"), F.monotonically_increasing_id().alias("ord"), text)


def _listed(firsts: DataFrame) -> DataFrame:
    """A list per column of its few (ord, value) rows."""
    listed = firsts.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("firsts"))
    return listed.select("column_name", F.col("firsts.value").alias("sample_values"))


def _no_nan(value: Column, data_type: T.DataType) -> Column:
    return F.nanvl(value, F.lit(None).cast(data_type)) if isinstance(data_type, (T.DoubleType, T.FloatType)) else value


CATALOGUE = "source_file string, ordinal int, column_name string, inferred_type string, null_pct double, distinct_count bigint, row_count bigint"
SAMPLES = ", sample_values array<string>"


def profile_all(frames: dict[str, DataFrame], order_by: dict[str, str] | None = None, **options) -> DataFrame:
    """The catalogue of several sources; their types are inferred at the same time.

    ``order_by`` names the column that numbers a source's rows, by source.
    """
    orders = order_by or {}
    parts = run_together([partial(profile, df, name, order_by=orders.get(name), **options) for name, df in frames.items()])
    return union_all(parts, SparkSession.active(), CATALOGUE + (SAMPLES if options.get("samples") else ""))


def _no_cells(df: DataFrame) -> DataFrame:
    """A cell without rows per column, so that an empty source has its columns too."""
    ordinals = F.explode(F.sequence(F.lit(0), F.lit(len(df.columns) - 1)))
    rows = one_row(df.sparkSession).select(ordinals.alias("ordinal"))
    return rows.select("ordinal", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("filled"))
