"""Staging, mart and enriched models; casts and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from martloom.functions.casts import STRICT, clean_text, to_integer, to_real
from martloom.plans.models import (
    build_enriched,
    build_mart,
    build_staging,
    register_staging,
    staging_name,
    write_mart,
)
from martloom.session import scratch_path
from martloom.spec import Relationship, table
from registry.model import RELATIONSHIPS, SPECS, given, staged_sql, target, targets, with_sql


def staging_of(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return register_staging(build_staging(target(spark, sf_dir, name), SPECS[name]), name)

    return query


def mart_of(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_staging(build_staging(target(spark, sf_dir, name), SPECS[name]), name)
        mart = build_mart(spark.table(staging_name(name)))
        return write_mart(spark, mart, f"mart_{name}", scratch_path(spark, "marts"))

    return query


def enriched_of(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        links = [r for r in RELATIONSHIPS if r.child_table == name]
        needed = dict.fromkeys([name, *(r.parent_table for r in links)])
        staging = {n: build_staging(df, SPECS[n]) for n, df in targets(spark, sf_dir, needed).items()}
        return build_enriched(SPECS[name], links, SPECS, staging)

    return query


def enriched_sql(name: str, child_sql: str | None = None) -> str:
    links = [r for r in RELATIONSHIPS if r.child_table == name]
    views = {"child": child_sql or staged_sql(name)}
    columns = [f"c.{c}" for c in SPECS[name].column_names]
    joins = []
    for i, link in enumerate(links):
        parent, key = link.parent_table, link.parent_columns[0]
        views[f"stg_{parent}"] = staged_sql(parent)
        columns += [f"p{i}.{c} as {parent}_{c}" for c in SPECS[parent].column_names if c != key]
        joins.append(f'left join "stg_{parent}" p{i} on c.{link.child_columns[0]} = p{i}.{key}')
    return with_sql(views, f"select {', '.join(columns)} from child c {' '.join(joins)}")


def mart_line_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parents; returned lines point at products that do not exist."""
    frames = targets(spark, sf_dir, ["line", "order", "product", "supplier"])
    lines = given(spark, sf_dir, "lineitem")
    frames["line"] = lines.withColumn(
        "l_partkey", F.when(F.col("l_returnflag") == "R", -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    ).select(*[F.col(c).alias(t) for t, c in LINE_COLUMNS])
    staging = {n: build_staging(df, SPECS[n]) for n, df in frames.items()}
    return build_enriched(SPECS["line"], [r for r in RELATIONSHIPS if r.child_table == "line"], SPECS, staging)


TALKS = [
    table("talk", "conv_id INTEGER, turn INTEGER, role TEXT, text TEXT", foreign_keys={("turn", "role"): ("slot", ("turn", "role"))}),
    table("slot", "turn INTEGER, role TEXT, talks INTEGER", ["turn", "role"]),
]


def mart_conversation_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined on a composite key of which few values hold all rows, in the way of parents too large to broadcast."""
    talks = given(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").cast("bigint"), "role", "text")
    slots = talks.where("role <> 'user'").groupBy("turn", "role").agg(F.count("*").alias("talks"))
    links = [Relationship("talk", ("turn", "role"), "slot", ("turn", "role"), "declared_fk")]
    return build_enriched(TALKS[0], links, {t.name: t for t in TALKS}, {"talk": talks, "slot": slots}, small_parent=-1)


LINE_COLUMNS = [
    ("order_id", "l_orderkey"), ("product_id", "l_partkey"), ("supplier_id", "l_suppkey"),
    ("line_no", "l_linenumber"), ("quantity", "l_quantity"), ("price", "l_extendedprice"),
]
ORPHAN_LINES_SQL = (
    "select l_orderkey as order_id, case when l_returnflag = 'R' then -1 - l_partkey else l_partkey end as product_id, "
    "l_suppkey as supplier_id, cast(l_linenumber as bigint) as line_no, l_quantity as quantity, "
    "l_extendedprice as price from lineitem"
)


def clean_cast_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer casts of texts that are, start with, or are not numbers."""
    text, real = T.StringType(), T.DoubleType()
    padded = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))
    signed = F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit(".7x"))
    return given(spark, sf_dir, "orders").select(
        "o_orderkey",
        to_integer(F.col("o_orderpriority"), text).alias("priority_lenient"),
        to_integer(F.col("o_orderpriority"), text, STRICT).alias("priority_strict"),
        to_integer(F.col("o_orderstatus"), text).alias("status_lenient"),
        to_integer(F.col("o_orderstatus"), text, STRICT).alias("status_strict"),
        to_integer(padded, text).alias("padded_lenient"),
        to_integer(padded, text, STRICT).alias("padded_strict"),
        to_integer(signed, text).alias("signed_lenient"),
        to_integer(signed, text, STRICT).alias("signed_strict"),
        to_integer(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), text).alias("null_lenient"),
        to_integer(F.col("o_totalprice"), real).alias("price_integer"),
    )


def clean_cast_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real casts of texts that are, start with, or are not numbers."""
    text = T.StringType()
    sized = F.concat(F.col("p_size").cast("string"), F.lit(".5x"))
    power = F.concat(F.col("p_size").cast("string"), F.lit("e2"))
    return given(spark, sf_dir, "part").select(
        "p_partkey",
        to_real(F.col("p_brand"), text).alias("brand_lenient"),
        to_real(F.col("p_brand"), text, STRICT).alias("brand_strict"),
        to_real(sized, text).alias("sized_lenient"),
        to_real(sized, text, STRICT).alias("sized_strict"),
        to_real(power, text).alias("power_lenient"),
        to_real(power, text, STRICT).alias("power_strict"),
        to_real(F.nullif(F.col("p_brand"), F.lit("Brand#11")), text).alias("null_lenient"),
        to_real(F.col("p_size"), T.IntegerType()).alias("size_real"),
    )


def clean_text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded names, blanked segments, tabs that stay, and numbers as text."""
    text = T.StringType()
    blanked = F.when(F.col("c_mktsegment") == "BUILDING", "   ").otherwise(F.col("c_mktsegment"))
    return given(spark, sf_dir, "customer").select(
        "c_custkey",
        clean_text(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")), text).alias("name"),
        clean_text(blanked, text).alias("segment"),
        clean_text(F.concat(F.lit("\t"), F.col("c_name")), text).alias("tabbed"),
        clean_text(F.col("c_acctbal"), T.DoubleType()).alias("balance"),
        clean_text(F.col("c_acctbal") * 100000, T.DoubleType()).alias("large_balance"),
        clean_text(F.col("c_nationkey"), T.IntegerType()).alias("nation"),
    )


QUERIES = {f"stg_{name}": staging_of(name) for name in SPECS}
QUERIES |= {f"mart_{name}": mart_of(name) for name in ("order", "customer", "product")}
QUERIES |= {f"mart_{name}_enriched": enriched_of(name) for name in ("order", "customer", "supplier", "nation", "event", "label")}
QUERIES |= {
    "mart_line_enriched": mart_line_enriched,
    "mart_conversation_skew": mart_conversation_skew,
    "clean_cast_int": clean_cast_int,
    "clean_cast_real": clean_cast_real,
    "clean_text": clean_text_values,
}


def _int_prefix(value: str) -> str:
    prefix = f"regexp_extract({value}, '^\\s*([+-]?[0-9]+)', 1)"
    return f"case when {value} is not null then coalesce(try_cast({prefix} as bigint), 0) end"


def _int_whole(value: str) -> str:
    return f"case when regexp_full_match({value}, '\\s*[+-]?[0-9]+\\s*') then cast(trim({value}) as bigint) end"


REAL_FORM = "[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _real_prefix(value: str) -> str:
    prefix = f"regexp_extract({value}, '^\\s*({REAL_FORM})', 1)"
    return f"case when {value} is not null then coalesce(try_cast({prefix} as double), 0.0::double) end"


def _real_whole(value: str) -> str:
    return f"case when regexp_full_match({value}, '\\s*{REAL_FORM}\\s*') then cast(trim({value}) as double) end"


ORACLES = {f"stg_{name}": staged_sql(name) for name in SPECS}
ORACLES |= {f"mart_{name}": staged_sql(name) for name in ("order", "customer", "product")}
ORACLES |= {
    f"mart_{name}_enriched": enriched_sql(name) for name in ("order", "customer", "supplier", "nation", "event", "label")
}
ORACLES |= {
    "mart_line_enriched": enriched_sql("line", ORPHAN_LINES_SQL),
    "mart_conversation_skew": """
        with slots as (select turn, role, count(*) as talks from conversations where role <> 'user' group by turn, role)
        select conv_id, cast(turn as bigint) as turn, role, text, talks as slot_talks from conversations left join slots using (turn, role)""",
    "clean_cast_int": f"""
        with t as (
            select *, ' ' || o_custkey || ' ' as padded, '-' || o_custkey || '.7x' as signed,
                nullif(o_orderpriority, '5-LOW') as nulled
            from orders)
        select o_orderkey,
            {_int_prefix('o_orderpriority')} as priority_lenient, {_int_whole('o_orderpriority')} as priority_strict,
            {_int_prefix('o_orderstatus')} as status_lenient, {_int_whole('o_orderstatus')} as status_strict,
            {_int_prefix('padded')} as padded_lenient, {_int_whole('padded')} as padded_strict,
            {_int_prefix('signed')} as signed_lenient, {_int_whole('signed')} as signed_strict,
            {_int_prefix('nulled')} as null_lenient, cast(trunc(o_totalprice) as bigint) as price_integer
        from t""",
    "clean_cast_real": f"""
        with t as (
            select *, p_size || '.5x' as sized, p_size || 'e2' as power, nullif(p_brand, 'Brand#11') as nulled from part)
        select p_partkey,
            {_real_prefix('p_brand')} as brand_lenient, {_real_whole('p_brand')} as brand_strict,
            {_real_prefix('sized')} as sized_lenient, {_real_whole('sized')} as sized_strict,
            {_real_prefix('power')} as power_lenient, {_real_whole('power')} as power_strict,
            {_real_prefix('nulled')} as null_lenient, cast(p_size as double) as size_real
        from t""",
    "clean_text": r"""
        select c_custkey, nullif(trim('  ' || c_name || ' ', ' '), '') as name,
            nullif(trim(case when c_mktsegment = 'BUILDING' then '   ' else c_mktsegment end, ' '), '') as segment,
            nullif(trim(chr(9) || c_name, ' '), '') as tabbed,
            cast(c_acctbal as varchar) as balance, cast(c_acctbal * 100000 as varchar) as large_balance,
            cast(c_nationkey as varchar) as nation
        from customer""",
}
