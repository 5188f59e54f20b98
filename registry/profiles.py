"""Profiles, inferred types, proposed keys, relationships and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.operators.discovery import (
    infer_relationships,
    propose_fks,
    propose_pks,
    propose_schema,
    relationship_frame,
)
from martloom.operators.matching import NAME_WEIGHT, OVERLAP_WEIGHT, THRESHOLD, column_overlap, propose_mappings, proposed_list
from martloom.operators.frames import union_all
from martloom.operators.profiling import CANDIDATES, column_counts, profile, profile_all, sample_values
from martloom.operators.typing import infer_types
from martloom.session import stage
from martloom.spec import table
from registry.checking import DEFECTIVE_SQL, defective, nulled_orders
from registry.model import COLUMNS, SPECS, TABLES, given, target, target_sql, targets, with_sql

# Logical types of the given tables' columns; every column not listed is text.
TYPES = {
    "integer": (
        "r_regionkey n_nationkey n_regionkey c_custkey c_nationkey s_suppkey s_nationkey p_partkey p_size o_orderkey "
        "o_custkey l_orderkey l_partkey l_suppkey l_linenumber event_id user_id doc_id n_chars vec_id label page_id "
        "item_id quality toxic conv_id turn"
    ).split(),
    "float": (
        "c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value"
    ).split(),
    "date": "o_orderdate l_shipdate ts".split(),
}
GIVEN_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
        "l_linestatus l_shipdate"
    ),
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def partly_null_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders").withColumns(
        {
            "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("F")),
            "o_orderpriority": F.lit(None).cast("string"),
        }
    )


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(partly_null_orders(spark, sf_dir), "orders")


def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_all({name: given(spark, sf_dir, name) for name in TABLES})


UNIQUE_IN = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
}


def unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls and uniqueness of every column, counted exactly only where a sketch leaves it open."""
    parts = []
    for name, columns in UNIQUE_IN.items():
        counts = column_counts(given(spark, sf_dir, name).select(*columns), CANDIDATES)
        unique = F.col("distinct_count") == F.col("row_count") - F.col("nulls")
        column = F.get(F.array(*map(F.lit, columns)), "ordinal").alias("column_name")
        parts.append(counts.select(F.lit(name).alias("table_name"), column, "row_count", "nulls", unique.alias("is_unique")))
    return union_all(parts)


def profile_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(given(spark, sf_dir, "orders"), "orders", sample_rows=1000, order_by="o_orderkey")


def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = sample_values(given(spark, sf_dir, "customer"), order_by="c_custkey")
    return values.select("column_name", F.array_join("sample_values", " | ").alias("sample_values"))


# Sources and the column that numbers their rows.
NUMBERED = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}


def profile_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as the rules and a reader get it: types, counts and first values."""
    found = profile_all({name: given(spark, sf_dir, name) for name in NUMBERED}, order_by=NUMBERED, samples=True)
    return found.withColumn("sample_values", F.array_join("sample_values", " | "))


def mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text copies of columns of every logical type, some with nulls or stray values."""
    text = given(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("whole"),
        F.col("o_totalprice").cast("string").alias("decimal"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("flag"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderdate").cast("string").alias("moment"),
        F.col("o_orderpriority").alias("word"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("whole_or_null"),
        F.when(F.col("o_orderstatus") == "P", "n/a?").otherwise(F.col("o_custkey").cast("string")).alias("whole_or_word"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return text


def infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infer_types(mixed_texts(spark, sf_dir), order_by="o_orderkey")
    return spark.createDataFrame(list(found.items()), "column_name string, inferred_type string")


def file_name(name: str) -> str:
    return f"source1_{name}.csv"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = targets(spark, sf_dir) | {"order": nulled_orders(spark, sf_dir)}
    # stored once: the rules read the few catalogue rows several times
    return stage(profile_all({file_name(name): df for name, df in frames.items()}), "catalog")


def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propose_pks(catalog(spark, sf_dir))


def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propose_schema(catalog(spark, sf_dir))


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = targets(spark, sf_dir) | {"order": nulled_orders(spark, sf_dir)}
    return propose_fks(catalog(spark, sf_dir), {file_name(n): df for n, df in frames.items()})


# No declared keys but one; the customers' key has a name of its own.
NAMED_SPECS = [
    table("line", "order_id INTEGER, product_id INTEGER, supplier_id INTEGER, line_no INTEGER"),
    table("order", "order_id INTEGER, customer_id INTEGER, price REAL", "order_id"),
    table("customers", "cust_key INTEGER, full_name TEXT, nation_id INTEGER", "cust_key"),
    table("product", "product_id INTEGER, price REAL", "product_id"),
    table("supplier", "supplier_id INTEGER, nation_id INTEGER", "supplier_id"),
    table(
        "nation", "nation_id INTEGER, region_id INTEGER", "nation_id", foreign_keys={"region_id": ("region", "region_id")}
    ),
    table("region", "region_id INTEGER", "region_id"),
]


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = defective(spark, sf_dir)
    frames["customers"] = frames["customer"].withColumnRenamed("customer_id", "cust_key")
    return relationship_frame(infer_relationships(NAMED_SPECS), frames)


def _matching(spark: SparkSession, sf_dir: str):
    sources = {f"{n}.csv": given(spark, sf_dir, n) for n in ("orders", "customer")}
    return sources, targets(spark, sf_dir, ["order", "customer"])


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_overlap(*_matching(spark, sf_dir))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propose_mappings(*_matching(spark, sf_dir))


# Two columns of one file hold the customers' keys: the reference takes that of the key it refers to.
LINKED_SPECS = [
    table("customers", "cust_key INTEGER, segment TEXT", "cust_key"),
    table("order", "order_id INTEGER, customer_id INTEGER, price REAL", "order_id", foreign_keys={"customer_id": ("customers", "cust_key")}),
]


def propose_mappings_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with orders and their customers, mapped onto two linked tables."""
    orders, customers = given(spark, sf_dir, "orders"), given(spark, sf_dir, "customer")
    sales = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.col("c_custkey").alias("cust_key"), F.col("c_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"),
    )
    wanted = {
        "customers": customers.select(F.col("c_custkey").alias("cust_key"), F.col("c_mktsegment").alias("segment")),
        "order": target(spark, sf_dir, "order").select("order_id", "customer_id", "price"),
    }
    found = proposed_list(propose_mappings({"sales.csv": sales}, wanted), LINKED_SPECS)
    schema = "target_table string, target_column string, source_file string, source_column string, confidence double, reason string"
    rows = [(m.target_table, m.target_column, m.source_file, m.source_column, m.confidence, m.reason) for m in found]
    return spark.createDataFrame(rows, schema)


def propose_fks_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a common key: an empty proposal."""
    frames = {"benchmark.csv": given(spark, sf_dir, "benchmark"), "region.csv": given(spark, sf_dir, "region")}
    return propose_fks(stage(profile_all(frames), "catalog"), frames)


QUERIES = {
    "propose_fks_none": propose_fks_none,
    "profile_columns": profile_columns,
    "profile_all": profile_tables,
    "unique_columns": unique_columns,
    "profile_sampled": profile_sampled,
    "profile_samples": profile_samples,
    "profile_catalog": profile_catalog,
    "infer_types": infer,
    "propose_pks": primary_keys,
    "propose_schema": schema,
    "propose_fks": foreign_keys,
    "infer_relationships": relationships,
    "column_overlap": overlap,
    "propose_mappings": mappings,
    "propose_mappings_fk": propose_mappings_fk,
}


def _profile_sql(source: str, relation: str, columns: list[str], types: dict[str, str] | None = None) -> str:
    parts = []
    for i, c in enumerate(columns):
        kind = (types or {}).get(c) or next((k for k, names in TYPES.items() if c in names), "string")
        parts.append(
            f"select '{source}' as source_file, {i} as ordinal, '{c}' as column_name, '{kind}' as inferred_type, "
            f"round_even(count(*) filter (where {c} is null) / count(*), 4) as null_pct, "
            f'count(distinct {c}) as distinct_count, count(*) as row_count from "{relation}"'
        )
    return " union all ".join(parts)


def _samples_sql(relation: str, key: str) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, string_agg(v, ' | ' order by k) as sample_values from "
        f"(select cast({c} as varchar) as v, {key} as k from {relation} where {c} is not null order by k limit 5)"
        for c in GIVEN_COLUMNS[relation].split()
    )


def _catalog_sql() -> str:
    """Measured columns of the target model: nulls and distinct values."""
    kinds = {"INTEGER": "INTEGER", "REAL": "REAL", "TEXT": "TEXT"}
    return " union all ".join(
        f"select '{file_name(name)}' as source_file, '{name}' as table_name, {i} as ordinal, '{c.name}' as column_name, "
        f"'{kinds[c.sql_type]}' as sql_type, count(*) as n, count({c.name}) as filled, count(distinct {c.name}) as d "
        f'from "{name}"'
        for name, spec in SPECS.items()
        for i, c in enumerate(spec.columns)
    )


NULLED_SQL = {n: target_sql(n) for n in SPECS} | {"order": DEFECTIVE_SQL["order"]}
KEYS_SQL = """
    keys as (select source_file, table_name, column_name, round(d / n, 4) as unique_ratio
             from (select *, row_number() over (partition by source_file order by ordinal) as place
                   from columns where column_name like '%id' and n = filled and d > 0)
             where place = 1)"""


def _fk_candidates() -> list[tuple[str, str, str]]:
    keys = {n: next(c for c in spec.column_names if c.endswith("id")) for n, spec in SPECS.items()}
    files = sorted(keys, key=file_name)
    found = []
    for child in files:
        for c in SPECS[child].column_names:
            parent = next((p for p in files if p != child and keys[p] == c), None)
            if parent:
                found.append((child, c, parent))
    return found


def _inclusion_sql(child: str, column: str, parent: str, key: str, labels: str) -> str:
    found = f'{column} in (select {key} from "{parent}" where {key} is not null)'
    return f"""select {labels} count(*) as child_rows, count(*) filter (where {found}) as matched_rows,
        round(count(*) filter (where {found}) / count(*), 4) as inclusion from "{child}" where {column} is not null"""


def _fks_sql() -> str:
    return with_sql(
        NULLED_SQL,
        " union all ".join(
            _inclusion_sql(
                child,
                column,
                parent,
                column,
                f"'{child}' as child_table, '{column}' as child_column, '{parent}' as parent_table, "
                f"'{column}' as parent_column,",
            )
            for child, column, parent in _fk_candidates()
        ),
    )


def _relationships_sql() -> str:
    edges = [
        ("nation", "region_id", "region", "region_id", "declared_fk"),
        ("line", "order_id", "order", "order_id", "inferred_name_match"),
        ("line", "product_id", "product", "product_id", "inferred_name_match"),
        ("line", "supplier_id", "supplier", "supplier_id", "inferred_name_match"),
        ("order", "customer_id", "customers", "cust_key", "inferred_name_match"),
        ("customers", "nation_id", "nation", "nation_id", "inferred_name_match"),
        ("supplier", "nation_id", "nation", "nation_id", "inferred_name_match"),
    ]
    views = DEFECTIVE_SQL | {"customers": "select c_custkey as cust_key, c_nationkey as nation_id from customer"}
    views = {k: v for k, v in views.items() if k != "customer"}
    body = " union all ".join(
        _inclusion_sql(
            child,
            column,
            parent,
            key,
            f"'{child}' as child_table, '{column}' as child_column, '{parent}' as parent_table, '{key}' as parent_column, "
            f"'{source}' as source,",
        )
        for child, column, parent, key, source in edges
    )
    return with_sql(views, f"select * exclude (child_rows, matched_rows) from ({body})")


def _values_sql(pairs: list[tuple[str, str, str]], relation: str) -> str:
    return " union ".join(
        f"select '{label}' as t, '{alias}' as c, cast({column} as varchar) as v from {relation} where {column} is not null"
        for label, alias, column in pairs
    )


def _overlap_views() -> dict[str, str]:
    sources, wanted = [], []
    for name in ("orders", "customer"):
        sources.append(_values_sql([(f"{name}.csv", c, c) for c in GIVEN_COLUMNS[name].split()], name))
    for name in ("order", "customer"):
        source, columns = COLUMNS[name]
        wanted.append(_values_sql([(name, t, c) for t, _, c in columns], source))
    return {"s": " union ".join(sources), "t": " union ".join(wanted)} | _shared_views()


def _shared_views() -> dict[str, str]:
    """Overlaps of the values ``s`` of sources and ``t`` of targets."""
    return {
        "sn": "select t, c, count(*) as d from s group by t, c",
        "tn": "select t, c, count(*) as d from t group by t, c",
        "shared": (
            "select s.t as st, s.c as sc, t.t as tt, t.c as tc, count(*) as shared from s join t using (v) group by all"
        ),
        "overlap": """
            select st as source_table, sc as source_column, tt as target_table, tc as target_column, shared,
                round(shared / sn.d, 4) as overlap, round(shared / (sn.d + tn.d - shared), 4) as likeness
            from shared join sn on sn.t = st and sn.c = sc join tn on tn.t = tt and tn.c = tc""",
    }


def _mappings_sql() -> str:
    wanted = " union all ".join(
        f"select '{n}' as target_table, '{t}' as target_column" for n in ("order", "customer") for t, _, _ in COLUMNS[n][1]
    )
    return with_sql(
        _overlap_views() | _best_views(wanted),
        """select target_table, target_column, source_table as source_file, source_column,
               coalesce(confidence, 0.0::double) as confidence
           from wanted left join best using (target_table, target_column)""",
    )


def _best_views(wanted: str) -> dict[str, str]:
    """The best source column of every wanted column."""
    return {
        "wanted": wanted,
        "scored": f"""
            select *, 1 - levenshtein(lower(source_column), lower(target_column))
                    / greatest(length(source_column), length(target_column)) as alike,
                round({OVERLAP_WEIGHT}::double * likeness + {NAME_WEIGHT}::double * alike, 4) as confidence
            from overlap""",
        "best": f"""
            select * from scored where confidence >= {THRESHOLD}
            qualify row_number() over (partition by target_table, target_column
                order by confidence desc, source_table, source_column) = 1""",
    }


def _linked_sql() -> str:
    """The reference's own best column gives way to that of the key."""
    sales = "(select * from orders join customer on o_custkey = c_custkey)"
    held = [("order_id", "o_orderkey"), ("cust_key", "c_custkey"), ("customer_id", "c_custkey"), ("price", "o_totalprice"), ("segment", "c_mktsegment")]
    own = [("customers", "cust_key", "c_custkey"), ("customers", "segment", "c_mktsegment")]
    other = [("order", "order_id", "o_orderkey"), ("order", "customer_id", "o_custkey"), ("order", "price", "o_totalprice")]
    views = {
        "s": _values_sql([("sales.csv", alias, c) for alias, c in held], sales),
        "t": _values_sql(own, "customer") + " union " + _values_sql(other, "orders"),
    }
    wanted = " union all ".join(f"select '{t}' as target_table, '{c}' as target_column" for t, c, _ in own + other)
    return with_sql(
        views | _shared_views() | _best_views(wanted),
        """select w.target_table, w.target_column, source_table as source_file, source_column, confidence,
               case when w.target_column = 'customer_id' then 'same source as the referenced key'
                   else 'shared values and similar name' end as reason
           from wanted w join best b on b.target_table = case when w.target_column = 'customer_id' then 'customers' else w.target_table end
               and b.target_column = case when w.target_column = 'customer_id' then 'cust_key' else w.target_column end""",
    )


def _is(kind: str) -> str:
    value = "v"
    whole = f"regexp_full_match({value}, '\\s*[+-]?[0-9]+\\s*') and try_cast({value} as bigint) is not null"
    number = f"regexp_full_match({value}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')"
    return {"boolean": f"lower({value}) in ('true', 'false')", "integer": whole, "float": number}[kind]


def _infer_sql() -> str:
    columns = {
        "whole": "cast(o_orderkey as varchar)",
        "decimal": "cast(o_totalprice as varchar)",
        "flag": "case when o_orderstatus = 'F' then 'true' else 'false' end",
        "day": "strftime(o_orderdate, '%Y-%m-%d')",
        "moment": "cast(o_orderdate as varchar)",
        "word": "o_orderpriority",
        "whole_or_null": "case when o_orderstatus <> 'P' then cast(o_custkey as varchar) end",
        "whole_or_word": "case when o_orderstatus = 'P' then 'n/a?' else cast(o_custkey as varchar) end",
        "nothing": "cast(null as varchar)",
    }
    rows = " union all ".join(f"select '{c}' as c, o_orderkey as k, {v} as v from orders" for c, v in columns.items())
    return f"""
        with t as ({rows}),
        r as (select *, row_number() over (partition by c order by k) as place from t where v is not null),
        f as (select c, bool_and({_is('boolean')}) as b, bool_and({_is('integer')}) as i, bool_and({_is('float')}) as f,
                  bool_and(try_cast(v as timestamp) is not null) filter (where place <= 50) as d from r group by c)
        select 'o_orderkey' as column_name, 'integer' as inferred_type
        union all
        select names.c, case when b then 'boolean' when i then 'integer' when f then 'float' when d then 'date' else 'string' end
        from (select distinct c from t) names left join f on f.c = names.c"""


ORACLES = {
    "propose_fks_none": """
        select '' as child_table, '' as child_column, '' as parent_table, '' as parent_column, 0::bigint as child_rows,
            0::bigint as matched_rows, 0.0::double as inclusion from region where false""",
    "profile_columns": with_sql(
        {
            "o": "select * replace (nullif(o_orderstatus, 'F') as o_orderstatus, cast(null as varchar) as o_orderpriority) "
            "from orders"
        },
        _profile_sql("orders", "o", GIVEN_COLUMNS["orders"].split()),
    ),
    "profile_all": " union all ".join(_profile_sql(t, t, GIVEN_COLUMNS[t].split()) for t in TABLES),
    "unique_columns": " union all ".join(
        f"select '{name}' as table_name, '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as nulls, "
        f"count(distinct {c}) = count({c}) as is_unique from {name}"
        for name, columns in UNIQUE_IN.items()
        for c in columns
    ),
    "profile_sampled": with_sql(
        {"o": "select * from orders order by o_orderkey limit 1000"},
        _profile_sql("orders", "o", GIVEN_COLUMNS["orders"].split()),
    ),
    "profile_samples": _samples_sql("customer", "c_custkey"),
    "profile_catalog": " union all ".join(
        f"select * from ({_profile_sql(t, t, GIVEN_COLUMNS[t].split())}) left join ({_samples_sql(t, k)}) using (column_name)"
        for t, k in NUMBERED.items()
    ),
    "infer_types": _infer_sql(),
    "propose_pks": with_sql(NULLED_SQL, "").rstrip()
    + f", columns as ({_catalog_sql()}), {KEYS_SQL} select * from keys",
    "propose_schema": with_sql(NULLED_SQL, "").rstrip()
    + f""", columns as ({_catalog_sql()}), {KEYS_SQL}
        select c.table_name, c.ordinal, c.column_name, c.sql_type,
            own.column_name is null and c.n = c.filled as not_null, own.column_name is not null as primary_key,
            ref.table_name as ref_table, ref.column_name as ref_column
        from columns c
        left join keys own on own.table_name = c.table_name and own.column_name = c.column_name
        left join keys ref on ref.column_name = c.column_name and ref.table_name <> c.table_name
        qualify row_number() over (partition by c.table_name, c.ordinal order by ref.source_file) = 1""",
    "propose_fks": _fks_sql(),
    "infer_relationships": _relationships_sql(),
    "column_overlap": with_sql(_overlap_views(), "select * from overlap"),
    "propose_mappings": _mappings_sql(),
    "propose_mappings_fk": _linked_sql(),
}
