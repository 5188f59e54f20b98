"""The target model over the given tables: specs, Spark frames, and the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from martloom.session import scratch_path
from martloom.spec import Relationship, TableSpec, table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# target table: (given table, [(target column, declared type, given column)])
COLUMNS = {
    "region": ("region", [("region_id", "INTEGER", "r_regionkey"), ("region_name", "TEXT", "r_name")]),
    "nation": (
        "nation",
        [("nation_id", "INTEGER", "n_nationkey"), ("nation_name", "TEXT", "n_name"), ("region_id", "INTEGER", "n_regionkey")],
    ),
    "customer": (
        "customer",
        [
            ("customer_id", "INTEGER", "c_custkey"),
            ("full_name", "TEXT", "c_name"),
            ("segment", "TEXT", "c_mktsegment"),
            ("balance", "REAL", "c_acctbal"),
            ("nation_id", "INTEGER", "c_nationkey"),
        ],
    ),
    "supplier": (
        "supplier",
        [
            ("supplier_id", "INTEGER", "s_suppkey"),
            ("supplier_name", "TEXT", "s_name"),
            ("balance", "REAL", "s_acctbal"),
            ("nation_id", "INTEGER", "s_nationkey"),
        ],
    ),
    "product": (
        "part",
        [
            ("product_id", "INTEGER", "p_partkey"),
            ("product_name", "TEXT", "p_name"),
            ("brand", "TEXT", "p_brand"),
            ("price", "REAL", "p_retailprice"),
        ],
    ),
    "order": (
        "orders",
        [
            ("order_id", "INTEGER", "o_orderkey"),
            ("customer_id", "INTEGER", "o_custkey"),
            ("status", "TEXT", "o_orderstatus"),
            ("price", "REAL", "o_totalprice"),
            ("order_date", "TEXT", "o_orderdate"),
        ],
    ),
    "line": (
        "lineitem",
        [
            ("order_id", "INTEGER", "l_orderkey"),
            ("product_id", "INTEGER", "l_partkey"),
            ("supplier_id", "INTEGER", "l_suppkey"),
            ("line_no", "INTEGER", "l_linenumber"),
            ("quantity", "REAL", "l_quantity"),
            ("price", "REAL", "l_extendedprice"),
        ],
    ),
    "event": (
        "events",
        [
            ("event_id", "INTEGER", "event_id"),
            ("customer_id", "INTEGER", "user_id"),
            ("event_type", "TEXT", "event_type"),
            ("value", "REAL", "value"),
            ("props", "TEXT", "props"),
        ],
    ),
    "document": (
        "documents",
        [
            ("doc_id", "INTEGER", "doc_id"),
            ("text", "TEXT", "text"),
            ("lang", "TEXT", "lang"),
            ("source", "TEXT", "source"),
            ("n_chars", "INTEGER", "n_chars"),
        ],
    ),
    "label": (
        "labels",
        [("doc_id", "INTEGER", "doc_id"), ("quality", "INTEGER", "quality"), ("toxic", "INTEGER", "toxic")],
    ),
}

PRIMARY_KEYS = {
    "region": "region_id", "nation": "nation_id", "customer": "customer_id", "supplier": "supplier_id",
    "product": "product_id", "order": "order_id", "event": "event_id", "document": "doc_id",
}
NOT_NULL = {"product": ["product_name"], "order": ["customer_id", "status"], "line": ["order_id"]}
FOREIGN_KEYS = {
    "nation": {"region_id": ("region", "region_id")},
    "customer": {"nation_id": ("nation", "nation_id")},
    "supplier": {"nation_id": ("nation", "nation_id")},
    "order": {"customer_id": ("customer", "customer_id")},
    "line": {
        "order_id": ("order", "order_id"),
        "product_id": ("product", "product_id"),
        "supplier_id": ("supplier", "supplier_id"),
    },
    "event": {"customer_id": ("customer", "customer_id")},
    "label": {"doc_id": ("document", "doc_id")},
}

SPECS: dict[str, TableSpec] = {
    name: table(
        name,
        [(column, sql_type) for column, sql_type, _ in columns],
        primary_key=PRIMARY_KEYS.get(name, ()),
        not_null=NOT_NULL.get(name, ()),
        foreign_keys=FOREIGN_KEYS.get(name),
    )
    for name, (_, columns) in COLUMNS.items()
}

RELATIONSHIPS = [
    Relationship(name, fk.columns, fk.ref_table, fk.ref_columns, "declared_fk")
    for name, spec in SPECS.items()
    for fk in spec.foreign_keys
]


_SCHEMAS: dict[str, T.StructType] = {}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def target(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under target names, types as given."""
    source, columns = COLUMNS[name]
    return given(spark, sf_dir, source).select(*[F.col(c).alias(t) for t, _, c in columns])


def targets(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return {name: target(spark, sf_dir, name) for name in names or COLUMNS}


def target_sql(name: str) -> str:
    source, columns = COLUMNS[name]
    return f"select {', '.join(f'{c} as {t}' for t, _, c in columns)} from {source}"


def staged_sql(name: str, relation: str | None = None) -> str:
    """SQL of a staging model over a given table or another relation with target names."""
    source, columns = COLUMNS[name]
    items = []
    for alias, sql_type, given_name in columns:
        value = alias if relation else given_name
        if sql_type == "INTEGER":
            items.append(f"cast({value} as bigint) as {alias}")
        elif sql_type == "REAL":
            items.append(f"cast({value} as double) as {alias}")
        else:
            items.append(f"nullif(trim(cast({value} as varchar), ' '), '') as {alias}")
    return f"select {', '.join(items)} from {relation or source}"


def with_sql(views: dict[str, str], body: str) -> str:
    """A query over named sub-queries."""
    return "with " + ", ".join(f'"{name}" as ({sql})' for name, sql in views.items()) + " " + body


def write_source(df: DataFrame, name: str, fmt: str) -> str:
    """Write rows as a source folder of part files and return its path."""
    path = f"{scratch_path(df.sparkSession, 'source')}/{name}.{fmt}"
    writer = df.write
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        writer.json(path)
    return path
