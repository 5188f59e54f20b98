"""Mapped projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.operators.mapping import Mapping, drop_empty, map_columns, select_mappings, without_failing
from registry.model import SPECS, given

FILE = "orders.csv"


def order_mapping(target: str, source: str | None, transformation: str | None = None) -> Mapping:
    return Mapping("order", target, FILE, source, transformation)


PLAIN = [
    order_mapping("order_id", "o_orderkey"),
    order_mapping("customer_id", "o_orderkey"),
    order_mapping("customer_id", "o_custkey"),  # the last mapping of a target counts
    order_mapping("status", "o_orderstatus"),
    order_mapping("price", "o_totalprice"),
    Mapping("order", "order_date", "other.csv", "o_orderdate"),
    Mapping("line", "order_id", FILE, "o_orderkey"),
    order_mapping("channel", None),
]


def project(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    chosen = select_mappings(mappings, "order", FILE)
    return drop_empty(map_columns(df, chosen, SPECS["order"]), chosen)


def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(given(spark, sf_dir, "orders"), PLAIN)


def map_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(
        given(spark, sf_dir, "orders"),
        [
            order_mapping("order_id", "o_orderkey", "o_orderkey * 2 + 1"),
            order_mapping("customer_id", "o_custkey", "o_custkey - o_orderkey"),
            order_mapping("status", "o_orderstatus", "o_orderstatus || '-' || o_orderpriority"),
            order_mapping("price", "o_totalprice", "o_totalprice / 100"),
            order_mapping("large", "o_totalprice", "o_totalprice > 100000 and o_orderstatus = 'O'"),
            order_mapping("label", "o_orderpriority", "upper(substring(o_orderpriority, 3))"),
        ],
    )


def map_expr_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that fail on some order, or that are none of a single row, give the plain column."""
    orders = given(spark, sf_dir, "orders")
    mappings = [
        order_mapping("order_id", "o_orderkey", "o_orderkey + 1"),
        order_mapping("customer_id", "o_custkey", "o_custkey % (o_orderkey % 7)"),
        order_mapping("status", "o_orderstatus", "o_orderstatus = 1"),
        order_mapping("price", "o_totalprice", "cast(o_orderpriority as double) + o_totalprice"),
        order_mapping("total", "o_totalprice", "sum(o_totalprice)"),
        order_mapping("place", "o_orderkey", "row_number() over (order by o_orderkey)"),
        order_mapping("word", "o_orderpriority", "explode(split(o_orderpriority, '-'))"),
        order_mapping("top", "o_custkey", "(select 1)"),
        order_mapping("share", "o_totalprice", "o_totalprice / (1 + o_orderkey % 7)"),
    ]
    return project(orders, without_failing(orders, mappings))


def map_expr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(
        given(spark, sf_dir, "orders"),
        [
            order_mapping("order_id", "o_orderkey", "no_such_column + 1"),
            order_mapping("customer_id", "o_custkey", "o_custkey +* 2"),
            order_mapping("status", "o_orderstatus", "no_such_function(o_orderstatus)"),
            order_mapping("price", "no_such_column", "also_missing * 2"),
        ],
    )


def map_missing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(
        given(spark, sf_dir, "orders"),
        [order_mapping("order_id", "o_orderkey"), order_mapping("status", "gone"), order_mapping("price", "gone_too")],
    )


def map_drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").withColumns(
        {
            "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("F")),
            "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
        }
    )
    return project(orders, [order_mapping("status", "o_orderstatus"), order_mapping("label", "o_orderpriority")])


QUERIES = {
    "map_project": map_project,
    "map_expr": map_expr,
    "map_expr_runtime": map_expr_runtime,
    "map_expr_fallback": map_expr_fallback,
    "map_missing_null": map_missing_null,
    "map_drop_all_null": map_drop_all_null,
}
ORACLES = {
    "map_project": (
        "select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_totalprice as price from orders"
    ),
    "map_expr": """
        select o_orderkey * 2 + 1 as order_id, o_custkey - o_orderkey as customer_id,
            o_orderstatus || '-' || o_orderpriority as status, o_totalprice / 100 as price,
            o_totalprice > 100000 and o_orderstatus = 'O' as large, upper(substring(o_orderpriority, 3)) as label
        from orders""",
    "map_expr_runtime": """
        select o_orderkey + 1 as order_id, o_custkey as customer_id, o_orderstatus as status, o_totalprice as price, o_totalprice as total,
            o_orderkey as place, o_orderpriority as word, o_custkey as top, o_totalprice / (1 + o_orderkey % 7) as share from orders""",
    "map_expr_fallback": """
        select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, cast(null as double) as price
        from orders""",
    "map_missing_null": (
        "select o_orderkey as order_id, cast(null as varchar) as status, cast(null as double) as price from orders"
    ),
    "map_drop_all_null": """
        select * from (select nullif(o_orderstatus, 'F') as status, nullif(o_orderpriority, '5-LOW') as label from orders)
        where status is not null or label is not null""",
}
