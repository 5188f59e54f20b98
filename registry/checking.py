"""Model tests, foreign keys, validation and the contract check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.operators.checks import derive_tests, inclusion, orphan_rows, run_tests
from martloom.operators.checks import NOT_NULL, RELATIONSHIPS as LINKS, UNIQUE, ModelTest
from martloom.operators.validation import contract_check, fk_report, validate_tables
from martloom.plans.models import build_staging
from martloom.spec import table
from registry.model import RELATIONSHIPS, SPECS, given, target, target_sql, targets, with_sql
from registry.models import ORPHAN_LINES_SQL

# Defects are made in the values, so whole tables take part: orders without a customer or
# status, returned lines whose product does not exist, repeated product names as keys.
NULLED_ORDERS_SQL = (
    "select o_orderkey as order_id, case when o_orderpriority = '1-URGENT' then null else o_custkey end as customer_id, "
    "nullif(o_orderstatus, 'P') as status, o_totalprice as price, o_orderdate as order_date from orders"
)


def nulled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("customer_id"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("order_date"),
    )


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = F.when(F.col("l_returnflag") == "R", -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return given(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        product.alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def defective(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    frames = targets(spark, sf_dir)
    return frames | {"order": nulled_orders(spark, sf_dir), "line": orphan_lines(spark, sf_dir)}


DEFECTIVE_SQL = {name: target_sql(name) for name in SPECS} | {"order": NULLED_ORDERS_SQL, "line": ORPHAN_LINES_SQL}


def test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [ModelTest(NOT_NULL, "order", (c,)) for c in SPECS["order"].column_names]
    return run_tests(tests, {"order": nulled_orders(spark, sf_dir)})


def test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [
        ModelTest(UNIQUE, "line", ("order_id", "line_no")),
        ModelTest(UNIQUE, "line", ("product_id",)),
        ModelTest(UNIQUE, "order", ("order_id",)),
        ModelTest(UNIQUE, "order", ("customer_id",)),
    ]
    return run_tests(tests, defective(spark, sf_dir))


def test_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [
        ModelTest(LINKS, "line", ("product_id",), "product", ("product_id",)),
        ModelTest(LINKS, "line", ("order_id",), "order", ("order_id",)),
        ModelTest(LINKS, "order", ("customer_id",), "customer", ("customer_id",)),
    ]
    return run_tests(tests, defective(spark, sf_dir))


def all_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = {n: build_staging(df, SPECS[n]) for n, df in defective(spark, sf_dir).items()}
    return run_tests(derive_tests(list(SPECS.values()), RELATIONSHIPS), staging)


def fk_orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_rows(orphan_lines(spark, sf_dir), ["product_id"], target(spark, sf_dir, "product"), ["product_id"])


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fk_report(list(SPECS.values()), defective(spark, sf_dir))


def fk_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = defective(spark, sf_dir)
    parts = [
        inclusion(frames["line"], ["product_id"], frames["product"], ["product_id"]).withColumn("link", F.lit("line.product_id")),
        inclusion(frames["order"], ["customer_id"], frames["customer"], ["customer_id"]).withColumn(
            "link", F.lit("order.customer_id")
        ),
        inclusion(frames["customer"], ["customer_id"], frames["order"], ["customer_id"]).withColumn(
            "link", F.lit("customer.customer_id")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All target tables with made defects; one declared table was never loaded."""
    missing = table("shipment", "shipment_id INTEGER", "shipment_id")
    return validate_tables([*SPECS.values(), missing], defective(spark, sf_dir), spark)


CONTRACT = [
    table(
        "order",
        "order_id INTEGER, customer_id INTEGER, status INTEGER, price INTEGER, order_date TEXT, channel TEXT",
        "order_id",
        foreign_keys={
            "customer_id": ("customer", "customer_id"),
            "warehouse_id": ("warehouse", "warehouse_id"),
            "status": ("line", "state"),
        },
    ),
    table(
        "line",
        "order_id INTEGER, product_id INTEGER, supplier_id REAL, line_no INTEGER",
        foreign_keys={"order_id": ("order", "order_id"), "line_no": ("line", "line_no")},
    ),
    table("customer", "customer_id INTEGER, full_name REAL, segment TEXT", "customer_id"),
]


def check_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_check(CONTRACT, targets(spark, sf_dir, ["order", "line", "customer"]), spark)


QUERIES = {
    "test_not_null": test_not_null,
    "test_unique": test_unique,
    "test_relationships": test_relationships,
    "run_tests": all_tests,
    "fk_orphan_rows": fk_orphan_rows,
    "fk_violations": fk_violations,
    "fk_inclusion": fk_inclusion,
    "validate_tables": validate,
    "contract_check": check_contract,
}


def _test_sql(kind: str, name: str, columns: str, failures: str, parent: str | None = None) -> str:
    ref = f"'{parent}'" if parent else "cast(null as varchar)"
    return (
        f"select '{kind}' as test, 'stg_{name}' as model, '{columns}' as \"column\", {ref} as parent, failures, "
        f"case when failures = 0 then 'pass' else 'fail' end as status from ({failures})"
    )


def _null_sql(name: str, column: str) -> str:
    return f'select count(*) as failures from "{name}" where {column} is null'


def _unique_sql(name: str, columns: str) -> str:
    present = " and ".join(f"{c.strip()} is not null" for c in columns.split(","))
    return (
        f'select count(*) as failures from (select 1 from "{name}" where {present} group by {columns} having count(*) > 1)'
    )


def _orphan_sql(child: str, column: str, parent: str, key: str) -> str:
    return (
        f'select count(*) as failures from "{child}" c where c.{column} is not null '
        f'and not exists (select 1 from "{parent}" p where p.{key} = c.{column})'
    )


def run_tests_sql(views: dict[str, str]) -> str:
    parts = []
    for name, spec in SPECS.items():
        parts += [_test_sql("not_null", name, c, _null_sql(name, c)) for c in [*spec.primary_key, *spec.required]]
        if spec.primary_key:
            key = ", ".join(spec.primary_key)
            parts.append(_test_sql("unique", name, key, _unique_sql(name, key)))
    for r in RELATIONSHIPS:
        failures = _orphan_sql(r.child_table, r.child_column, r.parent_table, r.parent_column)
        parent = f"stg_{r.parent_table}.{r.parent_column}"
        parts.append(_test_sql("relationships", r.child_table, r.child_column, failures, parent))
    return with_sql(views, " union all ".join(parts))


def _fk_sql() -> str:
    parts = [
        f"select '{r.child_table}' as \"table\", '{r.child_column}' as \"column\", '{r.parent_table}' as parent, "
        f"failures as fk_violations from ({_orphan_sql(r.child_table, r.child_column, r.parent_table, r.parent_column)})"
        for r in RELATIONSHIPS
    ]
    return with_sql(DEFECTIVE_SQL, " union all ".join(parts))


def _inclusion_sql(child: str, column: str, parent: str, key: str) -> str:
    found = f'{column} in (select {key} from "{parent}" where {key} is not null)'
    return f"""
        select count(*) as child_rows, count(*) filter (where {found}) as matched_rows,
            count(distinct {column}) as child_keys, count(distinct case when {found} then {column} end) as matched_keys,
            round(count(*) filter (where {found}) / count(*), 4) as inclusion, '{child}.{column}' as link
        from "{child}" where {column} is not null"""


def _validate_sql() -> str:
    parts = []
    for name, spec in SPECS.items():
        nulls = " + ".join(f"count(*) filter (where {c} is null)" for c in spec.required) or "0"
        fks = [
            f"({_orphan_sql(name, r.child_column, r.parent_table, r.parent_column)})"
            for r in RELATIONSHIPS
            if r.child_table == name
        ]
        parts.append(
            f"select '{name}' as \"table\", count(*) as row_count, cast({' + '.join(fks) or '0'} as bigint) as fk_violations, "
            f'cast({nulls} as bigint) as null_violations from "{name}"'
        )
    body = f"""
        select *, case when fk_violations = 0 and null_violations = 0 then 'ok' else 'warning' end as status
        from ({' union all '.join(parts)})
        union all select 'shipment', 0, 0, 0, 'error'"""
    return with_sql(DEFECTIVE_SQL, body)


def _finding_sql(name: str, column: str, finding: str, count: str) -> str:
    return f"select '{name}' as \"table\", '{column}' as \"column\", '{finding}' as finding, cast(({count}) as bigint) as count"


def _contract_sql() -> str:
    parts = [
        _finding_sql("order", "channel", "missing_column", "1"),
        _finding_sql("order", "warehouse_id", "missing_fk_column", "1"),
        _finding_sql("order", "warehouse", "missing_parent_table", "1"),
        _finding_sql("order", "line.state", "missing_parent_column", "1"),
        _finding_sql("order", "status", "type_mismatch", 'select count(*) from "order" where try_cast(status as double) is null'),
        _finding_sql("order", "price", "type_mismatch", 'select count(*) from "order" where price <> floor(price)'),
        _finding_sql(
            "customer", "full_name", "type_mismatch", "select count(*) from customer2 where try_cast(full_name as double) is null"
        ),
        _finding_sql(
            "line",
            "line.line_no",
            "parent_key_not_unique",
            "select count(*) from (select line_no from line group by line_no having count(*) > 1)",
        ),
    ]
    views = {"order": target_sql("order"), "line": target_sql("line"), "customer2": target_sql("customer")}
    return with_sql(views, f"select * from ({' union all '.join(parts)}) where count > 0")


ORACLES = {
    "test_not_null": with_sql(
        {"order": NULLED_ORDERS_SQL},
        " union all ".join(_test_sql("not_null", "order", c, _null_sql("order", c)) for c in SPECS["order"].column_names),
    ),
    "test_unique": with_sql(
        {"order": NULLED_ORDERS_SQL, "line": ORPHAN_LINES_SQL},
        " union all ".join(
            _test_sql("unique", t, c, _unique_sql(t, c))
            for t, c in (("line", "order_id, line_no"), ("line", "product_id"), ("order", "order_id"), ("order", "customer_id"))
        ),
    ),
    "test_relationships": with_sql(
        DEFECTIVE_SQL,
        " union all ".join(
            _test_sql("relationships", c, k, _orphan_sql(c, k, p, k), f"stg_{p}.{k}")
            for c, k, p in (("line", "product_id", "product"), ("line", "order_id", "order"), ("order", "customer_id", "customer"))
        ),
    ),
    "run_tests": run_tests_sql(DEFECTIVE_SQL),
    "fk_orphan_rows": with_sql(
        {"line": ORPHAN_LINES_SQL},
        "select l.* from line l where product_id is not null and not exists (select 1 from part where p_partkey = product_id)",
    ),
    "fk_violations": _fk_sql(),
    "fk_inclusion": with_sql(
        {k: DEFECTIVE_SQL[k] for k in ("line", "product", "order")} | {"customer": target_sql("customer")},
        " union all ".join(
            _inclusion_sql(*args)
            for args in (
                ("line", "product_id", "product", "product_id"),
                ("order", "customer_id", "customer", "customer_id"),
                ("customer", "customer_id", "order", "customer_id"),
            )
        ),
    ),
    "validate_tables": _validate_sql(),
    "contract_check": _contract_sql(),
}
