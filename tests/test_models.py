from pyspark.sql import functions as F

from martloom.operators.discovery import (
    extend_schema,
    infer_relationships,
    propose_fks,
    propose_schema,
    relationship_frame,
    schema_specs,
    target_columns,
)
from martloom.operators.checks import run_tests
from martloom.operators.validation import fk_report, validate_tables
from martloom.operators.inspection import inspect, layer_of, table_counts, table_summary
from martloom.operators.matching import column_overlap, propose_mappings, proposed_list
from martloom.operators.profiling import profile_all
from martloom.plans.build import blocked_models, build_all, step_frame, succeeded
from martloom.plans.models import build_enriched, build_layers, build_staging, read_mart
from martloom.sources.store import TableStore
from martloom.spec import Relationship, table

# Tables and keys with known model columns.
CUSTOMER = table("customer", "customer_id INTEGER, full_name TEXT, email TEXT, phone TEXT, city TEXT", "customer_id")
MEMBER = table("member", "member_id TEXT, customer_id INTEGER", "member_id", foreign_keys={"customer_id": ("customer", "customer_id")})
PRODUCT = table("product", "product_id INTEGER, product_name TEXT", "product_id", not_null=["product_name"])
ORDER = table(
    "order",
    "order_id INTEGER, customer_id INTEGER, product_id INTEGER, quantity INTEGER, price REAL, order_date TEXT",
    "order_id",
    not_null=["customer_id", "product_id"],
    foreign_keys={"product_id": ("product", "product_id"), "customer_id": ("customer", "customer_id")},
)
TRANSACTION = table(
    "transaction",
    "transaction_id TEXT, member_id TEXT, points_earned INTEGER, tier TEXT, activity_date TEXT",
    "transaction_id",
    not_null=["member_id"],
    foreign_keys={"member_id": ("member", "member_id")},
)
SPECS = [CUSTOMER, MEMBER, ORDER, PRODUCT, TRANSACTION]


def frames(spark):
    return {
        "customer": spark.createDataFrame([("1", " Ann ", "a@x", "", "Rome")], ", ".join(f"{c} string" for c in CUSTOMER.column_names)),
        "member": spark.createDataFrame([("m1", 1)], "member_id string, customer_id int"),
        "product": spark.createDataFrame([(5, "Pen")], "product_id int, product_name string"),
        "order": spark.createDataFrame(
            [(1, 1, 5, 2, "9.5 eur", " 2024-01-01 "), (2, 7, 5, None, "x", "  ")],
            "order_id int, customer_id int, product_id int, quantity int, price string, order_date string",
        ),
        "transaction": spark.createDataFrame([("t1", "m1", "12pt", "gold", None)], ", ".join(f"{c} string" for c in TRANSACTION.column_names)),
    }


def test_known_model_columns(spark):
    models = build_layers(SPECS, frames(spark), infer_relationships(SPECS))
    assert models["mart_order_enriched"].columns == [
        "order_id", "customer_id", "product_id", "quantity", "price", "order_date", "product_product_name",
        "customer_full_name", "customer_email", "customer_phone", "customer_city",
    ]
    assert models["mart_member_enriched"].columns == [
        "member_id", "customer_id", "customer_full_name", "customer_email", "customer_phone", "customer_city",
    ]
    assert models["mart_transaction_enriched"].columns == [
        "transaction_id", "member_id", "points_earned", "tier", "activity_date", "member_customer_id",
    ]
    found = sorted(map(tuple, models["mart_order_enriched"].collect()))
    assert found == [
        (1, 1, 5, 2, 9.5, "2024-01-01", "Pen", "Ann", "a@x", None, "Rome"),
        (2, 7, 5, None, 0.0, None, "Pen", None, None, None, None),
    ]


def test_strict_staging(spark):
    row = build_staging(frames(spark)["order"], ORDER, "strict").where("order_id = 1").first()
    assert row["price"] is None


def test_two_links_to_one_parent_and_composite_links(spark):
    parent = table("node", "a INTEGER, b INTEGER, name TEXT", ["a", "b"])
    child = table("edge", "fa INTEGER, fb INTEGER, ta INTEGER, tb INTEGER")
    links = [
        Relationship("edge", ("fa", "fb"), "node", ("a", "b"), "declared_fk"),
        Relationship("edge", ("ta", "tb"), "node", ("a", "b"), "declared_fk"),
    ]
    data = {
        "node": spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "a int, b int, name string"),
        "edge": spark.createDataFrame([(1, 1, 1, 2), (1, None, 9, 9)], "fa int, fb int, ta int, tb int"),
    }
    result = build_enriched(child, links, {"node": parent, "edge": child}, data)
    assert result.columns == ["fa", "fb", "ta", "tb", "node_name", "node_ta_tb_name"]
    assert sorted(map(tuple, result.collect()), key=repr) == [(1, 1, 1, 2, "x", "y"), (1, None, 9, 9, None, None)]


def test_enriched_with_spread_keys(spark):
    keys = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).cast("bigint")
    child = table("c", "id INTEGER, a_id INTEGER, b_id INTEGER")
    a, b = table("a", "a_id INTEGER, x INTEGER", "a_id"), table("b", "b_id INTEGER, y INTEGER", "b_id")
    data = {
        "c": spark.range(9000).select("id", keys.alias("a_id"), (F.col("id") % 5).alias("b_id")),
        "a": spark.range(5000).select(F.col("id").alias("a_id"), (F.col("id") * 2).alias("x")),
        "b": spark.range(4).select(F.col("id").alias("b_id"), (F.col("id") * 3).alias("y")),
    }
    specs = {"c": child, "a": a, "b": b}
    links = infer_relationships([child, a, b])
    plain = build_enriched(child, links, specs, data)
    spread = build_enriched(child, links, specs, data, small_parent=0)
    assert plain.columns == spread.columns == ["id", "a_id", "b_id", "a_x", "b_y"]
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, spread.collect()), key=repr)


def test_relationship_names():
    customers = table("customers", "cust_key INTEGER, name TEXT", "cust_key")
    order = table("order", "order_id INTEGER, customer_id INTEGER, parent_id INTEGER", "order_id")
    item = table("item", "order_id INTEGER, customers_id INTEGER, itemid INTEGER")
    found = [(r.child_table, r.child_column, r.parent_table, r.parent_column) for r in infer_relationships([customers, order, item])]
    assert found == [
        ("order", "customer_id", "customers", "cust_key"),
        ("item", "order_id", "order", "order_id"),
        ("item", "customers_id", "customers", "cust_key"),
    ]


def test_declared_before_inferred():
    found = infer_relationships([ORDER, PRODUCT, CUSTOMER])
    assert [(r.child_column, r.source) for r in found] == [("product_id", "declared_fk"), ("customer_id", "declared_fk")]


def test_schema_proposal(spark):
    data = {
        "source1_people.csv": spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "`Person ID` int, name string, score double"),
        "source2_visits.csv": spark.createDataFrame([(10, 1, True), (11, 3, None)], "visitid int, person_id int, paid boolean"),
    }
    catalog = profile_all(data)
    people, visits = schema_specs(propose_schema(catalog))
    assert [(c.name, c.sql_type, c.nullable, c.primary_key) for c in people.columns] == [
        ("person_id", "INTEGER", True, True), ("name", "TEXT", False, False), ("score", "REAL", True, False),
    ]
    assert [(c.name, c.sql_type, c.primary_key) for c in visits.columns] == [
        ("visitid", "INTEGER", True), ("person_id", "INTEGER", False), ("paid", "INTEGER", False),
    ]
    assert [(f.columns, f.ref_table, f.ref_columns) for f in visits.foreign_keys] == [(("person_id",), "people", ("person_id",))]
    fk = propose_fks(catalog, data).first()
    assert (fk["child_table"], fk["parent_table"], fk["inclusion"]) == ("visits", "people", 0.5)
    merged = extend_schema([table("people", "person_id INTEGER, note TEXT", "person_id")], [people, visits])
    assert [s.name for s in merged] == ["people", "visits"]
    assert merged[0].column_names == ["person_id", "note", "name", "score"]
    assert target_columns(merged, spark).count() == 7


def test_matching(spark):
    sources = {
        "o.csv": spark.createDataFrame([(i, i % 4, f"n{i}") for i in range(20)], "order_key int, cust int, note string"),
        "c.csv": spark.createDataFrame([(i, f"c{i}") for i in range(4)], "customer_key int, label string"),
    }
    targets = {
        "customer": spark.createDataFrame([(i, f"c{i}") for i in range(4)], "customer_id bigint, name string"),
        "order": spark.createDataFrame([(i, i % 4, None) for i in range(20)], "order_id bigint, customer_id bigint, memo string"),
    }
    pairs = {tuple(r)[:4]: (r["shared"], r["overlap"]) for r in column_overlap(sources, targets).collect()}
    assert pairs["o.csv", "order_key", "order", "order_id"] == (20, 1.0)
    assert pairs["o.csv", "order_key", "customer", "customer_id"] == (4, 0.2)
    assert ("o.csv", "note", "customer", "name") not in pairs
    proposal = propose_mappings(sources, targets)
    specs = [
        table("customer", "customer_id INTEGER, name TEXT", "customer_id"),
        table("order", "order_id INTEGER, customer_id INTEGER, memo TEXT", "order_id", foreign_keys={"customer_id": ("customer", "customer_id")}),
    ]
    found = {(m.target_table, m.target_column): (m.source_file, m.source_column) for m in proposed_list(proposal, specs)}
    assert found["customer", "name"] == ("c.csv", "label")
    assert found["order", "order_id"] == ("o.csv", "order_key")
    assert found["order", "memo"] == (None, None)


def test_many_columns_overlap(spark):
    wide = spark.range(10).select(*[(F.col("id") * 1000 + i).alias(f"c{i}") for i in range(70)])
    target = spark.range(10).select((F.col("id") * 1000 + 69).alias("t"))
    assert [tuple(r)[1:5] for r in column_overlap({"s": wide}, {"t": target}).collect()] == [("c69", "t", "t", 10)]


def test_failing_tests_keep_their_models_from_being_published(spark, folder):
    data = frames(spark)
    steps = build_all(spark, SPECS, data, infer_relationships(SPECS), folder)
    assert list(dict.fromkeys(s.step for s in steps)) == ["staging", "test", "mart", "enriched"]
    assert not succeeded(steps)  # one order has no customer
    failed = [s for s in steps if s.status != "ok"]
    assert [(s.model, s.status) for s in failed] == [
        ("relationships stg_order.customer_id", "error"), ("mart_order", "skipped"), ("mart_order_enriched", "skipped"),
    ]
    assert failed[1].reason == "tests failed: order"
    assert step_frame(steps, spark).count() == len(steps)
    assert spark.table("stg_order").count() == 2
    store = TableStore(spark, folder)
    assert store.exists("mart_member_enriched") and not store.exists("mart_order") and not store.exists("mart_order_enriched")
    repaired = data | {"order": data["order"].where("order_id = 1")}
    assert succeeded(build_all(spark, SPECS, repaired, infer_relationships(SPECS), folder))
    build_all(spark, SPECS, data, infer_relationships(SPECS), folder)
    assert read_mart(spark, "mart_order", folder).count() == 1  # the version of before stays
    assert store.vacuum("mart_member") == ["v000001", "v000002"] and store.read("mart_member").count() == 1
    broken = data | {"member": data["member"].drop("customer_id")}
    stopped = build_all(spark, SPECS, broken, infer_relationships(SPECS), folder)
    assert {(s.model, s.status) for s in stopped} >= {("stg_customer", "ok"), ("stg_member", "error")}
    assert {s.step for s in stopped} == {"staging"}


def test_children_of_failing_models_are_blocked():
    links = infer_relationships(SPECS)
    assert blocked_models(["customer"], links) == {
        "customer": "customer", "member": "customer", "order": "customer", "transaction": "customer",
    }
    assert blocked_models([], links) == {}


def test_inspection(spark):
    data = {"b": spark.range(3), "A": spark.range(200), "stg_b": spark.range(3), "MART_x": spark.range(1), "martial": spark.range(1)}
    assert [tuple(r) for r in table_summary(data).collect()] == [("A", 200, ["id"]), ("b", 3, ["id"]), ("martial", 1, ["id"])]
    assert [r["id"] for r in inspect(data["A"], ["id"]).collect()] == list(range(100))
    assert [layer_of(n) for n in ("x", "stg_x", "mart_x")] == ["loaded/source", "dbt staging", "dbt mart"]
    assert {r["table_name"]: r["row_count"] for r in table_counts(data).collect()}["A"] == 200


def test_nothing_to_relate(spark):
    lonely = {"a.csv": spark.createDataFrame([(1, "x")], "a_key int, name string")}
    assert propose_fks(profile_all(lonely), lonely).collect() == []
    assert relationship_frame([], {}).collect() == [] and fk_report([], {}).collect() == []
    assert run_tests([], {}).collect() == [] and validate_tables([], {}, spark).collect() == []
