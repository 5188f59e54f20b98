"""From files to tested marts, the way the README shows it."""

from martloom.operators.discovery import infer_relationships, propose_schema, schema_specs
from martloom.operators.mapping import Mapping
from martloom.operators.matching import propose_mappings, proposed_list
from martloom.operators.profiling import profile_all
from martloom.plans.build import build_all, succeeded
from martloom.plans.models import read_mart
from martloom.plans.migrate import Source, migrate
from martloom.session import stage
from martloom.sources import list_sources
from martloom.sources.raw import ROW_NUMBER, SOURCE_FILE, land_all
from martloom.sources.store import TableStore


def write_inputs(folder):
    with open(f"{folder}/source1_customers.csv", "w") as f:
        f.write("Customer ID,First,Last\n")
        f.writelines(f"{i},Ann{i},  Lee{i} \n" for i in range(1, 51))
    with open(f"{folder}/source2_orders.json", "w") as f:
        f.writelines(f'{{"order_id": {i}, "customer_id": {i % 50 + 1}, "price": {i}.5, "tags": ["a"]}}\n' for i in range(1, 201))


def test_files_to_marts(spark, folder):
    write_inputs(folder)
    raw = land_all(spark, list_sources(spark, folder), folder + "/raw")
    assert [(t.source, t.table) for t in raw] == [
        ("source1_customers.csv", "raw_source1_customers"),
        ("source2_orders.json", "raw_source2_orders"),
    ]
    catalog = stage(profile_all({t.source: t.data() for t in raw}), "catalog")
    specs = schema_specs(propose_schema(catalog))
    assert {s.name: s.column_names for s in specs} == {
        "customers": ["customer_id", "first", "last"],
        "orders": ["order_id", "customer_id", "price", "tags"],
    }
    sources = [Source(t.source, t.read(), ROW_NUMBER, file=SOURCE_FILE) for t in raw]
    mappings = [Mapping(s.name, c, f, c) for s, f in zip(specs, (t.source for t in raw)) for c in s.column_names]
    fresh, project = TableStore(spark, folder + "/fresh"), TableStore(spark, folder + "/project", buckets=4)
    run = migrate(spark, specs, sources, mappings, fresh, project)
    assert {r["table"]: (r["row_count"], r["status"]) for r in run.validation.collect()} == {
        "customers": (50, "ok"),
        "orders": (200, "ok"),
    }
    tables = {s.name: project.read(s.name) for s in specs}
    steps = build_all(spark, specs, tables, infer_relationships(specs), folder + "/marts")
    assert succeeded(steps)
    mart = read_mart(spark, "mart_orders_enriched", folder + "/marts")
    assert mart.columns == ["order_id", "customer_id", "price", "tags", "customers_first", "customers_last"]
    assert tuple(mart.where("order_id = 3").first()) == (3, 4, 3.5, '["a"]', "Ann4", "Lee4")
    # the loaded tables now tell how to map the next delivery
    proposal = propose_mappings({t.source: t.data() for t in raw}, tables)
    found = {(m.target_table, m.target_column): (m.source_file, m.source_column) for m in proposed_list(proposal, specs)}
    assert found["customers", "first"] == ("source1_customers.csv", "first")
    assert found["orders", "order_id"] == ("source2_orders.json", "order_id")
