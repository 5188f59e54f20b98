import pytest
from pyspark.sql import functions as F

from martloom.functions.names import (
    identifier,
    identifier_column,
    raw_table_name,
    singular,
    table_name,
    table_name_column,
    unique_identifiers,
)
from martloom.sources.delimited import header_names

NAMES = {
    "Order-ID (x)": "order_id_x",
    "9lives": "_9lives",
    "***": "field",
    "  Ünï code ": "n_code",
    "a b": "a_b",
    "__x__": "x",
    "": "field",
}
FILES = {
    "source2_orders.csv": "orders",
    "src_raw_items.json": "items",
    "SOURCE-Sales.Report.csv": "sales_report",
    "raw_source_x.csv": "source_x",
    "plain": "plain",
    "2024.csv": "_2024",
}


def test_identifier():
    assert {name: identifier(name) for name in NAMES} == NAMES
    assert identifier("***", "model") == "model"


def test_identifier_column_agrees(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = {r[0]: r[1] for r in df.select("name", identifier_column(F.col("name"))).collect()}
    assert found == NAMES


def test_unique_identifiers():
    assert unique_identifiers(["a b", "a-b", "A B", "id"]) == ["a_b", "a_b_2", "a_b_3", "id"]
    assert unique_identifiers(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]


def test_table_names(spark):
    assert {name: table_name(name) for name in FILES} == FILES
    df = spark.createDataFrame([(n,) for n in FILES], "name string")
    assert {r[0]: r[1] for r in df.select("name", table_name_column(F.col("name"))).collect()} == FILES
    assert raw_table_name("/x/source1_Order Items.csv") == "raw_source1_order_items"


@pytest.mark.parametrize("name, expected", [("orders", "order"), ("class", "cla"), ("address", "addre"), ("x", "x")])
def test_singular(name, expected):
    assert singular(name) == expected


def test_header_names():
    assert header_names(["id", "a", "a", None, "a.1"]) == ["id", "a", "a.1", "Unnamed: 3", "a.1.1"]
