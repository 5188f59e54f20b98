"""Key summaries give what the single checks give."""

import random

import pytest
from pyspark.sql import functions as F

from martloom.operators.checks import derive_tests, inclusion, key_counts, run_tests
from martloom.operators.summaries import inclusions, orphans, summarise, summarise_for, test_results as results_of
from martloom.plans.build import build_all
from martloom.spec import Relationship, table
from tests.conftest import rows

PARENT = table("parent", "id INTEGER, code TEXT, other INTEGER", "id", not_null=["code"])
CHILD = table("child", "a INTEGER, b TEXT, parent_id INTEGER, code TEXT, o1 INTEGER, o2 TEXT", ["a", "b"])
LINKS = [
    Relationship("child", ("parent_id",), "parent", ("id",), "declared"),
    Relationship("child", ("code",), "parent", ("code",), "declared"),
    Relationship("child", ("o2", "o1"), "parent", ("code", "other"), "declared"),
]


def frames(spark, seed=1, count=300):
    draw = random.Random(seed)
    value = lambda n: draw.choice([None, *range(n)])
    text = lambda n: draw.choice([None, *"abcdefghij"[:n]])
    parents = [(draw.choice([i, i, i, None, 3]), text(6), value(5)) for i in range(40)]
    children = [(value(40), text(9), 7 if draw.random() < 0.4 else value(60), text(9), value(7), text(8)) for _ in range(count)]
    return {"parent": spark.createDataFrame(parents, "id long, code string, other long"), "child": spark.createDataFrame(children, CHILD.spark_schema)}


@pytest.mark.parametrize("count", [0, 300])
def test_results_equal_the_single_tests(spark, count):
    tables = frames(spark, count=count)
    tests = derive_tests([PARENT, CHILD], LINKS)
    found = results_of(tests, summarise_for(tests, tables), spark)
    assert rows(found) == rows(run_tests(tests, tables)) and len(rows(found)) == len(tests)


def test_counts_of_every_set(spark):
    child = frames(spark)["child"]
    summary = summarise(child, [("a", "b"), ("b", "a"), ("parent_id",), ("o2", "o1")], ["a", "code"])
    assert len(summary.sets) == 3 and summary.rows == 300
    assert summary.nulls == {"a": child.where("a is null").count(), "code": child.where("code is null").count()}
    for columns in (("a", "b"), ("parent_id",), ("o1", "o2"), ("o2", "o1")):
        assert rows(summary.of(columns)) == rows(key_counts(child, columns))


def test_inclusion_from_summaries(spark):
    tables = frames(spark)
    made = {name: summarise(df, [c for r in LINKS for t, c in ((r.child_table, r.child_columns), (r.parent_table, r.parent_columns)) if t == name]) for name, df in tables.items()}
    links = [(made["child"], r.child_columns, made["parent"], r.parent_columns) for r in LINKS]
    got = {r["link"]: tuple(r)[1:] for r in inclusions(links, spark).collect()}
    for i, r in enumerate(LINKS):
        assert got[i] == tuple(inclusion(tables["child"], r.child_columns, tables["parent"], r.parent_columns).first())
    assert orphans([], spark).collect() == []


def test_tests_read_nothing_but_the_summaries(spark):
    tables = frames(spark)
    tests = derive_tests([PARENT, CHILD], LINKS)
    made = summarise_for(tests, tables)
    files = results_of(tests, made, spark).inputFiles()
    assert files and all("/keys-" in f for f in files)
    assert made["child"].keys.select("set").distinct().count() == 4


def test_build_reads_published_marts(spark, folder):
    tables = {"parent": spark.createDataFrame([(i, "a", i) for i in range(10)], PARENT.spark_schema)}
    tables["child"] = spark.range(100).select(F.col("id").alias("a"), F.lit("x").alias("b"), (F.col("id") % 10).alias("parent_id"), F.lit("a").alias("code"), F.lit(1).cast("bigint").alias("o1"), F.lit("a").alias("o2"))
    steps = build_all(spark, [PARENT, CHILD], tables, LINKS[:1], folder)
    assert {s.model: s.rows for s in steps if s.step in ("mart", "enriched")} == {"mart_parent": 10, "mart_child": 100, "mart_child_enriched": 100}
    assert all(s.status == "ok" for s in steps)
