import datetime

import pytest
from pyspark.sql import functions as F

from martloom.operators.discovery import propose_pks
from martloom.operators.inspection import table_counts, table_summary
from martloom.operators.profiling import CANDIDATES, column_counts, profile, profile_all, sample_values
from martloom.operators.typing import first_texts, infer_types
from martloom.operators.validation import contract_check
from martloom.spec import table


def test_infer_types(spark):
    rows = [("1", "1.5", "true", "2024-01-31", "x", None, "1", "inf", "3"), ("2", "2", "FALSE", "2024-02-01", "2", None, None, "1", "x")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    assert list(infer_types(df).values()) == [
        "integer", "float", "boolean", "date", "string", "string", "integer", "float", "string",
    ]


def test_infer_typed_columns(spark):
    df = spark.sql("select 1 as a, 1.5d as b, true as c, date'2024-01-01' as d, array(1) as e, 1.5 as f")
    assert list(infer_types(df).values()) == ["integer", "float", "boolean", "date", "string", "float"]


def test_first_fifty_values_decide_dates(spark):
    early = spark.range(200).select("id", F.when(F.col("id") < 60, "2024-01-01").otherwise("later").alias("d"))
    assert infer_types(early, order_by="id")["d"] == "date"
    late = spark.range(200).select("id", F.when(F.col("id") == 49, "odd").otherwise("2024-01-01").alias("d"))
    assert infer_types(late, order_by="id")["d"] == "string"
    sparse = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "2024-01-01").alias("d"))
    assert infer_types(sparse, order_by="id")["d"] == "date"


def test_dates_in_one_format(spark):
    mixed = spark.createDataFrame([("2024-01-31",), ("31/01/2024",)], "d string")
    assert infer_types(mixed) == {"d": "string"}
    assert infer_types(mixed.where("d like '%/%'")) == {"d": "date"}


@pytest.mark.parametrize("exact", [True, False])
def test_counts(spark, exact):
    rows = [(1, 1.5, "a", [1, 2], None), (1, 1.5, "b" * 100, [1], None), (2, None, "b" * 100, None, None)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d array<int>, e string")
    found = {r["ordinal"]: (r["row_count"], r["nulls"], r["distinct_count"]) for r in column_counts(df, exact).collect()}
    assert found == {0: (3, 0, 2), 1: (3, 1, 1), 2: (3, 0, 2), 3: (3, 1, 2), 4: (3, 3, 0)}


def test_long_texts_differ_at_the_end(spark):
    df = spark.range(10).select(F.concat(F.lit("x" * 5000), F.col("id").cast("string")).alias("t"))
    assert column_counts(df).first()["distinct_count"] == 10


def test_profile_rows(spark):
    df = spark.createDataFrame([(i, None if i == 0 else f"n{i % 3}") for i in range(32)], "id int, name string")
    found = profile(df, "x.csv", samples=True, order_by="id").orderBy("ordinal").collect()
    assert [tuple(r)[:7] for r in found] == [
        ("x.csv", 0, "id", "integer", 0.0, 32, 32),
        ("x.csv", 1, "name", "string", 0.0312, 3, 32),  # a tie rounds to even
    ]
    assert found[1]["sample_values"] == ["n1", "n2", "n0", "n1", "n2"]


def test_profile_empty(spark):
    df = spark.createDataFrame([], "id int, name string")
    assert [tuple(r)[2:] for r in profile(df, "x").orderBy("ordinal").collect()] == [
        ("id", "integer", 0.0, 0, 0),
        ("name", "string", 0.0, 0, 0),
    ]


def test_profile_sample(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    found = profile(df, "x", sample_rows=5, order_by="id").orderBy("ordinal").collect()
    assert [(r["distinct_count"], r["row_count"]) for r in found] == [(5, 5), (5, 5)]


def test_profile_all_unions(spark):
    assert profile_all({"a": spark.range(3), "b": spark.range(4)}).count() == 2


def test_sample_values_are_text(spark):
    df = spark.createDataFrame([(1, True, datetime.date(2024, 1, 2), [1, 2])], "a int, b boolean, c date, d array<int>")
    found = {r[0]: r[1] for r in sample_values(df, order_by="a").collect()}
    assert found == {"a": ["1"], "b": ["True"], "c": ["2024-01-02"], "d": ["[1, 2]"]}


def test_nan_is_a_missing_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    for exact in (True, False):
        row = profile(df, "x", exact=exact).first()
        assert (row["null_pct"], row["distinct_count"]) == (0.5, 2)


def test_sample_values_of_sparse_and_crowded_columns(spark):
    count = F.col("id")
    df = spark.range(5000).select(
        "id", count.alias("all"), F.when(count >= 4998, count).alias("last"), F.lit(None).cast("string").alias("none"),
        F.when(count % 700 == 3, F.lit(float("nan"))).when(count % 500 == 499, count.cast("double")).alias("rare"),
    )
    found = {r[0]: r[1] for r in sample_values(df.orderBy(F.desc("id")), order_by="id").collect()}
    assert found["all"] == ["0", "1", "2", "3", "4"]
    assert found["last"] == ["4998", "4999"]
    assert "none" not in found
    assert found["rare"] == ["499.0", "999.0", "1499.0", "1999.0", "2499.0"]


def test_sample_values_where_all_places_are_equal(spark):
    df = spark.range(3000).select(F.lit("same").alias("ord"), F.lit("v").alias("v"))
    assert {r[0]: r[1] for r in sample_values(df, order_by="ord").collect()} == {"ord": ["same"] * 5, "v": ["v"] * 5}


def test_sample_values_in_scan_order(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (2.0, "b")], "v double, w string").coalesce(1)
    assert {r[0]: r[1] for r in sample_values(df).collect()} == {"v": ["1.0", "2.0"], "w": ["a", "b"]}


@pytest.mark.parametrize("order_by", [None, "id"])
def test_types_of_many_sparse_columns_in_one_pass(spark, order_by):
    value = lambda i: F.when(F.col("id") % 997 == i, F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    word = lambda i: F.when(F.col("id") % 997 == i, F.when(F.col("id") > 15000, "word").otherwise("2024-01-01"))
    df = spark.range(1, 60000).select("id", *(value(i + 100).alias(f"d{i}") for i in range(15)), *(word(i + 300).alias(f"w{i}") for i in range(15)))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    types = infer_types(df, order_by)
    assert len(tracker.getJobIdsForGroup()) - before <= 6  # first rows, kinds of all columns, first values
    assert {types[f"d{i}"] for i in range(15)} == {"date"} and {types[f"w{i}"] for i in range(15)} == {"string"}


def test_first_values_come_in_order(spark):
    df = spark.range(1000).select((-F.col("id")).alias("ord"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("n"))
    got = first_texts(df.repartition(5), ["v", "n"], "ord")
    assert got == {"v": [str(i) for i in range(998, 898, -2)], "n": []}
    assert first_texts(df, ["v"], None)["v"] == [str(i) for i in range(0, 100, 2)]


def test_column_without_values_has_an_empty_sample(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v string")
    for order_by in (None, "id"):
        found = {r["column_name"]: r["sample_values"] for r in profile(df, "x", samples=True, order_by=order_by).collect()}
        assert found == {"id": ["1", "2"], "v": []}


def test_nothing_to_report(spark):
    assert profile_all({}).collect() == [] and profile_all({}, samples=True).columns[-1] == "sample_values"
    assert table_counts({}).collect() == [] and table_summary({}).collect() == []
    spec = table("t", "id INTEGER", "id")
    assert [tuple(r) for r in contract_check([spec], {}, spark).collect()] == [("t", "t", "missing_table", 1)]


def test_exact_counts_of_candidates_only(spark):
    df = spark.range(20000).select(
        "id", (F.col("id") % 19999).alias("nearly"), (F.col("id") % 7).alias("few"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("half"),
        F.lit(None).cast("string").alias("none"), (F.col("id") % 9000).alias("named"),
    )
    exact = {r["ordinal"]: tuple(r) for r in column_counts(df).collect()}
    found = {r["ordinal"]: tuple(r) for r in column_counts(df, CANDIDATES, ["named"]).collect()}
    assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in exact.items()}
    assert all(found[i] == exact[i] for i in (0, 1, 3, 4, 5)) and abs(found[2][3] - 7) <= 1
    plan = column_counts(df, CANDIDATES)._jdf.queryExecution().optimizedPlan().toString()
    assert "few" not in plan and "nearly" in plan
    catalog = lambda form: sorted(tuple(r) for r in propose_pks(profile(df, "t.csv", exact=form)).collect())
    assert catalog(CANDIDATES) == catalog(True) == [("t.csv", "t", "id", 1.0)]
    assert column_counts(df.limit(0), CANDIDATES).where("row_count = 0").count() == 6
