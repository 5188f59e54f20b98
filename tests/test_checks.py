import pytest
from pyspark.sql import functions as F

from martloom.operators import joins
from martloom.operators.checks import derive_tests, inclusion, orphan_rows, relationship_failures, run_tests, unique_failures
from martloom.operators.joins import deal, hot_keys, join_parent
from martloom.operators.validation import contract_check, fk_report, validate_tables
from martloom.spec import Relationship, table


def test_unique_ignores_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 5), (None, 5)], "a int, b int")
    assert unique_failures(df, ["a"]).first()[0] == 1
    assert unique_failures(df, ["a", "b"]).first()[0] == 1
    assert unique_failures(df, ["b"]).first()[0] == 2


def test_relationships_count_rows(spark):
    child = spark.createDataFrame([(1,), (99,), (99,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert relationship_failures(child, ["k"], parent, ["id"]).first()[0] == 2


@pytest.mark.parametrize("modulus", [1, 3, 10])
def test_violations_matches_and_nulls_add_up(spark, modulus):
    key = F.when(F.col("id") % 7 != 0, F.col("id") % 40)
    child = spark.range(500).select(key.alias("k"))
    parent = spark.range(0, 40, modulus).select(F.col("id").alias("pk"))
    orphans = relationship_failures(child, ["k"], parent, ["pk"]).first()[0]
    measured = inclusion(child, ["k"], parent, ["pk"]).first()
    assert orphans + measured["matched_rows"] + child.where("k is null").count() == 500
    assert orphan_rows(child, ["k"], parent, ["pk"]).count() == orphans


def test_composite_key_with_null_part_is_no_violation(spark):
    child = spark.createDataFrame([(1, 1), (1, None)], "a int, b int")
    parent = spark.createDataFrame([(2, 2)], "x int, y int")
    assert relationship_failures(child, ["a", "b"], parent, ["x", "y"]).first()[0] == 1


def test_inclusion(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,)], "id int")
    assert tuple(inclusion(child, ["k"], parent, ["id"]).first()) == (3, 2, 2, 1, 0.6667)
    assert tuple(inclusion(child.where("k is null"), ["k"], parent, ["id"]).first()) == (0, 0, 0, 0, 0.0)


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, another third has none, and many rows are equal."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    child = spark.range(30000).select(key.cast("bigint").alias("k"), (F.col("id") % 2).alias("v"))
    parent = spark.range(20000).select(F.col("id").alias("pk"), (F.col("id") * 10).alias("w"))
    return child, parent


def test_hot_keys(spark, skewed):
    child, _ = skewed
    found = hot_keys(child, [["k"], ["k", "v"]])
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]
    assert set(found["k",]) == {seven} and abs(found["k",][seven] - 1 / 3) < 0.01
    assert len(found["k", "v"]) == 2


def test_all_hot_keys_are_spread_on_any_kind_of_key(spark):
    """A hundred keys with a hundredth of the rows each, on a date and a decimal together."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int"))
    child = spark.range(20000).select(day.alias("d"), (F.col("id") % 100).cast("decimal(10,2)").alias("n"), F.col("id").alias("v"))
    parent = spark.range(150).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("pd"), F.col("id").alias("pn"))
    hot = hot_keys(child, [["d", "n"]])["d", "n"]
    assert len(hot) == 100
    same = parent.withColumn("pn", F.col("pn").cast("decimal(12,1)"))
    salted, copies = joins.spread(deal(child), same, ["d", "n"], ["pd", "pn"], hot)
    assert copies.count() == 250 and salted.select("d", joins.SALT).distinct().count() == 200
    for right in (same, parent):  # decimals meet whole numbers by a cast: joined as they are
        joined = join_parent(deal(child), right, ["d", "n"], ["pd", "pn"], "left", hot)
        assert joined.where(F.col("pd").isNotNull()).count() == 20000 and joined.count() == 20000


def test_spread_join_equals_plain_join(spark, skewed, monkeypatch):
    child, parent = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = hot_keys(child, [["k"]])["k",]
        for how in ("left", "left_anti"):
            plain = join_parent(child, parent, ["k"], ["pk"], how).groupBy("child.k", "child.v").count()
            spread = join_parent(deal(child), parent, ["k"], ["pk"], how, hot).groupBy("child.k", "child.v").count()
            assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, spread.collect()), key=repr)
        salted, _ = joins.spread(deal(child), parent, ["k"], ["pk"], hot)
        sizes = {tuple(r)[:2]: r["count"] for r in salted.groupBy("k", joins.SALT).count().collect()}
        assert max(sizes.values()) < 6000
        assert max(n for (k, _), n in sizes.items() if k is None) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orphan_rows_with_spread_keys(spark, skewed):
    child, parent = skewed
    plain = orphan_rows(child, ["k"], parent, ["pk"])
    spread = orphan_rows(child, ["k"], parent, ["pk"], small_parent=0)
    assert plain.columns == spread.columns == ["k", "v"]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
    assert plain.count() == child.where("k >= 20000").count() > 0


SPECS = [
    table("p", "p_id INTEGER, code TEXT", "p_id"),
    table(
        "c",
        "c_id INTEGER, p_id INTEGER, code TEXT, name TEXT",
        "c_id",
        not_null=["name"],
        foreign_keys={"p_id": ("p", "p_id"), "code": ("p", "code")},
    ),
]


def frames(spark, codes=("x", "y")):
    return {
        "p": spark.createDataFrame([(1, codes[0]), (2, codes[1])], "p_id bigint, code string"),
        "c": spark.createDataFrame(
            [(1, 1, "x", None), (2, 9, "z", "n"), (3, None, None, "n")], "c_id bigint, p_id bigint, code string, name string"
        ),
    }


def test_validation(spark):
    found = {r[0]: tuple(r)[1:] for r in validate_tables(SPECS, frames(spark), spark).collect()}
    assert found == {"p": (2, 0, 0, "ok"), "c": (3, 2, 1, "warning")}


def test_validation_errors(spark):
    repeated = frames(spark, codes=("x", "x"))
    assert {r["table"]: r["status"] for r in validate_tables(SPECS, repeated, spark).collect()} == {"p": "ok", "c": "error"}
    alone = {r[0]: tuple(r)[1:] for r in validate_tables(SPECS, {"c": repeated["c"]}, spark).collect()}
    assert alone == {"p": (0, 0, 0, "error"), "c": (3, 4, 1, "warning")}


def test_fk_report(spark):
    found = sorted(map(tuple, fk_report(SPECS, frames(spark)).collect()))
    assert found == [("c", "code", "p", 1), ("c", "p_id", "p", 1)]


def test_contract_names_ignore_case(spark):
    spec = table("c", "C_ID INTEGER, Name INTEGER, extra TEXT", "C_ID", foreign_keys={"c_id": ("P", "P_ID")})
    found = sorted(map(tuple, contract_check([spec, SPECS[0]], frames(spark), spark).collect()))
    assert found == [("c", "Name", "type_mismatch", 2), ("c", "extra", "missing_column", 1)]


def test_derived_tests_on_composite_key(spark):
    spec = table("t", "a INTEGER, b INTEGER, c TEXT", ["a", "b"], not_null=["c"])
    tests = derive_tests([spec], [Relationship("t", ("a",), "t", ("b",), "declared_fk")])
    assert [(t.kind, t.columns) for t in tests] == [
        ("not_null", ("a",)), ("not_null", ("b",)), ("not_null", ("c",)), ("unique", ("a", "b")), ("relationships", ("a",)),
    ]
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (3, 1, "x")], "a bigint, b bigint, c string")
    found = {(r["test"], r["column"]): (r["failures"], r["status"]) for r in run_tests(tests, {"t": df}).collect()}
    assert found == {
        ("not_null", "a"): (0, "pass"),
        ("not_null", "b"): (0, "pass"),
        ("not_null", "c"): (1, "fail"),
        ("unique", "a, b"): (0, "pass"),
        ("relationships", "a"): (1, "fail"),
    }
