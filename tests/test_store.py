"""Versions of bucketed tables: what an upsert writes, and what it refers to."""

import os
import random

import pytest
from pyspark.sql import functions as F

from martloom.sources.store import BUCKET, KEYLESS, TableStore, bucket_of
from martloom.spec import table

SPEC = table("t", "id INTEGER, v TEXT, n INTEGER", "id")
PAIR = table("p", "a INTEGER, b TEXT, v TEXT", ["a", "b"])


def files(store, name):
    """Every file of the current version with its time of change."""
    found = {}
    for folder, bucket in store.parts(name).folders():
        path = f"{store.root}/{name}/{folder}/{BUCKET}={bucket}"
        for file in os.listdir(path):
            if file.endswith(".parquet"):
                found[f"{path}/{file}"] = os.stat(f"{path}/{file}").st_mtime_ns
    return found


def bucket_in(path):
    return int(path.split(f"{BUCKET}=")[1].split("/")[0])


def rows(spark, *values):
    return spark.createDataFrame(values, SPEC.spark_schema)


def test_untouched_buckets_are_the_same_files(spark, folder):
    store = TableStore(spark, folder, buckets=8)
    store.write(SPEC, spark.range(1000).select("id", F.lit("a").alias("v"), F.col("id").alias("n")))
    before = files(store, "t")
    change = rows(spark, (7, "new", None))
    store.upsert(SPEC, change)
    after = files(store, "t")
    touched = change.select(bucket_of(["id"], 8)).first()[0]
    same = {f: t for f, t in before.items() if bucket_in(f) != touched}
    assert len(same) == 7 and same.items() <= after.items()
    assert {bucket_in(f) for f in set(after) - set(before)} == {touched}
    assert {bucket_in(f) for f in set(before) - set(after)} == {touched}
    got = store.read("t")
    assert got.count() == 1000 and [tuple(r) for r in got.where("id = 7").collect()] == [(7, "new", None)]
    assert len({f for f, _ in store.parts("t").folders()}) == 2


def test_vacuum_keeps_what_is_referred_to(spark, folder):
    store = TableStore(spark, folder, buckets=4)
    store.write(SPEC, spark.range(100).select("id", F.lit("a").alias("v"), F.col("id").alias("n")))
    for i in (1, 2, 1, 3):
        store.upsert(SPEC, rows(spark, (i, f"new{i}", i), (None, f"keyless{i}", i)))
    expected, kept = sorted(map(tuple, store.read("t").collect()), key=repr), files(store, "t")
    assert len(store.vacuum("t")) == 4
    assert files(store, "t") == kept and sorted(map(tuple, store.read("t").collect()), key=repr) == expected
    left = {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/t") for f in names if f.endswith(".parquet")}
    assert left == set(kept)
    assert store.vacuum("t") == [] and store.tables() == ["t"]
    store.write(SPEC, rows(spark, (1, "a", 1)))
    assert store.vacuum("t") and len([n for n in os.listdir(f"{folder}/t") if os.path.isdir(f"{folder}/t/{n}")]) == 1
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "a", 1)]


def test_keyless_rows_are_added_without_being_written_again(spark, folder):
    store = TableStore(spark, folder, buckets=4)
    store.write(SPEC, rows(spark, (None, "a", 1), (1, "b", 2)))
    before = files(store, "t")
    store.upsert(SPEC, rows(spark, (None, "c", 3)))
    assert before.items() <= files(store, "t").items()
    assert len(store.parts("t").keyless) == 2 and {bucket_in(f) for f in set(files(store, "t")) - set(before)} == {KEYLESS}
    assert sorted(map(tuple, store.read("t").collect()), key=repr) == [(1, "b", 2), (None, "a", 1), (None, "c", 3)]


@pytest.mark.parametrize("spec", [SPEC, PAIR])
def test_many_upserts_against_a_dictionary(spark, folder, spec):
    store, draw = TableStore(spark, folder, buckets=5), random.Random(4)
    model, keyless = {}, []
    for round_ in range(4):
        batch = {}
        for _ in range(draw.choice([1, 3, 40])):
            key = (draw.randrange(60),) if spec is SPEC else (draw.randrange(6), draw.choice("abcd"))
            batch[key] = (*key, f"r{round_}") + ((draw.randrange(9),) if spec is SPEC else ())
        loose = [(None, *r[1:]) for r in batch.values()][: draw.randrange(2)]
        store.upsert(spec, spark.createDataFrame([*batch.values(), *loose], spec.spark_schema))
        model |= batch
        keyless += loose
        got = sorted(map(tuple, store.read(spec.name).collect()), key=repr)
        assert got == sorted([*model.values(), *keyless], key=repr)


def test_columns_and_types_change(spark, folder):
    store = TableStore(spark, folder, buckets=4)
    narrow = table("t", "id INTEGER, v TEXT", "id")
    store.write(narrow, spark.createDataFrame([(i, "a") for i in range(20)], narrow.spark_schema))
    before = files(store, "t")
    store.upsert(SPEC, rows(spark, (3, "b", 5)))
    assert store.read("t").columns == ["id", "v", "n"] and len(set(before) & set(files(store, "t"))) >= 3
    assert store.read("t").where("n is not null").count() == 1 and store.read("t").count() == 20
    store.upsert(narrow, spark.createDataFrame([(4, "c")], narrow.spark_schema))
    assert store.read("t").columns == ["id", "v", "n"] and store.spec("t").column_names == ["id", "v", "n"]
    real = table("t", "id INTEGER, v TEXT, n REAL", "id")
    store.upsert(real, spark.createDataFrame([(3, "b", 0.5)], real.spark_schema))
    got = store.read("t")
    assert dict(got.dtypes)["n"] == "double" and got.count() == 20 and got.where("n = 0.5").count() == 1


def test_a_version_without_its_list_does_not_count(spark, folder):
    store = TableStore(spark, folder, buckets=4)
    store.write(SPEC, rows(spark, (1, "a", 1)))
    store.upsert(SPEC, rows(spark, (1, "b", 1)))
    os.remove(f"{folder}/t/v000002_p4.parts.json")
    assert [r["v"] for r in store.read("t").collect()] == ["a"]
    store.upsert(SPEC, rows(spark, (2, "c", 1)))
    assert sorted(r["v"] for r in store.read("t").collect()) == ["a", "c"]


def test_empty_batches_and_other_layouts(spark, folder):
    before = spark.catalog.listTables()
    store = TableStore(spark, folder, buckets=4)
    store.upsert(SPEC, rows(spark))
    assert store.read("t").columns == ["id", "v", "n"] and store.read("t").count() == 0
    store.upsert(SPEC, rows(spark, (1, "a", 1)))
    store.upsert(SPEC, rows(spark))
    assert store.read("t").count() == 1
    TableStore(spark, folder).upsert(SPEC, rows(spark, (2, "b", 1)))  # no buckets: one folder
    assert store.parts("t") is None and store.read("t").count() == 2
    TableStore(spark, folder, buckets=2).upsert(SPEC, rows(spark, (3, "c", 1)))
    assert store.parts("t").count == 2 and store.read("t").count() == 3
    store.upsert(SPEC, rows(spark, (3, "d", 1)))
    assert store.parts("t").count == 4 and store.read("t").count() == 3
    assert spark.catalog.listTables() == before
