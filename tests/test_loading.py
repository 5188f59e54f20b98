import random

import pytest
from pyspark.sql import functions as F

from martloom.operators.keys import generate_keys, last_wins, upsert
from martloom.operators.loading import FILE, ROW, accepted_rows, file_statuses, fit_rows, quarantine, status_frame, total_rows
from martloom.operators.mapping import Mapping
from martloom.operators.numbering import number_rows, stage_for_numbering
from martloom.plans.migrate import Source, migrate
from martloom.sources.store import TableStore
from martloom.spec import table

SPEC = table("t", "id INTEGER, v TEXT, n INTEGER", "id", not_null=["v"])


def batch(spark, rows, schema="f string, r int, id int, v string, n string"):
    df = spark.createDataFrame(rows, schema).withColumnsRenamed({"f": FILE, "r": ROW})
    return fit_rows(df, SPEC)


def outcome(statuses):
    return {s.source_file: (s.rows, s.status, s.reason) for s in statuses}


def test_file_is_rejected_as_a_whole(spark):
    df = batch(
        spark,
        [
            ("1.csv", 1, 1, "a", "1"), ("1.csv", 2, 2, "a", None),
            ("2.csv", 1, 2, "a", "1"), ("2.csv", 2, 3, "a", "1"),
            ("3.csv", 1, 3, "a", "1"),
            ("4.csv", 1, 9, None, "1"),
            ("5.csv", 1, 10, "a", "1.5"),
            ("6.csv", 1, 11, "a", "2.0"), ("6.csv", 2, 11, "a", "1"),
        ],
    )
    statuses = file_statuses(df, SPEC)
    assert outcome(statuses) == {
        "1.csv": (2, "loaded", ""),
        "2.csv": (0, "error", "UNIQUE constraint failed: t.id"),
        "3.csv": (1, "loaded", ""),  # key 3 is free again: its file was rejected
        "4.csv": (0, "error", "NOT NULL constraint failed: t.v"),
        "5.csv": (0, "error", "datatype mismatch: t.n"),
        "6.csv": (0, "error", "UNIQUE constraint failed: t.id"),
    }
    assert sorted(r["id"] for r in accepted_rows(df, statuses, SPEC).collect()) == [1, 2, 3]
    assert outcome(file_statuses(df, SPEC, replace=True))["6.csv"] == (2, "loaded", "")
    assert total_rows(status_frame(statuses, spark)).first()[0] == 3


@pytest.mark.parametrize("per_range", [500_000, 9])
@pytest.mark.parametrize("seed", range(2))
def test_file_acceptance_equals_one_by_one_loading(spark, seed, per_range, monkeypatch):
    monkeypatch.setattr("martloom.operators.conflicts.PAIRS_PER_RANGE", per_range)
    rng = random.Random(seed)
    files = {f"{i:02d}.csv": [rng.randrange(60) for _ in range(rng.randrange(1, 6))] for i in range(20)}
    rows = [(f, i, key, "a", "1") for f, keys in files.items() for i, key in enumerate(keys)]
    taken, expected = set(), {}
    for name, keys in sorted(files.items()):
        good = len(set(keys)) == len(keys) and not taken & set(keys)
        taken |= set(keys) if good else set()
        expected[name] = "loaded" if good else "error"
    assert {s.source_file: s.status for s in file_statuses(batch(spark, rows), SPEC)} == expected


def test_long_chain_of_files(spark):
    rows = [(f"{i:03d}.csv", r, key, "a", "1") for i in range(300) for r, key in enumerate((i, i + 1))]
    statuses = file_statuses(batch(spark, rows), SPEC)
    assert [s.status for s in statuses] == ["loaded", "error"] * 150


def test_keyless_rows_never_conflict(spark):
    df = batch(spark, [("1.csv", 1, None, "a", "1"), ("1.csv", 2, None, "a", "1"), ("2.csv", 1, None, "a", "1")])
    assert {s.status for s in file_statuses(df, SPEC)} == {"loaded"}


def test_quarantine(spark):
    df = batch(
        spark,
        [
            ("2.csv", 1, 1, "late", "1"), ("1.csv", 2, 1, "later row", "1"), ("1.csv", 1, 1, "first", "1"),
            ("1.csv", 3, None, "k", "1"), ("1.csv", 4, None, "k", "1"), ("1.csv", 5, 5, None, "x"), ("1.csv", 6, 6, "a", "x"),
        ],
    )
    good, bad = quarantine(df, SPEC)
    assert sorted((r["id"], r["v"]) for r in good.collect() if r["id"]) == [(1, "first")]
    assert good.where("id is null").count() == 2
    assert sorted((r[FILE], r[ROW], r["reason"]) for r in bad.collect()) == [
        ("1.csv", 2, "duplicate_key"),
        ("1.csv", 5, "not_null: v"),
        ("1.csv", 6, "type: n"),
        ("2.csv", 1, "duplicate_key"),
    ]


def test_last_wins_and_whole_row_replace(spark):
    stored = spark.createDataFrame([(1, "a", 5), (4, "d", 6), (None, "k", 7)], "id bigint, v string, q int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (9, "z", 3), (None, "x", 4)], "id bigint, v string, o int")
    last = last_wins(new, ["id"], ["o"]).drop("o")
    found = sorted((tuple(r) for r in upsert(stored, last, ["id"]).collect()), key=repr)
    assert found == [(1, "c", None), (4, "d", 6), (9, "z", None), (None, "k", 7), (None, "x", None)]
    again = upsert(upsert(stored, last.where("id is not null"), ["id"]), last.where("id is not null"), ["id"])
    assert sorted(map(tuple, again.where("id is not null").collect())) == [(1, "c", None), (4, "d", 6), (9, "z", None)]


def test_generated_keys_are_dense(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("id"), F.format_string("%05d", F.col("id")).alias("name")
    )
    found = generate_keys(df.repartition(7), "id", order=["name"], start=10000)
    made = found.where("id > 10000").orderBy("name").collect()
    assert [r["id"] for r in made] == list(range(10001, 14001))
    assert found.where("id <= 10000").count() == 1000


def test_generated_keys_with_one_hot_order_value(spark):
    df = spark.range(20000).select(F.lit(None).cast("bigint").alias("id"), F.lit("same").alias("name"))
    found = generate_keys(df, "id", order=["name"])
    assert found.agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (20000, 1, 20000)


def test_numbers_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("martloom.operators.numbering.BROADCAST_ROWS", 0)
    staged = stage_for_numbering(spark.range(1000).repartition(5), "t")
    numbers = sorted(r["n"] for r in number_rows(staged, "n").collect())
    assert numbers == list(range(1, 1001))


@pytest.mark.parametrize("buckets", [None, 4])
def test_store_versions(spark, folder, buckets):
    store = TableStore(spark, folder + "/store", buckets)
    first = spark.createDataFrame([(i, f"a{i}", i) for i in range(100)] + [(None, "k", 1)], SPEC.spark_schema)
    assert not store.exists("t") and store.tables() == []
    store.write(SPEC, first)
    before = store.read("t")
    change = spark.createDataFrame([(i, "new", None) for i in range(90, 110)] + [(None, "k2", 2)], SPEC.spark_schema)
    store.upsert(SPEC, change)
    assert before.count() == 101  # readers of the old version are not disturbed
    now = store.read("t")
    assert (now.count(), now.where("v = 'new'").count(), now.where("id is null").count()) == (112, 20, 2)
    store.upsert(SPEC, change.where("id is not null"))
    assert sorted(map(tuple, store.read("t").collect()), key=repr) == sorted(map(tuple, now.collect()), key=repr)
    assert store.tables() == ["t"]


def test_unfinished_version_does_not_count(spark, folder):
    store = TableStore(spark, folder + "/store")
    row = spark.createDataFrame([(1, "a", 1)], SPEC.spark_schema)
    store.write(SPEC, row)
    (tmp := __import__("pathlib").Path(folder + "/store/t/v000002")).mkdir()
    (tmp / "part-0.parquet").write_bytes(b"half a file")
    assert store.read("t").count() == 1
    store.write(SPEC, row.unionAll(row.withColumn("id", F.lit(2).cast("bigint"))))
    assert store.read("t").count() == 2


def test_stored_side_of_bucketed_upsert_is_not_shuffled(spark, folder):
    store = TableStore(spark, folder + "/store", 4)
    store.write(SPEC, spark.range(1000).select("id", F.lit("a").alias("v"), F.col("id").alias("n")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(0, 1000, 7).repartition(4, "id")
        plan = store._bucketed(SPEC).join(keys, "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_new_column_is_added(spark, folder):
    store = TableStore(spark, folder + "/store")
    store.write(table("t", "id INTEGER, v TEXT", "id"), spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string"))
    store.upsert(SPEC, spark.createDataFrame([(2, "c", 5)], "id bigint, v string, n bigint"))
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a", None), (2, "c", 5)]


def test_migration(spark, folder):
    people = table("people", "person_id INTEGER, name TEXT", "person_id", not_null=["name"])
    pets = table("pets", "pet_id INTEGER, person_id INTEGER, name TEXT", "pet_id", foreign_keys={"person_id": ("people", "person_id")})
    unused = table("unused", "x INTEGER")
    sources = [
        Source("a.csv", spark.createDataFrame([(1, "1", "Ann"), (2, "2", "Bob")], "n int, id string, who string"), "n"),
        Source("b.csv", spark.createDataFrame([(1, "2", "Rob")], "n int, id string, who string"), "n"),
        Source("pets.csv", spark.createDataFrame([(1, "1", "Rex"), (2, "9", "Tom")], "n int, owner string, pet string"), "n"),
        Source("empty.csv", spark.createDataFrame([(1, None)], "n int, pet string"), "n"),
    ]
    mappings = [
        *[Mapping("people", "person_id", f, "id") for f in ("a.csv", "b.csv")],
        *[Mapping("people", "name", f, "who", "upper(who)") for f in ("a.csv", "b.csv")],
        Mapping("pets", "person_id", "pets.csv", "owner"),
        Mapping("pets", "name", "pets.csv", "pet"),
        Mapping("pets", "name", "empty.csv", "pet"),
    ]
    session, project = TableStore(spark, folder + "/s"), TableStore(spark, folder + "/p", 4)
    for _ in range(2):
        done = migrate(spark, [people, pets, unused], sources, mappings, session, project, report_path=folder + "/report")
    report = {(r["table"], r["source_file"]): (r["rows"], r["status"]) for r in spark.read.json(folder + "/report/rows_loaded").collect()}
    assert report == {
        ("people", "a.csv"): (2, "loaded"),
        ("people", "b.csv"): (0, "error"),
        ("people", "pets.csv"): (0, "skipped"),
        ("people", "empty.csv"): (0, "skipped"),
        ("pets", "a.csv"): (0, "skipped"),
        ("pets", "b.csv"): (0, "skipped"),
        ("pets", "pets.csv"): (2, "loaded"),
        ("pets", "empty.csv"): (0, "skipped"),
        **{("unused", f): (0, "skipped") for f in ("a.csv", "b.csv", "pets.csv", "empty.csv")},
    }
    kept = {(r["table"], r["source_file"]): (r["rows"], r["replaced"]) for r in done.project_report.collect()}
    assert kept == {("people", "a.csv"): (1, 1), ("people", "b.csv"): (1, 1), ("pets", "pets.csv"): (2, 0)}
    assert spark.read.json(folder + "/report/mappings").count() == len(mappings)
    assert spark.read.json(folder + "/report/run").first()["selected_tables"] == ["people", "pets", "unused"]
    checked = {r["table"]: (r["row_count"], r["fk_violations"], r["status"]) for r in done.validation.collect()}
    assert checked == {"people": (2, 0, "ok"), "pets": (2, 1, "warning"), "unused": (0, 0, "ok")}
    assert sorted(map(tuple, session.read("pets").collect())) == [(1, 1, "Rex"), (2, 9, "Tom")]
    assert sorted(map(tuple, project.read("people").collect())) == [(1, "ANN"), (2, "ROB")]
    # pets have no key of their own in the source, so a second run adds them with new keys
    assert sorted(r["pet_id"] for r in project.read("pets").collect()) == [1, 2, 3, 4]


def test_migration_of_selected_tables(spark, folder):
    a, b = table("a", "x INTEGER"), table("b", "x INTEGER")
    source = Source("f.csv", spark.createDataFrame([(1, 5)], "n int, x int"), "n")
    mappings = [Mapping("a", "x", "f.csv", "x"), Mapping("b", "x", "f.csv", "x")]
    store = TableStore(spark, folder + "/s")
    done = migrate(spark, [a, b], [source], mappings, store, tables=["b", "nonsense"])
    assert [r["table"] for r in done.validation.collect()] == ["b"]
    assert store.read("a").count() == 0 and store.read("b").count() == 1


def test_migration_of_unknown_tables_only_is_refused(spark, folder):
    a = table("a", "x INTEGER")
    source = Source("f.csv", spark.createDataFrame([(1, 5)], "n int, x int"), "n")
    store = TableStore(spark, folder + "/s")
    migrate(spark, [a], [source], [Mapping("a", "x", "f.csv", "x")], store)
    with pytest.raises(ValueError, match="nonsense"):
        migrate(spark, [a], [source], [Mapping("a", "x", "f.csv", "x")], store, tables=["nonsense"])
    assert store.read("a").count() == 1


def test_every_part_file_is_in_the_report(spark, folder):
    a = table("a", "x INTEGER")
    rows = spark.createDataFrame([(1, 5, "p1"), (1, None, "p2"), (2, None, "p2")], "n int, x int, f string")
    done = migrate(spark, [a], [Source("s.csv", rows, "n", file="f")], [Mapping("a", "x", "s.csv", "x")], TableStore(spark, folder + "/s"))
    assert sorted((r["source_file"], r["rows"], r["status"], r["reason"]) for r in done.report.collect()) == [
        ("p1", 1, "loaded", ""), ("p2", 0, "skipped", "All transformed rows were empty"),
    ]


@pytest.mark.parametrize("buckets", [None, 4])
def test_specs_are_stored_beside_the_versions(spark, folder, buckets):
    store = TableStore(spark, folder, buckets)
    links = {"v": ("other", "id"), ("id", "n"): ("pair", ("a", "b"))}
    spec = table("t", "id INTEGER, v TEXT, n INTEGER", "id", not_null=["v"], foreign_keys=links)
    store.write(spec, spark.createDataFrame([(1, "a", 1), (2, "b", 2)], spec.spark_schema))
    assert store.spec("t") == spec and store.specs() == [spec] and store.spec("absent") is None
    wider = table("t", "id INTEGER, v TEXT, more REAL", "id")
    store.upsert(wider, spark.createDataFrame([(2, "c", 0.5)], wider.spark_schema))
    stored = store.spec("t")
    assert stored.column_names == store.read("t").columns == ["id", "v", "more", "n"] and stored.primary_key == ["id"]
    assert stored.column("n").sql_type == "INTEGER" and stored.required == []
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, "a", None, 1), (2, "c", 0.5, None)]
    assert len(store.vacuum("t")) == 1 and store.spec("t") == stored
    store.publish("plain", spark.range(1))
    assert store.spec("plain") is None and store.tables() == ["plain", "t"] and store.specs() == [stored]


def fold(rows):
    """Files in order: one that repeats a key, or shares one with an accepted file before it, is rejected."""
    keys, taken, expected = {}, set(), {}
    for name, _, key, *_ in rows:
        keys.setdefault(name, []).append(key)
    for name, own in sorted(keys.items()):
        good = len(set(own)) == len(own) and not taken & set(own)
        taken |= set(own) if good else set()
        expected[name] = "loaded" if good else "error"
    return expected


@pytest.mark.parametrize("per_range", [500_000, 4000, 300])
def test_ten_thousand_files_as_the_fold_decides(spark, monkeypatch, per_range):
    draw = __import__("random").Random(per_range)
    rows = [(f"{i:05d}.csv", r, draw.randrange(9000) if r else i + 10**6, "a", "1") for i in range(10_000) for r in range(draw.choice([1, 2, 3]))]
    monkeypatch.setattr("martloom.operators.conflicts.PAIRS_PER_RANGE", 10**9 if per_range == 300 else per_range)
    if per_range == 300:  # a chain, in which every decision depends on the one before
        rows = [(f"{i:05d}.csv", r, key, "a", "1") for i in range(3000) for r, key in enumerate((i, i + 1))]
        monkeypatch.setattr("martloom.operators.conflicts.PAIRS_PER_RANGE", 1500)
    assert {s.source_file: s.status for s in file_statuses(batch(spark, rows), SPEC)} == fold(rows)


def test_one_key_in_every_file(spark):
    rows = [(f"{i:04d}.csv", r, 7 if r else i + 100, "a", "1") for i in range(2000) for r in range(2)]
    assert {s.source_file: s.status for s in file_statuses(batch(spark, rows), SPEC)} == fold(rows)


def test_decisions_that_wait_for_earlier_ranges():
    import pandas as pd

    from martloom.operators.conflicts import FILE as NAME, SET, decide

    rows = [("c", "x", False, True), ("c", "y", False, False), ("a", "z", True, False), ("b", "w", False, False), ("d", "y", False, False), ("e", "w", False, False)]
    got = decide(pd.DataFrame(rows, columns=[NAME, SET, "taken", "blocked"]))
    assert [tuple(r) for r in got.itertuples(index=False)] == [("a", False), ("b", True), ("e", False)]


def test_migration_of_sources_without_rows(spark, folder):
    a = table("a", "a_id INTEGER, x INTEGER", "a_id", not_null=["x"])
    b = table("b", "x INTEGER", foreign_keys={"x": ("a", "a_id")})
    none = spark.createDataFrame([], "n int, i int, x int, f string")
    sources = [Source("s.csv", none, "n"), Source("p.csv", none, "n", file="f")]
    mappings = [Mapping(t, c, s, c2) for t in "ab" for s in ("s.csv", "p.csv") for c, c2 in (("a_id", "i"), ("x", "x")) if (t, c) != ("b", "a_id")]
    done = migrate(spark, [a, b], sources, mappings, TableStore(spark, folder + "/s"), TableStore(spark, folder + "/p", 4))
    assert sorted(tuple(r)[:3] + (r["status"],) for r in done.report.collect()) == [("a", "s.csv", 0, "skipped"), ("b", "s.csv", 0, "skipped")]
    assert sorted((r["table"], r["row_count"], r["status"]) for r in done.validation.collect()) == [("a", 0, "ok"), ("b", 0, "ok")]
    assert done.project_report.count() == 0


def test_migration_goes_on_where_a_transformation_fails(spark, folder):
    a = table("a", "x INTEGER, y INTEGER")
    sources = [Source(f"{n}.csv", spark.createDataFrame([(1, 6, z)], "n int, i int, z int"), "n") for n, z in (("bad", 0), ("good", 2))]
    mappings = [Mapping("a", c, s.name, "i", e) for s in sources for c, e in (("x", "i / z"), ("y", "i + 1"))]
    store = TableStore(spark, folder + "/s")
    done = migrate(spark, [a], sources, mappings, store)
    assert {r["status"] for r in done.report.collect()} == {"loaded"}
    assert sorted(map(tuple, store.read("a").collect())) == [(3, 7), (6, 7)]
