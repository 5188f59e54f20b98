import pytest

from martloom.operators.mapping import Mapping, drop_empty, failing_mappings, map_columns, select_mappings, without_failing
from martloom.spec import table

SPEC = table("t", "id INTEGER, v REAL, w TEXT", "id")


def m(target, source, transformation=None, file="a.csv", spec="t"):
    return Mapping(spec, target, file, source, transformation)


def apply(df, *mappings):
    return map_columns(df, list(mappings), SPEC)


def test_selection_last_wins_keeps_place():
    chosen = select_mappings(
        [m("id", "x"), m("v", "y"), m("id", "z"), m("w", None), m("w", "q", file="b.csv"), m("w", "q", spec="u")], "t", "a.csv"
    )
    assert [(c.target_column, c.source_column) for c in chosen] == [("id", "z"), ("v", "y")]


def test_transformation_and_fallback(spark):
    df = spark.createDataFrame([(3, "x")], "id int, `odd name` string")
    out = apply(df, m("id", "id", "id * 2"), m("v", "id", "no_col + 1"), m("w", "odd name", "`odd name` || '!'"))
    assert tuple(out.first()) == (6, 3, "x!")
    out = apply(df, m("id", "id", "id +* 2"), m("v", "gone", "also_gone"), m("w", "gone"))
    assert tuple(out.first()) == (3, None, None)
    assert out.dtypes == [("id", "int"), ("v", "double"), ("w", "string")]


def test_boolean_and_text_expressions(spark):
    df = spark.createDataFrame([("Ab", 2)], "s string, n int")
    out = apply(df, m("id", "n", "n > 1 and s = 'Ab'"), m("v", "n", "n / 4"), m("w", "s", "lower(s)"))
    assert tuple(out.first()) == (True, 0.5, "ab")


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (None, None, "k"), (None, 2.0, "k")], "id int, v double, other string")
    chosen = [m("id", "id"), m("v", "v")]
    kept = drop_empty(map_columns(df, chosen, SPEC, keep=["other"]), chosen)
    assert sorted(kept.collect(), key=repr) == [("k", 1, None), ("k", None, 2.0)]


def test_no_mapping_is_an_error(spark):
    with pytest.raises(ValueError):
        map_columns(spark.range(1), [], SPEC)


@pytest.mark.parametrize(
    "text",
    ["sum(id)", "count(*)", "id + max(id)", "explode(array(1, 2))", "explode(split(s, ' '))", "row_number() over (order by id)",
     "(select 1)", "id + ( SELECT max(id) from x)", "exists (select 1)", "id in (select 1)", "stack(2, 1, 2)"],
)
def test_expressions_of_several_rows_give_the_plain_column(spark, text):
    df = spark.createDataFrame([(3, "x y"), (4, "z")], "id int, s string")
    assert sorted(tuple(r) for r in apply(df, m("w", "s"), m("id", "id", text)).collect()) == [("x y", 3), ("z", 4)]


def test_words_of_a_subquery_inside_quotes_are_text(spark):
    df = spark.createDataFrame([(3, "x")], "id int, s string")
    assert apply(df, m("w", "s", "concat(s, '(select')")).first()[0] == "x(select"


def test_values_that_fail_give_the_plain_column(spark):
    df = spark.createDataFrame([(1, 1, "7"), (4, 0, "b"), (None, None, None)], "id int, z int, s string")
    mappings = [m("id", "id", "id % z"), m("v", "z", "cast(s as int)"), m("w", "s", "id = 1 and s"), m("x", "id", "id + 1", spec="t"), m("y", "id", "2147483647 + id")]
    assert failing_mappings(df, mappings) == [mappings[i] for i in (0, 1, 2, 4)]
    got = map_columns(df, without_failing(df, mappings), SPEC).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 1, "7", 2, 1), (4, 0, "b", 5, 4), (None, None, None, None, None)]
    assert failing_mappings(df.where("z = 1"), mappings) == [mappings[2], mappings[4]]
    assert failing_mappings(df.limit(0), mappings) == []
