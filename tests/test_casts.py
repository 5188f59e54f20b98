import datetime

from pyspark.sql import functions as F

from martloom.functions.casts import STRICT, clean_text, fit, to_integer, to_real
from martloom.functions.display import display, json_text, real_text
from martloom.functions.missing import NA_TOKENS, na_to_null
from martloom.spec import INTEGER, REAL, TEXT, type_class


def values(spark, items, schema, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"), df.schema["v"].dataType)).collect()]


TEXTS = ["12abc", " 7 ", "3.9", "-4.2x", "abc", "", None, "1e3", "99999999999999999999", "-99999999999999999999", "+5"]


def test_integer_lenient(spark):
    expected = [12, 7, 3, -4, 0, 0, None, 1, 9223372036854775807, -9223372036854775808, 5]
    assert values(spark, TEXTS, "string", to_integer) == expected


def test_integer_strict(spark):
    expected = [None, 7, None, None, None, None, None, None, None, None, 5]
    assert values(spark, TEXTS, "string", lambda c, t: to_integer(c, t, STRICT)) == expected


def test_integer_from_reals(spark):
    items = [3.9, -3.9, 1e30, -1e30, float("nan"), None]
    assert values(spark, items, "double", to_integer) == [3, -3, 2**63 - 1, -(2**63), None, None]


def test_integer_from_other_types(spark):
    assert values(spark, [True, False, None], "boolean", to_integer) == [1, 0, None]
    assert values(spark, [datetime.date(1996, 1, 2)], "date", to_integer) == [1996]


def test_real(spark):
    texts = ["1.5x", " 2 ", ".5", "1e2", "1e", "x", "", None, "-3.25"]
    assert values(spark, texts, "string", to_real) == [1.5, 2.0, 0.5, 100.0, 1.0, 0.0, 0.0, None, -3.25]
    assert values(spark, texts, "string", lambda c, t: to_real(c, t, STRICT)) == [
        None, 2.0, 0.5, 100.0, None, None, None, None, -3.25,
    ]


def test_clean_text(spark):
    assert values(spark, ["  x ", "   ", "\ta", None, "x y"], "string", clean_text) == ["x", None, "\ta", None, "x y"]
    assert values(spark, [True, False], "boolean", clean_text) == ["1", "0"]


def test_real_text(spark):
    items = [1.0, 10000000.0, 12345678.9, 1e15, 1.5e-5, 0.00012, 0.0, -2.5e8, 1e300]
    assert values(spark, items, "double", lambda c, t: real_text(c)) == [
        "1.0", "10000000.0", "12345678.9", "1.0e+15", "1.5e-05", "0.00012", "0.0", "-250000000.0", "1.0e+300",
    ]


def test_fit_keeps_only_lossless(spark):
    texts = ["12", "12.0", "1e3", "12.5", "x", None, "99999999999999999999"]
    assert values(spark, texts, "string", lambda c, t: fit(c, t, INTEGER)) == [12, 12, 1000, None, None, None, None]
    assert values(spark, [3.0, 3.5], "double", lambda c, t: fit(c, t, INTEGER)) == [3, None]
    assert values(spark, ["1.5", "x"], "string", lambda c, t: fit(c, t, REAL)) == [1.5, None]
    assert values(spark, [1.5], "double", lambda c, t: fit(c, t, TEXT)) == ["1.5"]


def test_type_class_order():
    declared = ["INTEGER", "bigint", "POINT", "REAL", "double", "DECIMAL(10,2)", "numeric", "TEXT", "", None, "DATE"]
    expected = ["integer", "integer", "integer", "real", "real", "real", "real", "text", "text", "text", "text"]
    assert [type_class(d) for d in declared] == expected


def test_json_text(spark):
    schema = "s struct<z: array<int>, a: string, b: struct<q: boolean>, d: double>, m map<string, int>"
    row = ({"z": [1, None], "a": 'x"\n', "b": {"q": True}, "d": 1.0}, {"y": 2, "x": 1})
    df = spark.createDataFrame([row, ({"z": None, "a": None, "b": None, "d": None}, None)], schema)
    found = df.select(*[json_text(F.col(f.name), f.dataType) for f in df.schema.fields]).collect()
    assert tuple(found[0]) == ('{"a": "x\\"\\n", "b": {"q": true}, "d": 1.0, "z": [1, null]}', '{"x": 1, "y": 2}')
    assert tuple(found[1]) == ("{}", None)


def test_display(spark):
    assert values(spark, [True, None], "boolean", display) == ["True", None]
    assert values(spark, [[1, 2]], "array<int>", display) == ["[1, 2]"]


def test_missing_tokens(spark):
    kept = ["na", "0", " ", "none", "x"]
    found = values(spark, [*NA_TOKENS, *kept], "string", lambda c, t: na_to_null(c))
    assert found == [None] * len(NA_TOKENS) + kept
