"""Edge rows of FIXTURES §4 through the function library (expected values worked out from the rules)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.functions import coerce as C
from tidepool.functions import exprfn as X
from tidepool.functions import names as N
from tidepool.functions.paths import get_path, set_path
from tidepool.functions.text import plain_number


def one(spark, col, ddl="x string", rows=None):
    df = spark.createDataFrame(rows, ddl)
    return [r[0] for r in df.select(col).collect()]


def test_plain_number(spark):
    rows = [(1e7,), (100.0,), (1.5e-7,), (2.5,), (0.1,), (1e20,), (-2.7,), (12345678.5,), (0.0,), (None,), (float("nan"),), (float("inf"),)]
    got = one(spark, plain_number(F.col("x")), "x double", rows)
    assert got == ["10000000", "100", "0.00000015", "2.5", "0.1", "100000000000000000000", "-2.7", "12345678.5", "0", None, "NaN", "+Inf"]


def test_string_to_int_strict_rules(spark):
    rows = [(" 12 ",), ("12.7",), ("-12.7",), ("\t7\n",), ("9007199254740993",), ("abc",), ("",), (None,)]
    got = one(spark, C.coerce("x", "string", "int", on_error="null"), rows=rows)
    # floats truncate toward zero; integers above 2^53 stay exact; unparseable -> null
    assert got == [12, 12, -12, 7, 9007199254740993, None, None, None]


def test_strict_raises(spark):
    df = spark.createDataFrame([("abc",)], "x string")
    with pytest.raises(Exception):
        df.select(C.coerce("x", "string", "int")).collect()


def test_unknown_pair_is_error():
    with pytest.raises(ValueError):
        C.coerce(F.col("x"), "time", "bool")


def test_string_to_bool(spark):
    rows = [("yes",), ("on",), ("t",), ("T",), ("TRUE",), ("tRUE",), ("N",), ("off",), ("maybe",), (None,)]
    got = one(spark, C.coerce("x", "string", "bool", on_error="null"), rows=rows)
    # Go forms are exact-case (tRUE is not one); yes/on/y/no/off/n in any case
    assert got == [True, True, True, True, True, None, False, False, None, None]


def test_lenient_bool_has_no_yes(spark):
    df = spark.createDataFrame([("yes",), ("true",)], "x string")
    out = C.coerce_lenient(df, {"x": "bool"}).collect()
    assert out[0]["x"] is None and out[0]["_coerce_errors"]
    assert out[1]["x"] is True and out[1]["_coerce_errors"] == []


def test_lenient_int_no_trim(spark):
    df = spark.createDataFrame([(" 12",), ("12.7",), ("12",)], "x string")
    got = [(r["x"], len(r["_coerce_errors"])) for r in C.coerce_lenient(df, {"x": "int64"}).collect()]
    assert got == [(None, 1), (12, 0), (12, 0)]


def test_lenient_timestamp_passes_unparseable(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("not a date",), ("2024-01-02",)], "x string")
    got = [r["x"] for r in C.coerce_lenient(df, {"x": "timestamp"}).collect()]
    assert got == ["2024-01-02T03:04:05Z", "not a date", "2024-01-02T00:00:00Z"]


def test_string_to_time_layouts(spark):
    rows = [("2024-01-02T03:04:05+05:00",), ("2024-01-02T03:04:05.123456789Z",), ("2024-01-02",),
            ("Mon, 02 Jan 2006 15:04:05 MST",), ("Mon, 02 Jan 2006 15:04:05 -0700",), ("1700000000",), ("2024-02-30",), ("12345x",)]
    got = one(spark, C.coerce("x", "string", "time", on_error="null"), rows=rows)
    assert got[0] == dt.datetime(2024, 1, 1, 22, 4, 5)
    assert got[1] == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    assert got[2] == dt.datetime(2024, 1, 2)
    assert got[3] == dt.datetime(2006, 1, 2, 15, 4, 5)
    assert got[4] == dt.datetime(2006, 1, 2, 22, 4, 5)
    assert got[5] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got[6] is None and got[7] is None


def test_expression_functions(spark):
    df = spark.createDataFrame([("  a b\t", None, "")], "s string, n string, e string")
    r = df.select(
        X.trim("s").alias("trim"), X.concat("s", "n", F.lit("!")).alias("concat"),
        X.coalesce("e", "n", F.lit("z")).alias("coalesce"), X.if_null("e", F.lit("z")).alias("if_null"),
        X.upper("n").alias("upper_null"), X.to_string("n").alias("to_string_null"),
        X.substring(F.lit("héllo"), 1, 3).alias("sub"), X.substring(F.lit("abc"), -5).alias("sub_neg"),
        X.substring(F.lit("abc"), 10).alias("sub_past"), X.split(F.lit("a.b.c"), ".").alias("split"),
        X.format_duration(F.lit(5025000)).alias("d1"), X.format_duration(F.lit(125000)).alias("d2"),
        X.format_duration(F.lit(5000)).alias("d3"), X.to_bool(F.lit("0")).alias("tb"),
        X.to_int(F.lit(-2.7)).alias("ti"), X.div(F.lit(1.0), F.lit(0.0), safe=True).alias("div0"),
    ).first()
    assert r["trim"] == "a b"
    assert r["concat"] == "  a b\t!"
    assert r["coalesce"] == "z" and r["if_null"] == ""
    assert r["upper_null"] == "" and r["to_string_null"] == ""
    assert r["sub"] == "éll" and r["sub_neg"] == "abc" and r["sub_past"] == ""
    assert list(r["split"]) == ["a", "b", "c"]
    assert (r["d1"], r["d2"], r["d3"]) == ("1h 23m 45s", "2m 05s", "5s")
    assert r["tb"] is False and r["ti"] == -2 and r["div0"] is None


def test_format_and_parse_date(spark):
    df = spark.createDataFrame([("2024-03-05T10:20:30+02:00",), ("03/05/2024",), ("05-Mar-2024",), ("Mar 5, 2024",)], "x string")
    got = [r[0] for r in df.select(X.format_date("x", "YYYY/MM/DD HH:mm")).collect()]
    assert got == ["2024/03/05 10:20", "2024/03/05 00:00", "2024/03/05 00:00", "2024/03/05 00:00"]
    got = [r[0] for r in df.select(X.parse_date("x")).collect()]
    assert got[0] == "2024-03-05T08:20:30Z"


def test_paths(spark):
    df = spark.createDataFrame([((("x", [1, 2]),),)], "a struct<b: struct<c: string, arr: array<int>>>")
    r = df.select(get_path("a.b.c").alias("c"), get_path("a.b.arr[1]").alias("i1"), get_path("a.b.arr[7]").alias("oob")).first()
    assert (r["c"], r["i1"], r["oob"]) == ("x", 2, None)
    out = set_path(df, "a.new.deep", F.lit(5)).select("a.new.deep", "a.b.c").first()
    assert tuple(out) == (5, "x")


def test_names(spark):
    df = spark.createDataFrame([("first_name", "FirstName", "integer", "number")], "a string, b string, ta string, tb string")
    r = df.select(N.name_similarity("a", "b").alias("s"), N.type_compat("ta", "tb").alias("t"),
                  N.type_compat("tb", "ta").alias("t2"), N.suggested_transform("ta", "tb").alias("x")).first()
    assert r["s"] == 1.0 and r["t"] == 0.9 and r["t2"] == 0.7 and r["x"] == "to_float"


def test_sql_functions(spark):
    X.register_sql_functions(spark)
    r = spark.sql("SELECT tp_name_similarity('customer_id', 'CustomerID') a, tp_format_duration(5025000) b, tp_coalesce('', 'y') c").first()
    assert (r["a"], r["b"], r["c"]) == (1.0, "1h 23m 45s", "y")
