"""Text keys are compared by a hash first; passes over field tables read each table once."""

from pyspark.sql import functions as F

from tidepool.operators import dedup as D
from tidepool.operators import match as MT
from tidepool.operators.conflict import null_safe_join
from tidepool.operators.keys import key_join


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_three_pass_works_out_each_pass_once(spark):
    """Odd groups: uneven sides, several fields of one normal name, null and empty types, a null stream."""
    s = [("a", "x_1", "string"), ("a", "X-1", "string"), ("a", "same", "integer"), ("a", "p", "number"), ("a", "q", "number"), ("a", "r", None), ("a", "t", ""), (None, "n", "array"), ("b", "only", "array")]
    d = [("a", "x1", "integer"), ("a", "same", "string"), ("a", "k", "number"), ("a", "m", None), ("a", "o", ""), (None, "n", "array"), ("c", "only", "array")]
    ddl = "stream string, name string, type string"
    out = MT.match_three_pass(spark.createDataFrame(s, ddl), spark.createDataFrame(d, ddl))
    got = sorted((r["stream"], r["source_field"], r["dest_field"], r["confidence"]) for r in out.collect())
    assert got == [("a", "X-1", "x1", 0.7), ("a", "p", "k", 0.3), ("a", "same", "same", 0.9)]
    assert _plan(out).count("Join ") == 0


def test_text_keys_are_compared_by_hash_first(spark):
    a = spark.createDataFrame([("k1", 1, 5), (None, 1, 6), ("", 2, 7), ("k1", 1, 4)], "k string, n int, v int")
    b = spark.createDataFrame([("k1", 1, "x"), (None, 1, "y"), ("", 2, "z")], "k string, n bigint, w string")
    first = D.dedup_by_key(a, ["k", "n"], ["v"])
    assert sorted((str(r["k"]), r["v"]) for r in first.collect()) == [("", 7), ("None", 6), ("k1", 4)]
    assert "xxhash64(k" in _plan(first)
    for join, n in ((key_join, 3), (null_safe_join, 4)):
        j = join(a, b, ["k", "n"])
        assert j.columns == ["k", "n", "v", "w"] and j.count() == n and "xxhash64(k" in _plan(j)
    # texts against numbers are compared as before: no hash is equal for both
    c = a.select(F.col("n").cast("string").alias("n"), "v")
    assert key_join(c, b.select("n", "w"), ["n"]).count() == a.select("n", "v").join(b.select("n", "w"), "n").count()


def test_one_aggregate_finds_both_catalogs(spark):
    from tidepool.plans import q_schema as Q

    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(repr, df.select(*Q.FIELD_COLS).collect()))
    v1, v2 = Q.catalogs(spark, sf)
    assert rows(v1) == rows(Q.catalog_v1(spark, sf)) and rows(v2) == rows(Q.catalog_v2(spark, sf))
    assert "Join " not in _plan(v1.unionByName(v2.select(*v1.columns)))


def test_first_rows_of_several_choices(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 9, "n")], "k string, v int, w string")
    out = D.first_rows(df, ["k"], {"low": (F.struct("k", "w"), F.struct("v"), None), "odd": (F.struct("w"), F.struct("v"), F.col("v") > 2)})
    got = {r["low"]["k"]: (r["low"]["w"], r["odd"] and r["odd"]["w"]) for r in out.collect()}
    assert got == {"a": ("y", "x"), "b": ("z", None), None: ("n", "n")}


def test_first_order_without_a_row(spark):
    """What orders the rows is the row itself; the keys come with it."""
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 9, "n")], "k string, v int, w string")
    out = D.first_rows(df, ["k"], {"low": (None, F.struct("v", "w"), None), "odd": (None, F.struct("v", "w"), F.col("v") > 2)})
    got = {r["k"]: (tuple(r["low"]), r["odd"] and tuple(r["odd"])) for r in out.collect()}
    assert got == {"a": ((1, "y"), (3, "x")), "b": ((2, "z"), None), None: ((9, "n"), (9, "n"))}
    assert "min_by" not in out._jdf.queryExecution().optimizedPlan().toString()
