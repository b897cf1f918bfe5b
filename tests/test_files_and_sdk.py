"""File sources (ragged CSV, malformed JSON) and the connector SDK round trip."""

import os

from tidepool.sources import files as FL
from tidepool.sources import pysource as PS


def test_ragged_csv_and_headerless(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "s.csv")
    with open(p, "w") as fh:
        fh.write(" id , name \n1,a\n2,b,extra1,extra2\n3\n")
    df = FL.read_csv(spark, tmpdir_path, ",", header=True)
    assert df.columns == ["id", "name", "_col2", "_col3"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("1", "a", None, None), ("2", "b", "extra1", "extra2"), ("3", None, None, None)]
    nh = FL.read_csv(spark, tmpdir_path, ",", header=False)
    assert nh.columns == ["col_0", "col_1", "col_2", "col_3"] and nh.count() == 4


def test_json_lines_skip_bad_and_array_file_drops_whole(spark, tmpdir_path):
    lines = os.path.join(tmpdir_path, "lines")
    os.makedirs(lines)
    with open(os.path.join(lines, "a.jsonl"), "w") as fh:
        fh.write('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert sorted(r[0] for r in FL.read_json(spark, lines, schema="a long").collect()) == [1, 3]
    arr = os.path.join(tmpdir_path, "arr")
    os.makedirs(arr)
    with open(os.path.join(arr, "good.json"), "w") as fh:
        fh.write('[{"a": 1},\n {"a": 2}]')
    with open(os.path.join(arr, "bad.json"), "w") as fh:
        fh.write('[{"a": 5},\n {"a": ]')
    assert sorted(r[0] for r in FL.read_json(spark, arr, layout="array", schema="a long").collect()) == [1, 2]


def test_python_connector_round_trip(spark, tmpdir_path):
    PS.register(spark)
    sink = os.path.join(tmpdir_path, "sink")
    spark.range(500).selectExpr("id", "id * 2 AS v").write.format("tidepool_parquet_sink").option("path", sink).mode("append").save()
    back = spark.read.parquet(*PS.committed_files(sink))
    assert back.count() == 500
    src = spark.read.format("tidepool_parquet").option("path", os.path.join(sink, "_data")).load()
    assert src.filter("id >= 400").count() == 100


def _written(monkeypatch, spark, query, sf="/root/testdata/sf0.01"):
    """Rows of a file query, and the data files it wrote."""
    from tidepool.plans import q_files as Q

    dirs, new = [], Q._dir
    monkeypatch.setattr(Q, "_dir", lambda *a: dirs.append(new(*a)) or dirs[-1])
    rows = getattr(Q, query)(spark, sf).collect()
    return rows, [os.path.join(at, f) for d in dirs for at, _, names in os.walk(d.removeprefix("file:")) for f in names if f.startswith("part-")]


def test_array_files_are_bounded(spark, monkeypatch):
    from tidepool.plans import q_files as Q

    monkeypatch.setattr(Q, "ARRAY_RECORDS", 100, raising=False)
    rows, files = _written(monkeypatch, spark, "_src01d")
    arrays = [t for f in files if (t := open(f).read()).lstrip().startswith("[")]
    assert len(arrays) > 20 and max(t.count('"event_id"') for t in arrays) <= 100
    want = {r.event_type: (r.n, r.ids) for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").groupBy("event_type").agg({"event_id": "sum", "*": "count"}).toDF("event_type", "ids", "n").collect()}
    assert {r.event_type: (r.n, r.ids) for r in rows} == want


def test_a_stream_is_written_by_many_tasks(spark, monkeypatch):
    rows, files = _written(monkeypatch, spark, "_src05")
    for r in rows:
        mine = [f for f in files if f"/{r.stream}/" in f and f.endswith(".json")]
        assert len(mine) == r.files and len({os.path.basename(f).split("-")[1] for f in mine}) > 1
        assert max(len(open(f).readlines()) for f in mine) <= 500


def test_csv_is_split_where_no_cell_holds_a_line_end(spark, tmpdir_path):
    import os

    plain, quoted = tmpdir_path + "/plain", tmpdir_path + "/quoted"
    for folder, note in ((plain, '"a ""b"", c"'), (quoted, '"two\nlines"')):
        os.makedirs(folder)
        with open(folder + "/x.csv", "w") as f:
            f.write("id,note\n" + "".join(f"{i},{note if i % 50 == 0 else 'x'}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frames = [FL.read_csv(spark, p) for p in (plain, quoted)]
        assert [f.count() for f in frames] == [20_000, 20_000]
        assert [f.where("id = '50'").first()["note"] for f in frames] == ['a "b", c', "two\nlines"]
        tasks = [f.rdd.getNumPartitions() for f in frames]
        assert tasks[0] > 4 and tasks[1] == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_width_from_the_lines(spark, tmpdir_path, monkeypatch):
    """Without a header and quotes the widest record is known from the lines: no pass over the records for it."""
    cases = {"plain": ("a,b\n,,,\n\n \t \nx" + "," * 69 + "y\n1,,\n", 70, 4), "empty": ("", 0, 0), "quoted": ('"a,b",c\n"d,e,f,",,\n', 2, 2), "ends": ('"a\nb",c\nd,e,f\n', 3, 2)}
    for name, (text, width, rows) in cases.items():
        d = os.path.join(tmpdir_path, name)
        os.makedirs(d)
        with open(os.path.join(d, "f.csv"), "w", newline="") as f:
            f.write(text)
        asked = []
        monkeypatch.setattr(FL.F, "array_max", lambda *a, real=FL.F.array_max: asked.append(1) or real(*a))
        df = FL.read_csv(spark, d, ",", header=False)
        monkeypatch.undo()
        assert (len(df.columns), not asked) == (width, name in ("plain", "empty")), name
        if width:
            got = [tuple(r) for r in df.collect()]
            assert len(got) == rows, (name, got)
            if name == "plain":
                assert sorted(r[0] or "" for r in got) == ["", "1", "a", "x"] and any(r[69] == "y" for r in got)
