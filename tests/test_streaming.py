"""Streaming runs equal their batch counterparts."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tidepool.streaming import stream as ST


def test_stream_dedup_equals_batch_distinct(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    inp = os.path.join(tmpdir_path, "in")
    for part in range(3):
        rows = [(i, base + dt.timedelta(minutes=part * 10 + i % 5)) for i in range(part * 50, part * 50 + 60)]
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "id long, ts timestamp", max_files_per_trigger=1)
    out = os.path.join(tmpdir_path, "out")
    ST.run_stream(ST.stream_dedup(src, ["id"], "ts", "1 hour"), ST.batch_parquet_sink(out), os.path.join(tmpdir_path, "ck"))
    got = sorted(r[0] for r in spark.read.parquet(out).select("id").collect())
    want = sorted(r[0] for r in spark.read.parquet(inp).select("id").distinct().collect())
    assert got == want


def test_checkpoint_replay_is_noop(spark, tmpdir_path):
    inp = os.path.join(tmpdir_path, "in")
    spark.range(100).write.parquet(inp)
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    for _ in range(2):
        ST.run_stream(ST.read_stream(spark, inp, "parquet", "id long"), ST.batch_parquet_sink(out), ck)
    assert spark.read.parquet(out).count() == 100


def test_admit_stream_equals_batch(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(seconds=i * 37), i) for i in range(90)]
    inp = os.path.join(tmpdir_path, "in")
    spark.createDataFrame(rows, "k long, ts timestamp, i long").coalesce(1).write.parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "k long, ts timestamp, i long")
    out = os.path.join(tmpdir_path, "out")
    ST.run_stream(ST.admit_stream(src, "k", "ts", 2, 300, "i"), ST.batch_parquet_sink(out), os.path.join(tmpdir_path, "ck"))
    got = {r["i"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    batch = {r["i"]: r["admitted"] for r in ST.admit(spark.read.parquet(inp), "k", "ts", 2, 300).collect()}
    assert got == batch


def test_webhook_rejects(spark):
    df = spark.createDataFrame([("hubspot", "[]"), ("hubspot", '[{"objectId": 1, "propertyName": "a"}]'),
                                ("salesforce", "{}"), ("zendesk", '{"event_type": "x"}'), ("other", "{}")], "source string, body string")
    events, rejects = ST.parse_webhooks(df)
    assert events.count() == 2 and rejects.count() == 3
    assert F is not None


def test_older_change_never_replaces_a_newer_row(spark, tmpdir_path):
    target = os.path.join(tmpdir_path, "t")
    sink = ST.upsert_sink(target, ["k"], ["ts"], buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "k long, ts long, v string")
    sink(batch([(i, 5, "first") for i in range(20)] + [(None, 5, "null key")]), 0)
    sink(batch([(1, 9, "new"), (2, 3, "old"), (None, 9, "newer"), (30, 1, "added"), (3, 5, "tie")]), 1)
    sink(batch([(1, 9, "replayed with other rows")]), 1)  # committed already: nothing happens
    got = {r.k: (r.ts, r.v) for r in ST.latest_version(spark, target).collect()}
    assert got[1] == (9, "new") and got[2] == (5, "first") and got[None] == (9, "newer") and got[30] == (1, "added") and got[3] == (5, "tie")
    assert len(got) == 22


def test_snapshot_is_applied_when_complete(spark, tmpdir_path):
    target = os.path.join(tmpdir_path, "t")
    sink = ST.soft_delete_sink(target, ["k"], dt.datetime(2024, 2, 1))
    rows = lambda ids, number, size: spark.createDataFrame([(i, f"v{number}", number, size) for i in ids], "k long, v string, snapshot_id int, snapshot_rows long")
    sink(rows([1, 2, 3], 1, 3), 0)
    sink(rows([2], 2, 2), 1)  # half of the second snapshot
    assert {r.k: r._deleted for r in ST.latest_version(spark, target).collect()} == {1: False, 2: False, 3: False}
    sink(rows([4], 2, 2), 2)
    assert {r.k: (r.v, r._deleted) for r in ST.latest_version(spark, target).collect()} == {1: ("v1", True), 2: ("v2", False), 3: ("v1", True), 4: ("v2", False)}
    sink(rows([1], 3, 1), 3)
    got = {r.k: (r._deleted, r._deleted_at) for r in ST.latest_version(spark, target).collect()}
    assert got[1] == (False, None) and got[2][0] and got[3] == (True, dt.datetime(2024, 2, 1))


def test_late_keys_are_kept(spark, tmpdir_path):
    inp, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    day = dt.datetime(2024, 1, 10)
    for rows in ([(1, day)], [(2, day + dt.timedelta(days=3))], [(3, day - dt.timedelta(days=2)), (1, day)]):
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "id long, ts timestamp", max_files_per_trigger=1)
    ST.run_stream(ST.stream_dedup(src, ["id"]), ST.batch_parquet_sink(out), os.path.join(tmpdir_path, "ck"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_admit_stream_in_any_order_inside_a_batch(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(seconds=(i * 7919) % 3331), i) for i in range(200)] + [(1, None, 900)]
    inp, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    spark.createDataFrame(rows, "k long, ts timestamp, i long").repartition(3).write.parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "k long, ts timestamp, i long")
    ST.run_stream(ST.admit_stream(src, "k", "ts", 2, 300, "i"), ST.batch_parquet_sink(out), os.path.join(tmpdir_path, "ck"))
    got = {r["i"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert got == {r["i"]: r["admitted"] for r in ST.admit(spark.read.parquet(inp), "k", "ts", 2, 300).collect()}
