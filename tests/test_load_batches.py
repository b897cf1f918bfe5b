"""Load batches with marks, the file ledger, bucket counts and open snapshots."""

import datetime as dt
import os

import pytest

from tidepool.operators import schema as S
from tidepool.sources.ledger import FileLedger
from tidepool.streaming import batches as LB
from tidepool.streaming import stream as ST

BASE = dt.datetime(2024, 1, 1)


def test_batches_of_a_size_or_a_time(spark):
    times = [0, 0.1, 0.2, 4.9, 5.0, 5.1, 12, 12.1, 12.2, 12.3, 12.4, 30]
    rows = [(i, BASE + dt.timedelta(seconds=s)) for i, s in enumerate(times)] + [(90, None), (91, None), (92, None)]
    df = spark.createDataFrame(rows, "i int, at timestamp").repartition(4)
    by_size = {r.i: r.load_batch for r in LB.assign_load_batches(df, ["i"], 4).collect()}
    assert by_size == {i: n // 4 for n, i in enumerate(sorted(r[0] for r in rows))}
    got = {r.i: r.load_batch for r in LB.assign_load_batches(df, ["i"], 2, "at", 5.0).collect()}
    assert got == {90: 0, 91: 0, 92: 1, 0: 2, 1: 2, 2: 3, 3: 3, 4: 4, 5: 4, 6: 5, 7: 5, 8: 6, 9: 6, 10: 7, 11: 8}
    assert LB.assign_load_batches(df.limit(0), ["i"], 2, "at").count() == 0


@pytest.mark.parametrize("fail_at", [0, 3, 6])
def test_a_replay_goes_on_at_the_first_unconfirmed_batch(spark, tmpdir_path, fail_at):
    inp, out, state, ck = (f"{tmpdir_path}/{x}" for x in ("in", "out", "state", "ck"))
    spark.range(65).repartition(3).write.parquet(inp)
    calls, write = [], LB.parquet_loader(out)

    def load(rows, batch_id, number):
        calls.append((batch_id, number))
        write(rows, batch_id, number)
        if (batch_id, number) == (0, fail_at) and calls.count((batch_id, number)) == 1:
            raise RuntimeError("away")

    run = lambda: ST.run_stream(ST.read_stream(spark, inp, "parquet", "id long"), LB.load_batches_sink(state, load, ["id"], 10), ck)
    with pytest.raises(Exception, match="away"):
        run()
    assert LB.confirmed(spark, state) == [(0, n) for n in range(fail_at)]
    run()
    assert calls == [(0, n) for n in range(fail_at + 1)] + [(0, n) for n in range(fail_at, 7)]
    rows = spark.read.parquet(out).collect()
    assert sorted(r.id for r in rows) == list(range(65)) and all(r.load_batch == r.id // 10 for r in rows)
    assert not os.path.exists(state + "/pending/0")
    spark.range(65, 70).write.mode("append").parquet(inp)
    run()
    assert spark.read.parquet(out).count() == 70 and LB.confirmed(spark, state)[-1] == (1, 0)
    run()
    assert len(calls) == 9


def test_files_are_read_exactly_once(spark, tmpdir_path):
    inp = tmpdir_path + "/in"
    ledger = FileLedger(spark, tmpdir_path + "/ledger", inp, "json")

    def put(name, ids, when=None):
        os.makedirs(inp, exist_ok=True)
        with open(f"{inp}/{name}", "w") as f:
            f.writelines(f'{{"id": {i}}}\n' for i in ids)
        if when:
            os.utime(f"{inp}/{name}", (when, when))

    def take(between=lambda: None, commit=True):
        new = ledger.list_new()
        between()
        ids = sorted(r.id for r in ledger.read(new, **{"multiLine": "false"}).collect())
        if commit:
            ledger.commit(new)
        return ids

    put("a.json", [1, 2], 1_700_000_000)
    put("skip.csv", [9], 1_700_000_000)
    assert take(lambda: put("b.json", [3], 1_700_000_000)) == [1, 2]  # b lands with a's own time
    assert take(commit=False) == [3]  # stopped before the commit
    assert take(lambda: put("c.json", [4], 1_600_000_000)) == [3]
    assert ledger.checkpoint().first()[0] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert take() == [4]  # an older time
    put("a.json", [5, 6, 7], 1_700_000_500)  # written anew
    assert take() == [5, 6, 7] and take() == []
    put("empty.json", [])  # has nothing to read
    assert ledger.list_new().count() == 0 and take() == []
    put("empty.json", [8])
    assert take() == [8]


def test_a_table_keeps_its_number_of_buckets(spark, tmpdir_path):
    rows = lambda v, n: spark.createDataFrame([(i, v, f"v{v}") for i in range(n)], "k long, at long, v string")
    ST.upsert_sink(tmpdir_path + "/t", ["k"], ["at"], 16)(rows(1, 40), 0)
    ST.upsert_sink(tmpdir_path + "/t", ["k"], ["at"], 4)(rows(2, 30), 1)
    got = [(r.k, r.v) for r in ST.latest_version(spark, tmpdir_path + "/t").collect()]
    assert sorted(got) == [(i, "v2" if i < 30 else "v1") for i in range(40)]


def test_applied_snapshots_leave_nothing_staged(spark, tmpdir_path):
    sink = ST.soft_delete_sink(tmpdir_path + "/t", ["k"], dt.datetime(2024, 1, 1))
    rows = lambda *r: spark.createDataFrame(r, "k int, snapshot_id int, snapshot_rows long")
    staged = lambda: sorted(f for d, _, _ in os.walk(tmpdir_path + "/t/_staging") for f in [os.path.basename(d)] if "snapshot_id=" in f)
    sink(rows((1, 1, 2), (1, 2, 2)), 0)
    assert staged() == ["snapshot_id=1", "snapshot_id=2"]
    sink(rows((2, 1, 2)), 1)
    assert staged() == ["snapshot_id=2"]
    sink(rows((3, 2, 2), (9, 1, 2), (4, 3, 1)), 2)
    assert staged() == []
    assert {r.k: r._deleted for r in ST.latest_version(spark, tmpdir_path + "/t").collect()} == {1: True, 2: True, 3: True, 4: False}


def test_null_keys_in_schema_versions(spark):
    fields = spark.createDataFrame([(None, "a", "int", True), ("n", "a", "int", True)], "ns string, path string, type string, nullable boolean")
    assert S.schema_diff(fields, fields, ["ns"]).isEmpty()
    versions = spark.createDataFrame([(None, 1), ("n", 1)], "ns string, version int")
    new, _, _ = S.append_versions(versions, fields.crossJoin(spark.range(1).selectExpr("1 AS version")), fields, fields.select("ns"), ["ns"])
    assert new.isEmpty()
    gone = S.schema_diff(fields, fields.where("ns IS NOT NULL"), ["ns"])
    assert {(r.ns, r.is_compatible) for r in S.compatibility(gone, fields, ["ns"]).collect()} == {(None, False), ("n", True)}


def test_one_load_takes_many_load_batches(spark, tmpdir_path):
    inp, out, state, ck = (f"{tmpdir_path}/{x}" for x in ("in", "out", "state", "ck"))
    spark.range(205).repartition(3).write.parquet(inp)
    calls, write = [], LB.parquet_loader_of_many(out)

    def load(rows, batch_id, numbers):
        calls.append((numbers[0], numbers[-1]))
        write(rows, batch_id, numbers)
        if 5 in numbers and calls.count(calls[-1]) == 1:
            raise RuntimeError("away")

    run = lambda: ST.run_stream(ST.read_stream(spark, inp, "parquet", "id long"), LB.load_batches_sink(state, load, ["id"], 10, most=4), ck)
    with pytest.raises(Exception, match="away"):
        run()
    assert LB.confirmed(spark, state) == [(0, n) for n in range(3)]
    run()
    # 21 load batches in loads of 1, 2, 4, 4, 4, 4 and what is left
    assert calls == [(0, 0), (1, 2), (3, 6), (3, 6), (7, 10), (11, 14), (15, 18), (19, 20)]
    assert LB.confirmed(spark, state) == [(0, n) for n in range(21)]
    rows = spark.read.parquet(out).collect()
    assert sorted(r.id for r in rows) == list(range(205)) and all(r.load_batch == r.id // 10 for r in rows)
    assert not os.path.exists(state + "/pending/0")
