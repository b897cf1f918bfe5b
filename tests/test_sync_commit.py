"""The sync job's commit: stops after every step, failed loads, attempts that race."""

import datetime as dt
import glob
import os
import shutil

import pytest

from tidepool.model import FieldMapping, StreamConfig, SyncConfig
from tidepool.plans.sync import STEPS, RunTaken, clean_sync, execute_sync, read_commits, read_runs, read_table
from tidepool.session import write_once

FIRST = [(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 3)]
SECOND = [*FIRST, (2, "B", 4), (4, None, 5), (1, None, 6)]
DDL = "id long, v string, ts long"


def config(mode):
    full = mode == "soft_delete"
    maps = [FieldMapping(c, c) for c in ("id", "v", "ts")]
    return SyncConfig("s", StreamConfig("t", ["id"], None if full else "ts", "full_refresh" if full else "incremental", mode, maps), dedup_order_by=["ts"])


def run(spark, mode, home, rows, **options):
    if mode == "soft_delete" and rows is SECOND:
        rows = [r for r in SECOND if r[0] != 3][2:]
    return execute_sync(spark.createDataFrame(rows, DDL), config(mode), home, deleted_at=dt.datetime(2024, 1, 1), **options).first()


def table(spark, home):
    found = read_table(spark, home)
    return None if found is None else sorted(map(str, map(tuple, found.collect())))


def stop_at(wanted):
    def told(step, folder):
        if step == wanted:
            raise KeyboardInterrupt(step)

    return told


@pytest.mark.parametrize("mode", ["append", "upsert", "merge", "soft_delete"])
def test_a_stop_after_any_step_changes_nothing(spark, tmpdir_path, mode):
    plain, home = tmpdir_path + "/plain", tmpdir_path + "/stopped"
    tables = []
    for rows in (FIRST, SECOND):
        run(spark, mode, plain, rows)
        tables.append(table(spark, plain))
    before = None
    for rows, after in zip((FIRST, SECOND), tables):
        for step in STEPS[:-1]:
            with pytest.raises(KeyboardInterrupt):
                run(spark, mode, home, rows, on_step=stop_at(step))
            assert table(spark, home) == before
        with pytest.raises(KeyboardInterrupt):
            run(spark, mode, home, rows, on_step=stop_at("committed"))
        assert table(spark, home) == after
        before = after
    runs = [tuple(r) for r in read_runs(spark, home).orderBy("run").collect()]
    assert runs == [tuple(r) for r in read_runs(spark, plain).orderBy("run").collect()] and len(runs) == 2
    if mode != "soft_delete":  # nothing is read twice after the commit
        assert run(spark, mode, home, SECOND)["records_extracted"] == 0


@pytest.mark.parametrize("mode", ["append", "upsert"])
def test_a_failed_load_is_not_visible_and_comes_again(spark, tmpdir_path, mode):
    home = tmpdir_path + "/home"

    def lose_rows(step, folder):
        if step == "written":
            for f in glob.glob(folder + "/data/*.parquet"):
                os.remove(f)

    # at first there is no table to fall back to, later there is one
    failed = execute_sync(spark.createDataFrame([(i, "x", i) for i in range(10)], DDL), config("append"), home, on_step=lose_rows).first()
    assert (failed["status"], failed["records_loaded"], failed["checkpoint"]) == ("failed", 0, None)
    assert failed["discrepancy"] == "record count mismatch: expected 10, got 0 (delta: 10)"
    assert read_table(spark, home) is None
    good = execute_sync(spark.createDataFrame([(i, "x", i) for i in range(10)], DDL), config(mode), home).first()
    assert (good["run"], good["status"], good["records_loaded"]) == (2, "completed", 10)
    assert read_table(spark, home).count() == 10
    assert [r["status"] for r in read_runs(spark, home).orderBy("run").collect()] == ["failed", "completed"]


def test_one_of_two_attempts_commits(spark, tmpdir_path):
    home = tmpdir_path + "/home"

    def other_first(step, folder):
        if step == "state":
            run(spark, "append", home, FIRST)

    with pytest.raises(RunTaken):
        run(spark, "append", home, FIRST, on_step=other_first)
    assert read_table(spark, home).count() == 4 and read_runs(spark, home).count() == 1


def test_clean_up_and_earlier_versions(spark, tmpdir_path):
    home = tmpdir_path + "/home"
    with pytest.raises(KeyboardInterrupt):
        run(spark, "upsert", home, FIRST, on_step=stop_at("state"))
    run(spark, "upsert", home, FIRST)
    first = table(spark, home)
    run(spark, "upsert", home, SECOND)
    second = table(spark, home)
    assert sorted(map(str, map(tuple, read_table(spark, home, run=1).collect()))) == first != second
    assert clean_sync(spark, home, keep_versions=0) == 1 and len(os.listdir(home + "/attempts")) == 2
    assert clean_sync(spark, home) == 1 and table(spark, home) == second
    assert run(spark, "upsert", home, SECOND)["records_extracted"] == 0
    assert table(spark, home) == second and read_commits(spark, home).count() == 3


def test_batches_of_other_columns(spark, tmpdir_path):
    home = tmpdir_path + "/home"
    run(spark, "append", home, FIRST)
    wide = config("append")
    wide.stream.mappings.append(FieldMapping("w", "w"))
    execute_sync(spark.createDataFrame([(9, "z", 9, 1)], DDL + ", w int"), wide, home)
    assert {(r.id, r.w) for r in read_table(spark, home).collect()} == {(1, None), (2, None), (3, None), (None, None), (9, 1)}


def test_write_once(spark, tmpdir_path):
    path = tmpdir_path + "/c/1.json"
    assert write_once(spark, path, "é") and not write_once(spark, path, "b")
    assert open(path).read() == "é" and os.listdir(os.path.dirname(path)).count("1.json") == 1
    assert not [f for f in os.listdir(os.path.dirname(path)) if f.endswith(".tmp")]
    shutil.rmtree(tmpdir_path)
