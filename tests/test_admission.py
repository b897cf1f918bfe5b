"""Admission by composed ranges against a sequential pass, and the streaming form in any order."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.streaming import stream as ST
from tidepool.streaming.admission import Steps

BASE = dt.datetime(2024, 1, 1)


def sequential(events, limit, seconds):
    """(start, admitted) by id, event after event."""
    state, out = {}, {}
    for k, t, i in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        start, used = state.get(k, (None, 0))
        if start is None or t >= start + dt.timedelta(seconds=seconds):
            start, used = t, 0
        state[k] = start, used + 1
        out[i] = (start, used < limit)
    return out


def last_start(t, width, start):
    """Start of the window open behind the sorted times ``t``, given the one open before."""
    place = None
    for i, x in enumerate(t):
        if start is None or x >= start + width:
            start, place = x, i
    return start, place


def test_step_functions_compose():
    rng = random.Random(1)
    for _ in range(400):
        width = rng.choice([1, 3, 10, 50])
        t = np.array(sorted(rng.choices(range(60), k=rng.randint(2, 40))), np.int64)
        cuts = [0, *sorted(rng.sample(range(1, len(t)), min(len(t) - 1, rng.randint(0, 4)))), len(t)]
        whole = None
        for a, b in zip(cuts, cuts[1:]):
            part = Steps.of_events("k", t[a:b], width)
            whole = part if whole is None else whole.then(part)
        assert whole.n == len(t)
        for start in [None, *range(int(t[0]) - 70, int(t[0]) + 1)]:
            want = last_start(t.tolist(), width, start)
            got = whole.entered("k" if start is not None else None, start)
            assert got == (want if want[1] is not None else None), (t, cuts, start)
            assert whole.entered("other", start) == last_start(t.tolist(), width, None)


def test_step_functions_of_several_keys_compose():
    one, two = Steps.of_events("a", np.array([0, 5, 9]), 4), Steps.of_events("b", np.array([3, 8]), 4)
    both = one.then(two)
    assert (both.n, both.first, both.last, both.single, both.entered("a", -1)) == (5, "a", "b", False, (8, 4))
    more = both.then(Steps.of_events("b", np.array([10, 11, 12]), 4))
    assert not more.single and more.entered(None, None) == (12, 7)
    assert two.then(one).entered("b", 0) == (9, 4)
    assert Steps.of_events(None, np.array([5]), 4).then(Steps.of_events(None, np.array([6]), 4)).entered(None, 3) is None


@pytest.mark.parametrize("ranges,batch", [(1, 10_000), (7, 10_000), (40, 3)])
def test_hot_key_over_many_ranges(spark, ranges, batch):
    rng = random.Random(ranges)
    events = [(1, BASE + dt.timedelta(seconds=rng.randint(0, 3000)), i) for i in range(1500)]
    events += [(rng.choice([None, 0, 2, 3]), BASE + dt.timedelta(seconds=rng.randint(0, 900), microseconds=rng.randint(0, 3)), 2000 + i) for i in range(300)]
    df = spark.createDataFrame(events, "k long, ts timestamp, i long").repartition(6)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        for seconds in (1, 130, 5000):
            got = {r["i"]: (r["window_start"], r["admitted"]) for r in ST.admit(df, "k", "ts", 4, seconds).collect()}
            assert got == sequential(events, 4, seconds)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_no_events_and_times_far_apart(spark):
    df = spark.createDataFrame([(1, None, 1), (2, dt.datetime(1, 1, 2), 2), (2, dt.datetime(9999, 12, 30), 3), (3, BASE, 4)], "k long, ts timestamp, i long")
    assert sorted((r["i"], r["admitted"]) for r in ST.admit(df, "k", "ts", 1, 60).collect()) == [(2, True), (3, True), (4, True)]
    assert ST.admit(df.limit(0), "k", "ts", 1, 60).count() == 0
    assert ST.admit(df.where("i = 1"), "k", "ts", 1, 60).count() == 0


def test_no_round_after_the_sort(spark):
    """One range sort; what follows works on one row per range and on open rows."""
    df = spark.createDataFrame([(1, BASE + dt.timedelta(seconds=i), i) for i in range(500)], "k long, ts timestamp, i long")
    plan = ST.admit(df, "k", "ts", 4, 10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_any_order_between_batches(spark, tmpdir_path, seed):
    rng = random.Random(seed)
    events = [(rng.choice([1, 1, 1, 2, None]), BASE + dt.timedelta(seconds=rng.randint(0, 3600)), i) for i in range(400)]
    rows = [*events, (1, None, 900), (2, None, 901)]
    inp = os.path.join(tmpdir_path, "in")
    spark.createDataFrame(rows, "k long, ts timestamp, i long").repartition(6, F.xxhash64("i")).write.parquet(inp)
    # the end of the feed: a much later event moves the watermark past all others
    spark.createDataFrame([(7, BASE + dt.timedelta(days=9), 999)], "k long, ts timestamp, i long").coalesce(1).write.mode("append").parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "k long, ts timestamp, i long", max_files_per_trigger=1)
    out, late = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "rejects")
    ST.run_stream(ST.admit_ordered(src, "k", "ts", 3, 300, "i", "2 hours"), ST.batch_parquet_sink(out), os.path.join(tmpdir_path, "ck"))
    ST.run_stream(ST.admission_rejects(src, "ts"), ST.batch_parquet_sink(late), os.path.join(tmpdir_path, "ck2"))
    got = {r["i"]: (r["window_start"], r["admitted"]) for r in spark.read.parquet(out).collect() if r["i"] != 999}
    assert got == sequential(events, 3, 300)
    assert sorted(r["i"] for r in spark.read.parquet(late).collect()) == [900, 901]


def test_stream_in_any_order_releases_as_the_watermark_moves(spark, tmpdir_path):
    """Keys and ids beyond a double's digits, null ones beside them; windows stay open over batches and a restart."""
    rng = random.Random(5)
    at = sorted(rng.sample(range(10 * 3600), 600))
    events = [(rng.choice([2**60 + 1, 2**60 + 3, 7, None]), BASE + dt.timedelta(seconds=s), None if n == 300 else 2**60 + n) for n, s in enumerate(at)]
    files = [[] for _ in range(6)]
    for e, s in zip(events, at):
        files[min(5, (s + rng.randint(0, 3600)) // 7200)].append(e)
    inp, out, ck = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ck"))
    files[5].append((7, BASE + dt.timedelta(days=9), 0))
    seen = []
    for part in (files[:3], files[3:]):
        for rows in part:
            spark.createDataFrame(rows, "k long, ts timestamp, i long").coalesce(1).write.mode("append").parquet(inp)
        src = ST.read_stream(spark, inp, "parquet", "k long, ts timestamp, i long", max_files_per_trigger=1)
        ST.run_stream(ST.admit_ordered(src, "k", "ts", 3, 900, "i", "2 hours"), ST.batch_parquet_sink(out), ck)
        seen.append(spark.read.parquet(out).count())
    assert 0 < seen[0] < 300
    rows = [r for r in spark.read.parquet(out).collect() if r["i"] != 0]
    keys = {i: k for k, _, i in events}
    assert all(r["k"] == keys[r["i"]] for r in rows)
    assert len(rows) == len(events) and {r["i"]: (r["window_start"], r["admitted"]) for r in rows} == sequential(events, 3, 900)


def test_stream_in_any_order_keeps_no_state_row_per_key_or_event(spark, tmpdir_path):
    inp, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    rows = spark.range(12_000).select(F.concat(F.lit("k"), F.col("id") % 3000).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 5000).alias("ts"), F.col("id").alias("i"))
    rows.coalesce(1).write.parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "k string, ts timestamp, i long")
    q = ST.run_stream(ST.admit_ordered(src, "k", "ts", 3, 60, "i", "30 days"), ST.batch_parquet_sink(out), os.path.join(tmpdir_path, "ck"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held and 0 < max(held) < 3000
