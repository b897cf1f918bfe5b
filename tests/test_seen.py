"""Membership filter and distinct-count state across batches."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators.seen import BLOCK_BITS, SeenKeys, UniqueCount, build_filter, filter_size, mark_seen, merge_filters


@pytest.mark.parametrize("n,fpp", [(1000, 0.01), (50_000, 0.01), (50_000, 0.1), (20_000, 0.001)])
def test_false_positives_stay_within_the_rate(spark, n, fpp):
    size = filter_size(n, fpp)
    held = build_filter(spark.range(n).select(F.concat(F.lit("k"), "id").alias("k")), ["k"], size).cache()
    assert held.count() == size.blocks and held.select(F.max(F.length("bits"))).first()[0] * 8 == BLOCK_BITS
    inside = mark_seen(spark.range(n).select(F.concat(F.lit("k"), "id").alias("k")), ["k"], held, size)
    assert inside.where(~F.col("maybe")).isEmpty()  # never misses a key
    tried = 200_000
    wrong = mark_seen(spark.range(tried).select(F.concat(F.lit("other"), "id").alias("k")), ["k"], held, size).where("maybe").count()
    assert wrong <= tried * fpp + 4 * (tried * fpp) ** 0.5, wrong / tried


def test_sizes_and_odd_parameters():
    assert filter_size(0, 5) == filter_size() == filter_size(1000, 0.01)
    assert filter_size(1000, 0.01).hashes == 7 and filter_size(10**9, 0.01).bytes > 1_100_000_000


def test_merged_filters_hold_both(spark):
    size = filter_size(5000, 0.01)
    a, b = spark.range(2000).toDF("k"), spark.range(2000, 4000).toDF("k")
    both = merge_filters(build_filter(a, ["k"], size), build_filter(b, ["k"], size))
    assert mark_seen(a.unionByName(b), ["k"], both, size).where(~F.col("maybe")).isEmpty()
    one = build_filter(a.unionByName(b), ["k"], size)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, one.collect()))


def test_new_keys_over_batches_until_reset(spark, tmpdir_path):
    rng = random.Random(3)
    state = SeenKeys(spark, tmpdir_path + "/seen", ["a", "b"], n=50, fpp=0.3)  # far too small on purpose
    seen = set()
    for number in range(5):
        rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "", "x", "y", f"n{number}"]), i) for i in range(60)]
        df = spark.createDataFrame(rows, "a int, b string, i int").repartition(3)
        got = state.new_rows(df, ["i"])
        want = {}
        for a, b, i in rows:
            if (a, b) not in seen and (a, b) not in want:
                want[a, b] = i
        assert {(r.a, r.b): r.i for r in got.collect()} == want
        assert state.add(got, f"batch{number}") and not state.add(got, f"batch{number}")
        seen |= set(want)
        assert state.count() == len(seen)
    # without the second check nothing seen comes back, and only some new keys are lost
    fresh = spark.createDataFrame([(100 + i, "z", i) for i in range(40)] + [(1, "x", 99)], "a int, b string, i int")
    quick = {r.a for r in state.new_rows(fresh, ["i"], recheck=False).collect()}
    assert 1 not in quick and quick <= set(range(100, 140))
    state.reset()
    assert state.count() == 0 and state.new_rows(fresh, ["i"]).count() == 41


def test_large_filters_are_joined_by_block(spark, monkeypatch):
    from tidepool.operators import seen

    monkeypatch.setattr(seen, "BROADCAST_BYTES", 0)
    size = filter_size(50_000, 0.01)
    held = build_filter(spark.range(1000).toDF("k"), ["k"], size)
    assert mark_seen(spark.range(2000).toDF("k"), ["k"], held, size).where("maybe").count() < 1100


def test_count_over_batches(spark, tmpdir_path):
    state = UniqueCount(spark, tmpdir_path + "/count", ["k"])
    assert tuple(state.count().first()) == (0, 0, 0)
    for i in range(5):
        batch = spark.range(i * 8000, i * 8000 + 20_000).select((F.col("id") % 40_000).alias("k"))
        state.add(batch, str(i))
        state.add(batch, str(i))  # a replay
    n, rows, batches = state.count().first()
    assert (rows, batches) == (100_000, 5) and abs(n - 40_000) < 40_000 * 4 * 1.04 / 64
    state.reset()
    state.add(spark.createDataFrame([(None,), (None,), (1,)], "k long"), "0")
    assert tuple(state.count().first()) == (2, 3, 1)
