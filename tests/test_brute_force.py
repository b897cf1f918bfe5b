"""Operators without a SQL oracle, checked against plain-Python reference runs on small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidepool.operators import match as MT
from tidepool.streaming import stream as ST


def greedy_reference(pairs):
    """Sequential greedy: best score first, ties by source then destination."""
    used_s, used_d, out = set(), set(), []
    for st, s, d, sc in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (st, s) in used_s or (st, d) in used_d:
            continue
        used_s.add((st, s))
        used_d.add((st, d))
        out.append((st, s, d))
    return sorted(out)


def test_greedy_matches_sequential(spark):
    random.seed(3)
    pairs = []
    for st in range(40):
        for s in range(random.randint(1, 6)):
            for d in range(random.randint(1, 6)):
                pairs.append((f"s{st}", f"a{s}", f"b{d}", round(random.choice([0.3, 0.5, 0.7, 0.9, random.random()]), 2)))
    df = spark.createDataFrame(pairs, "stream string, src_path string, dst_path string, score double") \
        .withColumn("src_type", F.lit("string")).withColumn("dst_type", F.lit("string"))
    got = sorted(tuple(r) for r in MT.assign_greedy(df).select("stream", "src_path", "dst_path").collect())
    assert got == greedy_reference(pairs)


def three_pass_reference(src, dst):
    """The matcher's three passes over one stream, sources and destinations sorted by name."""
    src, dst = sorted(src), sorted(dst)
    used, out, matched = set(), [], set()
    norm = lambda n: n.replace("-", "").replace("_", "").lower().strip()
    for sn, st in src:
        for dn, dt_ in dst:
            if dn not in used and sn == dn:
                out.append((sn, dn, 1.0 if st == dt_ else 0.9)); used.add(dn); matched.add(sn); break
    for sn, st in src:
        if sn in matched:
            continue
        for dn, dt_ in dst:
            if dn not in used and norm(sn) == norm(dn):
                out.append((sn, dn, 0.8 if st == dt_ else 0.7)); used.add(dn); matched.add(sn); break
    for sn, st in src:
        if sn in matched:
            continue
        for dn, dt_ in dst:
            if dn not in used and st == dt_ and st != "":
                out.append((sn, dn, 0.3)); used.add(dn); matched.add(sn); break
    return sorted(out)


def test_three_pass_matches_reference(spark):
    src = [("first_name", "string"), ("LastName", "string"), ("age", "integer"), ("zip", "string"), ("note", "string")]
    dst = [("first_name", "integer"), ("last-name", "string"), ("years", "integer"), ("city", "string"), ("lastname", "string")]
    s = spark.createDataFrame([("x", n, t) for n, t in src], "stream string, name string, type string")
    d = spark.createDataFrame([("x", n, t) for n, t in dst], "stream string, name string, type string")
    got = sorted((r["source_field"], r["dest_field"], r["confidence"]) for r in MT.match_three_pass(s, d).collect())
    assert got == three_pass_reference(src, dst)


def admit_reference(events, limit, window):
    out = {}
    for key in sorted({k for k, _, _ in events}):
        start, used = None, 0
        for k, t, i in sorted(e for e in events if e[0] == key):
            if start is None or t >= start + window:
                start, used = t, 0
            used += 1
            out[i] = used <= limit
    return out


def test_admission_matches_reference(spark):
    random.seed(11)
    base = dt.datetime(2024, 1, 1)
    events = [(random.randint(1, 5), base + dt.timedelta(seconds=random.randint(0, 5000)), i) for i in range(600)]
    df = spark.createDataFrame(events, "k int, ts timestamp, i int")
    got = {r["i"]: r["admitted"] for r in ST.admit(df, "k", "ts", limit=3, window_seconds=600).collect()}
    assert got == admit_reference(events, 3, dt.timedelta(seconds=600))


def test_admission_hot_and_null_keys_and_null_times(spark):
    random.seed(5)
    base = dt.datetime(2024, 1, 1)
    # key 1 holds half of the rows; second-granular times give equal timestamps
    events = [((1 if i % 2 == 0 else random.choice([2, 3, None])), base + dt.timedelta(seconds=random.randint(0, 4000)), i) for i in range(500)]
    timeless = [(1, None, 900), (None, None, 901)]
    df = spark.createDataFrame(events + timeless, "k int, ts timestamp, i int")
    got = {r["i"]: r["admitted"] for r in ST.admit(df, "k", "ts", limit=4, window_seconds=300).collect()}
    assert got == admit_reference([(-1 if k is None else k, t, i) for k, t, i in events], 4, dt.timedelta(seconds=300))
    assert sorted(r["i"] for r in ST.admission_rejects(df, "ts").collect()) == [900, 901]
