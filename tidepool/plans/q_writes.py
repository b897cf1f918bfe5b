"""Registered queries: conflict resolution (CON-*) and write modes (SNK-2..12).

Two copies of one table (FIXTURES §3): ``source`` is ``customer``; ``dest``
drops keys divisible by 7, changes balances of keys divisible by 5, blanks
the segment of keys divisible by 3 and adds keys from a shifted range. Each
side carries its own update time, so either side can be newer and some
times tie.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import conflict as CF
from ..operators import partitions as P
from ..operators import writes as W
from ..sources.tables import load
from .registry import query

SHIFT = 10_000_000


def source_copy(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment",
                    (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(hours=(F.col("c_custkey") % 13).cast("int"))).alias("updated_at"))


def dest_copy(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    kept = c.filter(k % 7 != 0).select(
        "c_custkey", "c_name",
        F.when(k % 5 == 0, F.col("c_acctbal") + 100.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(hours=(k % 17).cast("int"))).alias("updated_at"))
    added = c.filter(k % 11 == 0).select((k + SHIFT).alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment",
                                         F.lit(dt.datetime(2024, 1, 2)).alias("updated_at"))
    return kept.unionByName(added)


COPIES_SQL = f"""WITH src AS (
  SELECT c_custkey, c_name, c_acctbal, c_mktsegment, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 13 AS BIGINT)) AS updated_at FROM customer),
dst AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100.0 ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
    TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 17 AS BIGINT)) AS updated_at FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL
  SELECT c_custkey + {SHIFT}, c_name, c_acctbal, c_mktsegment, TIMESTAMP '2024-01-02' FROM customer WHERE c_custkey % 11 = 0),
j AS (SELECT s.c_custkey, s.c_name AS s_name, s.c_acctbal AS s_bal, s.c_mktsegment AS s_seg, s.updated_at AS s_ts,
             d.c_name AS d_name, d.c_acctbal AS d_bal, d.c_mktsegment AS d_seg, d.updated_at AS d_ts
      FROM src s JOIN dst d ON s.c_custkey = d.c_custkey
      WHERE s.c_name IS DISTINCT FROM d.c_name OR s.c_acctbal IS DISTINCT FROM d.c_acctbal OR s.c_mktsegment IS DISTINCT FROM d.c_mktsegment)
"""

KEYS = ["c_custkey"]
COLS = ["c_name", "c_acctbal", "c_mktsegment"]


def _conflicts(spark, sf):
    return CF.find_conflicts(source_copy(spark, sf), dest_copy(spark, sf), KEYS, "updated_at")


@query("con01_find_conflicts", COPIES_SQL + "SELECT c_custkey, s_bal AS source_balance, d_bal AS dest_balance, s_ts AS source_ts, d_ts AS dest_ts FROM j")
def _con01(spark, sf):
    return _conflicts(spark, sf).select("c_custkey", F.col("source.c_acctbal").alias("source_balance"),
                                        F.col("dest.c_acctbal").alias("dest_balance"), "source_ts", "dest_ts")


def _resolved(spark, sf, strategy):
    r = CF.resolve(_conflicts(spark, sf), strategy, COLS)
    return r.select("c_custkey", "winner", F.col("resolved.c_acctbal").alias("balance"), F.col("resolved.c_mktsegment").alias("segment"))


@query("con02_source_wins", COPIES_SQL + "SELECT c_custkey, 'SOURCE' AS winner, s_bal AS balance, s_seg AS segment FROM j")
def _con02(spark, sf):
    return _resolved(spark, sf, "source_wins")


@query("con03_last_write_wins", COPIES_SQL + """SELECT c_custkey, CASE WHEN s_ts >= d_ts THEN 'SOURCE' ELSE 'DEST' END AS winner,
  CASE WHEN s_ts >= d_ts THEN s_bal ELSE d_bal END AS balance, CASE WHEN s_ts >= d_ts THEN s_seg ELSE d_seg END AS segment FROM j""")
def _con03(spark, sf):
    return _resolved(spark, sf, "last_write_wins")


@query("con04_dest_wins", COPIES_SQL + "SELECT c_custkey, 'DEST' AS winner, d_bal AS balance, d_seg AS segment FROM j")
def _con04(spark, sf):
    return _resolved(spark, sf, "dest_wins")


@query("con05_merge", COPIES_SQL + """SELECT c_custkey, 'MERGED' AS winner,
  CASE WHEN s_ts >= d_ts THEN coalesce(s_bal, d_bal) ELSE coalesce(d_bal, s_bal) END AS balance,
  CASE WHEN s_ts >= d_ts THEN coalesce(s_seg, d_seg) ELSE coalesce(d_seg, s_seg) END AS segment FROM j""")
def _con05(spark, sf):
    return _resolved(spark, sf, "merge")


TWO_WAY_SQL = COPIES_SQL.replace("j AS (SELECT s.c_custkey", "jj AS (SELECT s.c_custkey").split("jj AS")[0] + """f AS (
  SELECT coalesce(s.c_custkey, d.c_custkey) AS c_custkey, s.c_custkey IS NOT NULL AS in_s, d.c_custkey IS NOT NULL AS in_d,
    s.c_acctbal AS s_bal, d.c_acctbal AS d_bal, s.updated_at AS s_ts, d.updated_at AS d_ts,
    (s.c_name IS NOT DISTINCT FROM d.c_name AND s.c_acctbal IS NOT DISTINCT FROM d.c_acctbal
     AND s.c_mktsegment IS NOT DISTINCT FROM d.c_mktsegment) AS equal
  FROM src s FULL OUTER JOIN dst d ON s.c_custkey = d.c_custkey)
"""


@query("con06_skip", TWO_WAY_SQL + """SELECT CASE WHEN in_s AND NOT in_d THEN 'to_dest' WHEN in_d AND NOT in_s THEN 'to_source'
  WHEN equal THEN 'none' ELSE 'skipped' END AS action, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1""")
def _con06(spark, sf):
    r = CF.sync_two_way(source_copy(spark, sf), dest_copy(spark, sf), KEYS, "updated_at", "skip")
    return r.groupBy("action").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("con07_two_way", TWO_WAY_SQL + """SELECT c_custkey,
  CASE WHEN in_s AND NOT in_d THEN 'to_dest' WHEN in_d AND NOT in_s THEN 'to_source' WHEN equal THEN 'none' ELSE 'resolved' END AS action,
  CASE WHEN in_s AND in_d AND NOT equal THEN CASE WHEN s_ts >= d_ts THEN 'SOURCE' ELSE 'DEST' END END AS winner,
  CASE WHEN in_s AND NOT in_d THEN s_bal WHEN in_d AND NOT in_s THEN d_bal WHEN equal THEN s_bal
       WHEN s_ts >= d_ts THEN s_bal ELSE d_bal END AS balance
FROM f""")
def _con07(spark, sf):
    r = CF.sync_two_way(source_copy(spark, sf), dest_copy(spark, sf), KEYS, "updated_at", "last_write_wins")
    return r.select("c_custkey", "action", "winner", F.col("record.c_acctbal").alias("balance"))


@query("con07_two_way_summary", TWO_WAY_SQL + """SELECT
  CAST(count(*) FILTER (WHERE in_s AND NOT in_d) AS BIGINT) AS forward_changes,
  CAST(count(*) FILTER (WHERE in_d AND NOT in_s) AS BIGINT) AS reverse_changes,
  CAST(count(*) FILTER (WHERE in_s AND in_d AND NOT equal) AS BIGINT) AS conflicts_found,
  CAST(count(*) FILTER (WHERE in_s AND in_d AND NOT equal) AS BIGINT) AS conflicts_resolved FROM f""")
def _con07b(spark, sf):
    r = CF.sync_two_way(source_copy(spark, sf), dest_copy(spark, sf), KEYS, "updated_at", "last_write_wins")
    return CF.two_way_summary(r)


@query("con08_key_semi", COPIES_SQL + "SELECT c_custkey FROM src WHERE c_custkey IN (SELECT c_custkey FROM dst)")
def _con08a(spark, sf):
    return CF.matched(source_copy(spark, sf), dest_copy(spark, sf), KEYS).select("c_custkey")


@query("con08_key_anti", COPIES_SQL + "SELECT c_custkey FROM dst WHERE c_custkey NOT IN (SELECT c_custkey FROM src)")
def _con08b(spark, sf):
    return CF.unmatched(dest_copy(spark, sf), source_copy(spark, sf), KEYS).select("c_custkey")


# ------------------------------------------------------------------ SNK

@query("snk02_append", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def _snk02(spark, sf):
    t = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                           F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                              F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return W.append(t, rows)


def changes_with_versions(spark, sf):
    """dest copy as a change batch, with a second later version for keys divisible by 5."""
    d = dest_copy(spark, sf)
    v2 = d.filter(F.col("c_custkey") % 5 == 0).withColumn("c_acctbal", F.col("c_acctbal") + 1.0) \
        .withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY"))
    return d.unionByName(v2)


CHANGES_SQL = COPIES_SQL.split("j AS (")[0].rstrip().rstrip(",") + """,
ch AS (SELECT * FROM dst UNION ALL
       SELECT c_custkey, c_name, c_acctbal + 1.0, c_mktsegment, updated_at + INTERVAL 1 DAY FROM dst WHERE c_custkey % 5 = 0)
"""


@query("snk03_upsert", CHANGES_SQL + """SELECT c_custkey, c_acctbal, c_mktsegment FROM (
  SELECT *, 0 AS tag FROM src UNION ALL SELECT *, 1 AS tag FROM ch)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY tag DESC, CASE WHEN tag = 1 THEN updated_at END DESC) = 1""")
def _snk03(spark, sf):
    out = W.upsert(source_copy(spark, sf), changes_with_versions(spark, sf), KEYS, ["updated_at"])
    return out.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("snk04_merge", CHANGES_SQL + """, u AS (SELECT c_custkey, c_acctbal, c_mktsegment, 0 AS tag, CAST(NULL AS TIMESTAMP) AS o FROM src
  UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 1, updated_at FROM ch)
SELECT c_custkey, arg_max(c_acctbal, (tag, o)) FILTER (WHERE c_acctbal IS NOT NULL) AS c_acctbal,
  arg_max(c_mktsegment, (tag, o)) FILTER (WHERE c_mktsegment IS NOT NULL) AS c_mktsegment
FROM u GROUP BY c_custkey""")
def _snk04(spark, sf):
    t = source_copy(spark, sf).select("c_custkey", "c_acctbal", "c_mktsegment")
    out = W.merge(t, changes_with_versions(spark, sf), KEYS, ["updated_at"])
    return out.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("snk05_soft_delete", """SELECT c_custkey, c_custkey % 7 = 0 AS _deleted,
  CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS _deleted_at FROM customer""")
def _snk05(spark, sf):
    t = source_copy(spark, sf).select("c_custkey")
    return W.soft_delete(t, dest_copy(spark, sf), KEYS, dt.datetime(2024, 2, 1))


@query("snk06_route_writes", f"""SELECT 'create' AS route, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 11 = 0 AND c_mktsegment <> 'AUTOMOBILE'
UNION ALL SELECT 'update', CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment <> 'AUTOMOBILE'
UNION ALL SELECT 'rejected', CAST(count(*) AS BIGINT) FROM (
  SELECT c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 11 = 0)
  WHERE c_mktsegment = 'AUTOMOBILE'""")
def _snk06(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    updates = c.filter(k % 7 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("stream"), "c_name", "c_acctbal")
    creates = c.filter(k % 11 == 0).select(F.lit(None).cast("bigint").alias("id"), F.col("c_mktsegment").alias("stream"),
                                           "c_name", "c_acctbal")
    writable = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    routes = W.route_writes(updates.unionByName(creates), "id", "stream", writable)
    parts = [v.select(F.lit(name).alias("route")) for name, v in routes.items()]
    return W.union_all(parts).groupBy("route").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("snk07_batches", """SELECT CAST(floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) / 1000) AS BIGINT) AS batch_id,
  l_orderkey, l_linenumber FROM lineitem""")
def _snk07(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return P.assign_batches(li, ["l_orderkey", "l_linenumber"], 1000)


@query("snk07_batch_sizes", """SELECT batch_id, CAST(count(*) AS BIGINT) AS batch_rows FROM (
  SELECT CAST(floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) / 1000) AS BIGINT) AS batch_id FROM lineitem)
GROUP BY batch_id""")
def _snk07b(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return P.batch_sizes(P.assign_batches(li, ["l_orderkey", "l_linenumber"], 1000))


@query("snk08_dead_letters", """WITH li AS (SELECT *, CAST(floor(l_orderkey / 100) AS BIGINT) AS batch FROM lineitem),
fb AS (SELECT DISTINCT batch FROM li WHERE l_tax > 0.079),
e AS (SELECT li.*, (l_quantity > 45) AS e1, (l_discount > 0.095) AS e2, fb.batch IS NOT NULL AS e3
      FROM li LEFT JOIN fb ON li.batch = fb.batch)
SELECT CASE WHEN e1 OR e2 OR e3 THEN 'dead' ELSE 'good' END AS outcome,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(e1 AS INT) + CAST(e2 AS INT) + CAST(e3 AS INT)) AS BIGINT) AS n_errors
FROM e GROUP BY 1""")
def _snk08(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("batch", F.floor(F.col("l_orderkey") / 100).cast("bigint"))
    good, dead = W.split_rejects(li, {"quantity over 45": F.col("l_quantity") > 45, "discount over 0.095": F.col("l_discount") > 0.095},
                                 batch_col="batch", batch_failed=F.col("l_tax") > 0.079, failed_at=dt.datetime(2024, 1, 1))
    g = good.agg(F.lit("good").alias("outcome"), F.count(F.lit(1)).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_errors"))
    d = dead.agg(F.lit("dead").alias("outcome"), F.count(F.lit(1)).cast("bigint").alias("n"), F.sum(F.size("errors")).cast("bigint").alias("n_errors"))
    return g.unionByName(d).filter(F.col("n") > 0)


@query("snk09_reconcile", """WITH e AS (SELECT o_orderpriority, count(*) AS expected FROM orders GROUP BY 1),
a AS (SELECT o_orderpriority, count(*) AS actual FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT coalesce(e.o_orderpriority, a.o_orderpriority) AS o_orderpriority, CAST(coalesce(expected, 0) AS BIGINT) AS expected,
  CAST(coalesce(actual, 0) AS BIGINT) AS actual, CAST(0 AS BIGINT) AS errors, coalesce(expected, 0) = coalesce(actual, 0) AS confirmed,
  CASE WHEN coalesce(expected, 0) <> coalesce(actual, 0) THEN printf('record count mismatch: expected %d, got %d (delta: %d)',
       coalesce(expected, 0), coalesce(actual, 0), coalesce(expected, 0) - coalesce(actual, 0)) END AS discrepancy
FROM e FULL OUTER JOIN a ON e.o_orderpriority = a.o_orderpriority""")
def _snk09(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    loaded = o.join(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return W.reconcile(o, loaded, "o_orderpriority")


@query("snk10_write_totals", """SELECT CAST(sum(n) AS BIGINT) AS records_written, CAST(count(err) AS BIGINT) AS errors FROM (
  SELECT l_orderkey, count(*) AS n, CASE WHEN bool_or(l_returnflag = 'R') THEN 'rejected' END AS err FROM lineitem GROUP BY 1)""")
def _snk10(spark, sf):
    per = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("records_written"),
        F.when(F.bool_or(F.col("l_returnflag") == "R"), F.lit("rejected")).alias("error"))
    return W.write_totals(per)


@query("snk11_save_state", """WITH cur AS (SELECT o_custkey, o_orderpriority, max(o_orderdate) AS cursor_state FROM orders
  WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2),
nw AS (SELECT o_custkey, o_orderpriority, max(o_orderdate) AS cursor_state FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT coalesce(n.o_custkey, c.o_custkey) AS o_custkey, coalesce(n.o_orderpriority, c.o_orderpriority) AS o_orderpriority,
  coalesce(n.cursor_state, c.cursor_state) AS cursor_state
FROM cur c FULL OUTER JOIN nw n ON c.o_custkey = n.o_custkey AND c.o_orderpriority = n.o_orderpriority""")
def _snk11(spark, sf):
    o = load(spark, sf, "orders")
    k = ["o_custkey", "o_orderpriority"]
    cur = o.filter(F.col("o_orderdate") < dt.datetime(1998, 1, 1)).groupBy(*k).agg(F.max("o_orderdate").alias("cursor_state"))
    new = o.filter(F.col("o_orderdate") >= dt.datetime(1998, 1, 1)).groupBy(*k).agg(F.max("o_orderdate").alias("cursor_state"))
    return W.save_state(cur, new, k, ["cursor_state"])


@query("snk12_merge_states", """SELECT CASE WHEN event_type = 'signup' THEN '__global' ELSE event_type END AS stream,
  arg_max(props, event_id) AS data, max(event_id) AS seq FROM events GROUP BY 1""")
def _snk12(spark, sf):
    ev = load(spark, sf, "events").select(F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("event_type")).alias("stream"),
                                          F.col("props").alias("data"), F.col("event_id").alias("seq"))
    return W.merge_states(ev, "stream", "data", "seq")


# ------------------------------------------------------- null keys and streams

def _keyed(df):
    """Composite key (c_custkey, part) whose second column is null for every fourth key."""
    return df.withColumn("part", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 3))


NULL_KEYS = ["c_custkey", "part"]
NULL_KEY_SQL = COPIES_SQL.split("j AS (")[0].rstrip().rstrip(",") + """,
s2 AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 END AS part FROM src),
d2 AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 END AS part FROM dst),
f AS (SELECT coalesce(s.c_custkey, d.c_custkey) AS c_custkey, coalesce(s.part, d.part) AS part, s.c_custkey IS NOT NULL AS in_s, d.c_custkey IS NOT NULL AS in_d,
    s.c_acctbal AS s_bal, d.c_acctbal AS d_bal,
    (s.c_name IS NOT DISTINCT FROM d.c_name AND s.c_acctbal IS NOT DISTINCT FROM d.c_acctbal AND s.c_mktsegment IS NOT DISTINCT FROM d.c_mktsegment) AS equal
  FROM s2 s FULL OUTER JOIN d2 d ON s.c_custkey = d.c_custkey AND s.part IS NOT DISTINCT FROM d.part)
"""


@query("con01_null_keys", NULL_KEY_SQL + "SELECT c_custkey, part, s_bal AS source_balance, d_bal AS dest_balance FROM f WHERE in_s AND in_d AND NOT equal")
def _con01_null(spark, sf):
    r = CF.find_conflicts(_keyed(source_copy(spark, sf)), _keyed(dest_copy(spark, sf)), NULL_KEYS, "updated_at")
    return r.select("c_custkey", "part", F.col("source.c_acctbal").alias("source_balance"), F.col("dest.c_acctbal").alias("dest_balance"))


@query("con07_null_keys", NULL_KEY_SQL + """SELECT c_custkey, part,
  CASE WHEN in_s AND NOT in_d THEN 'to_dest' WHEN in_d AND NOT in_s THEN 'to_source' WHEN equal THEN 'none' ELSE 'resolved' END AS action FROM f""")
def _con07_null(spark, sf):
    return CF.sync_two_way(_keyed(source_copy(spark, sf)), _keyed(dest_copy(spark, sf)), NULL_KEYS, "updated_at").select("c_custkey", "part", "action")


@query("con08_null_keys", NULL_KEY_SQL + "SELECT c_custkey, part FROM f WHERE in_s AND NOT in_d")
def _con08_null(spark, sf):
    return CF.unmatched(_keyed(source_copy(spark, sf)), _keyed(dest_copy(spark, sf)), NULL_KEYS).select("c_custkey", "part")


@query("snk05_null_keys", NULL_KEY_SQL + "SELECT c_custkey, part, NOT in_d AS _deleted FROM f WHERE in_s")
def _snk05_null(spark, sf):
    out = W.soft_delete(_keyed(source_copy(spark, sf)), _keyed(dest_copy(spark, sf)), NULL_KEYS, dt.datetime(2024, 2, 1))
    return out.select("c_custkey", "part", "_deleted")


@query("snk06_null_stream", """SELECT CASE WHEN stream IS NULL OR stream = 'AUTOMOBILE' THEN 'rejected' WHEN c_custkey % 2 = 0 THEN 'update' ELSE 'create' END AS route,
  CAST(count(*) AS BIGINT) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS stream FROM customer) GROUP BY 1""")
def _snk06_null(spark, sf):
    c = load(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("id"),
                                           F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("stream"), "c_name")
    routes = W.route_writes(c, "id", "stream", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    parts = [v.select(F.lit(name).alias("route")) for name, v in routes.items()]
    return W.union_all(parts).groupBy("route").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("snk09_null_stream", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS stream FROM customer),
e AS (SELECT stream, count(*) AS expected FROM c GROUP BY 1), a AS (SELECT stream, count(*) AS actual FROM c WHERE c_custkey % 7 <> 0 OR stream IS NULL GROUP BY 1),
er AS (SELECT stream, count(*) AS errors FROM c WHERE c_custkey % 30 = 0 GROUP BY 1)
SELECT e.stream, CAST(expected AS BIGINT) AS expected, CAST(coalesce(actual, 0) AS BIGINT) AS actual, CAST(coalesce(errors, 0) AS BIGINT) AS errors,
  expected = coalesce(actual, 0) AND coalesce(errors, 0) = 0 AS confirmed
FROM e LEFT JOIN a ON e.stream IS NOT DISTINCT FROM a.stream LEFT JOIN er ON e.stream IS NOT DISTINCT FROM er.stream""")
def _snk09_null(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("stream"))
    loaded = c.filter((F.col("c_custkey") % 7 != 0) | F.col("stream").isNull())
    return W.reconcile(c, loaded, "stream", c.filter(F.col("c_custkey") % 30 == 0)).drop("discrepancy")
