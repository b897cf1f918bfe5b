"""Registered queries: table scans, partition plans, API pages, message logs (SRC-*), sets and windows (SET-*, WIN-*)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import partitions as P
from ..operators import runs as R
from ..sources import messages as MSG
from ..sources import pages as PG
from ..sources import tables as TB
from ..sources.tables import load
from .registry import query

D1998 = dt.datetime(1998, 1, 1)

# ------------------------------------------------------------- scans


@query("src07_full_refresh", "SELECT * FROM orders")
def _src07(spark, sf):
    return TB.read_full(spark, f"{sf}/orders.parquet")


@query("src08_incremental_cursor", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def _src08(spark, sf):
    return TB.read_incremental(load(spark, sf, "orders"), "o_orderdate", D1998, ">").select("o_orderkey", "o_orderdate")


@query("src09_inclusive_cursor", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def _src09(spark, sf):
    return TB.read_incremental(load(spark, sf, "orders"), "o_orderdate", D1998, ">=").select("o_orderkey", "o_orderdate")


@query("src10_epoch_cursor", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-11 00:00:00'")
def _src10(spark, sf):
    return TB.read_incremental_epoch(load(spark, sf, "events"), "ts", 1704931200).select("event_id", "ts")


@query("src11_bounded_range", """SELECT o_orderkey, 'fixed' AS win FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30'
UNION ALL
SELECT o_orderkey, 'lookback' AS win FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-06-30 00:00:00' AND CAST(o_orderdate AS DATE) <= DATE '1998-12-31'""")
def _src11(spark, sf):
    o = load(spark, sf, "orders")
    a = TB.read_between(o, "o_orderdate", "1997-01-01", "1997-06-30").select("o_orderkey", F.lit("fixed").alias("win"))
    b = TB.read_between(o, "o_orderdate", None, "1998-12-31", lookback_months=6).select("o_orderkey", F.lit("lookback").alias("win"))
    return a.unionByName(b)


@query("src12_pruned_fields", "SELECT o_orderkey, o_totalprice FROM orders")
def _src12(spark, sf):
    return TB.read_fields(load(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "not_declared"], key="o_orderkey")


@query("src13_next_state", "SELECT coalesce(max(o_orderdate), TIMESTAMP '1998-01-01 00:00:00') AS cursor_state FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def _src13(spark, sf):
    o = TB.read_incremental(load(spark, sf, "orders"), "o_orderdate", D1998)
    return TB.next_state(o, "o_orderdate", D1998)


TIME_BOUNDS_SQL = """WITH b AS (SELECT min(ts) AS t0, max(ts) + INTERVAL 1 SECOND AS t1, count(*) AS total FROM events),
p AS (SELECT t0, t1, greatest(CAST(ceil(total / 500.0) AS BIGINT), 1) AS n FROM b),
q AS (SELECT t0, t1, n, (epoch_us(t1) - epoch_us(t0)) // n AS step FROM p)
"""


def _time_bounds(spark, sf):
    ev = load(spark, sf, "events")
    t0, t1, total = ev.agg(F.min("ts"), F.max("ts") + F.expr("INTERVAL 1 SECOND"), F.count(F.lit(1))).first()
    return ev, t0, t1, total


@query("src14_time_partitions", TIME_BOUNDS_SQL + """SELECT CAST(least((epoch_us(ts) - epoch_us(t0)) // step, n - 1) AS INTEGER) AS partition_id,
  CAST(count(*) AS BIGINT) AS rows FROM events, q GROUP BY 1""")
def _src14(spark, sf):
    ev, t0, t1, total = _time_bounds(spark, sf)
    parts = P.assign_time_partition(ev, "ts", t0, t1, total=total, size=500)
    return parts.groupBy("partition_id").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


@query("src14_time_plan", TIME_BOUNDS_SQL + """SELECT CAST(i AS INTEGER) AS partition_id, t0 + to_microseconds(i * step) AS lo,
  CASE WHEN i = n - 1 THEN t1 ELSE t0 + to_microseconds((i + 1) * step) END AS hi
FROM q, range((SELECT n FROM q)) t(i)""")
def _src14b(spark, sf):
    _, t0, t1, total = _time_bounds(spark, sf)
    plan = P.time_partitions(spark, t0, t1, total=total, size=500)
    return plan.select("partition_id", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))


def _order_bounds(spark, sf):
    r = load(spark, sf, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count(F.lit(1))).first()
    return int(r[0]), int(r[1]), int(r[2])


ID_BOUNDS_SQL = """WITH b AS (SELECT min(o_orderkey) AS mn, max(o_orderkey) AS mx, count(*) AS total FROM orders),
p AS (SELECT mn, mx, CAST(ceil(total / 1000.0) AS BIGINT) AS n FROM b),
q AS (SELECT mn, mx, n, greatest(CAST(floor((mx - mn + 1) / n) AS BIGINT), 1) AS per FROM p),
r AS (SELECT mn, mx, per, least(n, CAST(ceil((mx - mn + 1) / per) AS BIGINT)) AS cnt FROM q)
"""


@query("src15_id_partitions", ID_BOUNDS_SQL + """SELECT CAST(least(floor((o_orderkey - mn) / per), cnt - 1) AS INTEGER) AS partition_id,
  CAST(count(*) AS BIGINT) AS rows, min(o_orderkey) AS lo_key, max(o_orderkey) AS hi_key
FROM orders, r GROUP BY 1""")
def _src15(spark, sf):
    mn, mx, total = _order_bounds(spark, sf)
    o = P.assign_id_partition(load(spark, sf, "orders"), "o_orderkey", mn, mx, total, 1000)
    return o.groupBy("partition_id").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                         F.min("o_orderkey").alias("lo_key"), F.max("o_orderkey").alias("hi_key"))


@query("src16_offset_partitions", """WITH b AS (SELECT count(*) AS total, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS n FROM orders),
q AS (SELECT total, n, total // n AS q, total % n AS rem FROM b),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r0 FROM orders)
SELECT CAST(CASE WHEN r0 < rem * (q + 1) THEN floor(r0 / (q + 1)) ELSE rem + floor((r0 - rem * (q + 1)) / q) END AS INTEGER) AS partition_id,
  CAST(count(*) AS BIGINT) AS rows, min(o_orderkey) AS lo_key, max(o_orderkey) AS hi_key
FROM o, q GROUP BY 1""")
def _src16(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    total = _order_bounds(spark, sf)[2]
    ranked = P.global_rank(o, ["o_orderkey"], "_r")
    part = P.offset_partition_of(F.col("_r") - 1, total, 1000)
    return ranked.groupBy(part.alias("partition_id")).agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                                         F.min("o_orderkey").alias("lo_key"), F.max("o_orderkey").alias("hi_key"))


@query("src17_plan_partitions", """WITH b AS (SELECT count(*) AS total FROM lineitem),
p AS (SELECT total, least(greatest(total // 1000, 1), 8) AS n FROM b)
SELECT CAST(i AS INTEGER) AS partition_id, i * (total // n) AS "offset",
  CASE WHEN i = n - 1 THEN total - i * (total // n) ELSE total // n END AS "limit"
FROM p, range(8) t(i) WHERE i < n""")
def _src17(spark, sf):
    total = load(spark, sf, "lineitem").count()
    return P.plan_partitions(spark, total, cap=8)


@query("src18_extract_parallel", ID_BOUNDS_SQL + """SELECT CAST(least(floor((o_orderkey - mn) / per), cnt - 1) AS INTEGER) AS partition_id,
  CAST(count(*) AS BIGINT) AS rows, round(sum(o_totalprice), 2) AS total_price
FROM orders, r GROUP BY 1""")
def _src18(spark, sf):
    mn, mx, total = _order_bounds(spark, sf)
    parts = P.extract_parallel(load(spark, sf, "orders"), "o_orderkey", mn, mx, total, 1000)
    return parts.groupBy("partition_id").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                             F.round(F.sum("o_totalprice"), 2).alias("total_price"))


# --------------------------------------------------------------- pages

def saved_pages(spark, sf):
    """JSON pages (at most ~100 line items each) per order; pending orders' pages lack the result array."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    packed = PG.pack_pages(li, "l_orderkey", 100, ["l_linenumber", "l_quantity"])
    j = packed.join(o, "l_orderkey")
    body = F.when(F.col("o_orderstatus") == "P", F.to_json(F.struct(F.struct(F.lit(1).alias("other")).alias("result")))) \
        .otherwise(F.to_json(F.struct(F.struct(F.col("records").alias("records")).alias("result"))))
    return j.select("l_orderkey", body.alias("body"))


@query("src19_explode_results", """SELECT l.l_orderkey, l_linenumber, l_quantity FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o_orderstatus <> 'P'""")
def _src19(spark, sf):
    return PG.explode_results(saved_pages(spark, sf), "body", "result.records", "l_linenumber INT, l_quantity DOUBLE",
                              keep=["l_orderkey"])


@query("src20_lift_struct", "SELECT o_custkey AS id, o_totalprice, o_orderstatus FROM orders")
def _src20(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                         F.struct(F.col("o_custkey").alias("id"), "o_totalprice", "o_orderstatus").alias("properties"))
    return TB.lift_struct(o, "properties", keep=["id"])


@query("src21_drop_wrapper", "SELECT o_orderkey, o_custkey FROM orders")
def _src21(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.struct(F.lit("Order").alias("type")).alias("attributes"))
    return TB.drop_wrapper(o, "attributes")


@query("src22_expand_children", """SELECT l.l_orderkey AS _parent_id, l_linenumber, l_quantity FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o_orderpriority <> '5-LOW'""")
def _src22(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    packed = PG.pack_pages(li, "l_orderkey", 100, ["l_linenumber", "l_quantity"]).withColumnRenamed("records", "children")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    parents = packed.join(o, packed.l_orderkey == o.o_orderkey).select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("id"), "children")
    return PG.expand_children(parents, "id", "children")


@query("src23_page_audit", """WITH pg AS (
  SELECT o_custkey AS stream, o_orderkey AS page_no, CAST(n AS BIGINT) AS n_records,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS next_cursor,
    o_orderpriority <> '1-URGENT' AS has_more
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = o_orderkey),
lst AS (SELECT stream, max(page_no) AS last_page FROM pg GROUP BY 1)
SELECT pg.stream, page_no, n_records, next_cursor, has_more,
  CASE WHEN NOT has_more THEN 'has_more_false' WHEN next_cursor = '' THEN 'empty_cursor' WHEN n_records < 4 THEN 'short_page'
       WHEN page_no = last_page THEN 'end_of_stream' ELSE 'continue' END AS stop_reason
FROM pg JOIN lst ON pg.stream = lst.stream""")
def _src23(spark, sf):
    o = load(spark, sf, "orders")
    n = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("bigint").alias("n_records"))
    pages = o.join(n, o.o_orderkey == n.l_orderkey).select(
        F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("page_no"), "n_records",
        F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderkey").cast("string")).alias("next_cursor"),
        (F.col("o_orderpriority") != "1-URGENT").alias("has_more"))
    return PG.page_audit(pages, "stream", "page_no", "n_records", cursor="next_cursor", has_more="has_more", page_size=4)


# ------------------------------------------------------------ messages

def message_log(spark, sf):
    """A connector message log derived from events: records, states, logs, unknown types,
    states without payload and truncated lines."""
    ev = load(spark, sf, "events")
    et = F.col("event_type")
    typ = (F.when(et.isin("click", "view"), "RECORD").when(et == "purchase", "STATE")
           .when(et == "signup", "LOG").otherwise("BOGUS"))
    rec = F.when(et.isin("click", "view", "error"), F.struct(et.alias("stream"), F.col("props").alias("data"),
                                                            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("emitted_at")))
    st = F.when((et == "purchase") & (F.col("value") <= 40), F.struct(F.lit("STREAM").alias("type"), et.alias("stream"),
                                                                     F.col("props").alias("data")))
    lg = F.when(et == "signup", F.struct(F.lit("info").alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message")))
    line = F.to_json(F.struct(typ.alias("type"), rec.alias("record"), st.alias("state"), lg.alias("log")))
    bad = (et == "error") & (F.col("user_id") % 2 == 0)
    line = F.when(bad, F.substring(line, 1, 12)).otherwise(line)
    return ev.select("event_id", line.alias("value"))


@query("src25_decode_rejects", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0")
def _src25(spark, sf):
    _, rejects = MSG.decode_messages(message_log(spark, sf), "value", keep=["event_id"])
    return rejects.select("event_id")


@query("src26_message_stats", """SELECT kind, CAST(count(*) AS BIGINT) AS messages FROM (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'record'
              WHEN event_type = 'purchase' AND value <= 40 THEN 'state'
              WHEN event_type = 'signup' THEN 'log' ELSE 'error' END AS kind
  FROM events WHERE NOT (event_type = 'error' AND user_id % 2 = 0)) GROUP BY kind""")
def _src26(spark, sf):
    good, _ = MSG.decode_messages(message_log(spark, sf), "value")
    return MSG.message_stats(good)


@query("src26_route_records", """SELECT event_type AS stream, json_extract_string(props, '$.k') AS k FROM events
WHERE event_type IN ('click', 'view')""")
def _src26b(spark, sf):
    good, _ = MSG.decode_messages(message_log(spark, sf), "value")
    recs = MSG.records_of(MSG.route_messages(good)["RECORD"])
    return recs.select("stream", F.get_json_object("data", "$.k").alias("k"))


# ---------------------------------------------------------------- sets

@query("set01_concat_parts", "SELECT o_orderkey, o_orderstatus FROM orders")
def _set01(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    # parts by the statuses that are there, one more for rows without any
    found = [r[0] for r in o.select("o_orderstatus").where("o_orderstatus IS NOT NULL").distinct().collect()]
    parts = [o.filter(F.col("o_orderstatus") == s) for s in found] + [o.filter(F.col("o_orderstatus").isNull())]
    return R.concat_parts(*parts)


@query("set02_ragged_union", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment, CAST(NULL AS INTEGER) AS s_nationkey FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def _set02(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                           F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                           F.col("s_acctbal").alias("balance"), "s_nationkey")
    return R.ragged_union(c, s)


# ------------------------------------------------------------- windows

@query("win01_latest_run", """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1""")
def _win01(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.latest_run(o, "o_custkey", "o_orderdate", "o_orderkey")


@query("win02_run_list", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 5 OFFSET 1""")
def _win02(spark, sf):
    o = load(spark, sf, "orders")
    return R.run_list(o, "o_custkey", 7, "o_orderdate", "o_orderkey", limit=5, offset=1).select("o_orderkey", "o_orderdate")


@query("win03_paginate", """SELECT o_orderkey, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS total,
  CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS total_pages
FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def _win03(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    return R.paginate(o, ["o_orderkey"], page=3, size=20)


@query("win04_sort_rank", """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY coalesce(o_orderpriority, ''), o_orderkey) AS BIGINT) AS sort_rank
FROM orders""")
def _win04(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return R.sort_rank(o, "o_orderpriority", "o_orderkey").select("o_orderkey", "sort_rank")


@query("win05_audit_history", """SELECT event_id, ts FROM events WHERE event_type = 'error'
ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 10""")
def _win05(spark, sf):
    from ..operators.mapping import audit_filter

    ev = audit_filter(load(spark, sf, "events"), event_type="error")
    return R.history(ev, "ts", "event_id", offset=10, limit=25).select("event_id", "ts")


@query("win06_latest_progress", """SELECT user_id, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _win06(spark, sf):
    ev = load(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return R.latest_per_key(ev, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("win07_recent_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def _win07(spark, sf):
    return R.history(load(spark, sf, "events"), "ts", "event_id", limit=10).select("event_id", "ts")


@query("win08_run_logs_paged", """SELECT event_id, ts FROM events WHERE user_id = 7
ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10""")
def _win08(spark, sf):
    ev = load(spark, sf, "events").filter(F.col("user_id") == 7)
    p, s = R.clamp_page(2, 10)
    return R.history(ev, "ts", "event_id", offset=(p - 1) * s, limit=s).select("event_id", "ts")
