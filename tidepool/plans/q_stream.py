"""Registered queries: connector SDK (SRC-24, SNK-14), streaming (DED-7, STR-1..7)
and data-quality checks (DQ-1..4).

Streaming queries land driver-table rows as files in a fresh folder under
the checkpoint directory, run a stream over them to completion
(``availableNow``) and return what the sink holds.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..model import FieldMapping
from ..operators import quality as Q
from ..operators.mapping import map_strict
from ..operators.runs import latest_per_key
from ..session import local_path, scratch_path
from ..sources import messages as MSG
from ..sources import pysource as PS
from ..sources.tables import load
from ..streaming import batches as LB
from ..streaming import stream as ST
from .registry import query


def _dir(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------ connector SDK

@query("src24_python_source", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def _src24(spark, sf):
    PS.register(spark)
    d = _dir(spark, "pysource")
    load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").repartition(4).write.parquet(d)
    df = spark.read.format("tidepool_parquet").option("path", local_path(d)).load()
    return df.filter(F.col("o_orderdate") > dt.datetime(1998, 1, 1))


@query("snk14_python_sink", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _snk14(spark, sf):
    PS.register(spark)
    d = local_path(_dir(spark, "pysink"))
    load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.format("tidepool_parquet_sink") \
        .option("path", d).mode("append").save()
    return spark.read.parquet(*PS.committed_files(d))


# ---------------------------------------------------------------- streaming

EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


FILES = 8


def _event_files(spark, sf, with_copies=False):
    """Events shuffled over many files, so that arrival order has nothing to do
    with event time; queries read one file per trigger."""
    ev = load(spark, sf, "events")
    if with_copies:
        ev = ev.unionByName(ev.filter(F.col("event_type") == "purchase").withColumn("value", F.col("value") + 1.0))
    d = _dir(spark, "stream-in")
    ev.repartition(FILES, F.xxhash64("event_id", "value")).write.parquet(d)
    return d


def _drain(spark, df, name):
    out = _dir(spark, f"{name}-out")
    ST.run_stream(df, ST.batch_parquet_sink(out), _dir(spark, f"{name}-ckpt"))
    return spark.read.parquet(out)


@query("str01_stream_sync", "SELECT event_id, event_type FROM events")
def _str01(spark, sf):
    src = ST.read_stream(spark, _event_files(spark, sf), "parquet", EVENTS_DDL, max_files_per_trigger=1)
    return _drain(spark, src.select("event_id", "event_type"), "str01").select("event_id", "event_type")


@query("str01_row_bound", "SELECT CAST(count(*) AS BIGINT) AS rows, true AS within_bound FROM events")
def _str01b(spark, sf):
    """Load batches (files) hold at most DEFAULT_MAX_ROWS rows."""
    src = ST.read_stream(spark, _event_files(spark, sf), "parquet", EVENTS_DDL, max_files_per_trigger=4)
    out = _dir(spark, "str01b-out")
    ST.run_stream(src.select("event_id"), ST.batch_parquet_sink(out, max_rows=ST.DEFAULT_MAX_ROWS), _dir(spark, "str01b-ckpt"))
    per = spark.read.parquet(out).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").cast("bigint").alias("rows"), (F.max("n") <= ST.DEFAULT_MAX_ROWS).alias("within_bound"))


@query("str01_load_batches", f"""SELECT CAST(k AS BIGINT) AS load_batch, CAST(count(*) AS BIGINT) AS rows, min(event_id) AS first_id, max(event_id) AS last_id
FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // {ST.DEFAULT_MAX_ROWS} AS k FROM events) GROUP BY 1""")
def _str01c(spark, sf):
    """One micro-batch of all files; the load that holds its third load batch fails once, and the stream is
    started again."""
    d, state, out, ckpt = _event_files(spark, sf), _dir(spark, "str01c-state"), _dir(spark, "str01c-out"), _dir(spark, "str01c-ckpt")
    write, failed = LB.parquet_loader_of_many(out), []

    def load_once_failing(rows, batch_id, numbers):
        write(rows, batch_id, numbers)
        if 2 in numbers and not failed:
            failed.append(numbers)
            raise RuntimeError("the destination went away")

    for _ in range(2):
        src = ST.read_stream(spark, d, "parquet", EVENTS_DDL).select("event_id")
        try:
            ST.run_stream(src, LB.load_batches_sink(state, load_once_failing, ["event_id"], most=LB.MOST_AT_ONCE), ckpt)
        except Exception as e:  # noqa: BLE001 - the planned failure only
            if "the destination went away" not in str(e):
                raise
    done = spark.createDataFrame(LB.confirmed(spark, state), "batch_id int, load_batch int")
    loaded = spark.read.schema("event_id long, batch_id int, load_batch int").parquet(out).join(done, ["batch_id", "load_batch"], "left_semi")
    return loaded.groupBy(F.col("load_batch").cast("long").alias("load_batch")).agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("ded07_stream_dedup", "SELECT event_id FROM events")
def _ded07(spark, sf):
    src = ST.event_time(ST.read_stream(spark, _event_files(spark, sf, True), "parquet", EVENTS_DDL, max_files_per_trigger=1), "ts")
    return _drain(spark, ST.stream_dedup(src.select("event_id", "ts"), ["event_id"]), "ded07").select("event_id")


@query("str02_stream_transform", """SELECT event_id, user_id AS user_ref, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  upper(event_type) AS stream FROM events""")
def _str02(spark, sf):
    src = ST.event_time(ST.read_stream(spark, _event_files(spark, sf, True), "parquet", EVENTS_DDL, max_files_per_trigger=1), "ts")
    src = src.withColumn("payload", F.from_json("props", "k STRING"))
    maps = [FieldMapping("event_id", "event_id"), FieldMapping("user_id", "user_ref", "rename"),
            FieldMapping("payload.k", "k", "cast", cast_type="int"),
            FieldMapping("event_type", "stream", "expression", expression="upper"), FieldMapping("ts", "ts")]
    mapped = ST.stream_dedup(map_strict(src, maps), ["event_id"])
    return _drain(spark, mapped, "str02").select("event_id", "user_ref", "k", "stream")


@query("str03_exactly_once", "SELECT event_id FROM events")
def _str03(spark, sf):
    inp = _dir(spark, "str03-in")
    ev = load(spark, sf, "events").select("event_id", "event_type")
    ev.filter(F.col("event_type") != "view").write.parquet(os.path.join(inp, "part1"))
    out, ckpt, state = _dir(spark, "str03-out"), _dir(spark, "str03-ckpt"), _dir(spark, "str03-state")
    sink = ST.batch_parquet_sink(out, state, lambda b: b.agg(F.max("event_id").alias("max_event_id")))

    def run():
        s = ST.read_stream(spark, inp, "parquet", "event_id BIGINT, event_type STRING", recursiveFileLookup="true")
        ST.run_stream(s, sink, ckpt)

    run()
    run()  # nothing new: the checkpoint makes this a no-op
    ev.filter(F.col("event_type") == "view").write.parquet(os.path.join(inp, "part2"))
    run()  # only the new file is processed
    return spark.read.parquet(out).select("event_id")


WEBHOOK_SQL = """WITH w AS (SELECT event_id, user_id, event_type,
  CASE event_type WHEN 'view' THEN 'salesforce' WHEN 'purchase' THEN 'zendesk' WHEN 'signup' THEN 'intercom' ELSE 'hubspot' END AS source
  FROM events)
"""


def _webhooks(spark, sf):
    ev = load(spark, sf, "events")
    et, u = F.col("event_type"), F.col("user_id")
    source = (F.when(et == "view", "salesforce").when(et == "purchase", "zendesk").when(et == "signup", "intercom")
              .otherwise("hubspot"))
    change = lambda name: F.struct(u.alias("objectId"), F.lit(name).alias("propertyName"),
                                   F.col("value").cast("string").alias("propertyValue"), F.lit(f"contact.{name}").alias("subscriptionType"))
    hs = F.when(et == "error", F.lit("[]")).otherwise(F.to_json(F.array(change("value"), change("k"))))
    sfb = F.to_json(F.struct(F.when(u % 7 != 0, F.lit("Lead")).alias("sobject_type"), F.col("event_id").cast("string").alias("id")))
    zd = F.to_json(F.struct(F.lit("ticket.created").alias("event_type"), F.col("event_id").cast("string").alias("id")))
    ic = F.to_json(F.struct(F.when(u % 5 != 0, F.lit("user.created")).alias("topic"), F.col("event_id").cast("string").alias("id")))
    body = (F.when(source == "hubspot", hs).when(source == "salesforce", sfb).when(source == "zendesk", zd).otherwise(ic))
    return ev.select("event_id", source.alias("source"), body.alias("body"))


@query("str04_webhook_events", WEBHOOK_SQL + """SELECT event_id, source, 'contact.' || p AS event_type, CAST(user_id AS VARCHAR) AS object_id
FROM w, (VALUES ('value'), ('k')) t(p) WHERE source = 'hubspot' AND event_type <> 'error'
UNION ALL SELECT event_id, source, 'Lead', CAST(event_id AS VARCHAR) FROM w WHERE source = 'salesforce' AND user_id % 7 <> 0
UNION ALL SELECT event_id, source, 'ticket.created', CAST(event_id AS VARCHAR) FROM w WHERE source = 'zendesk'
UNION ALL SELECT event_id, source, 'user.created', CAST(event_id AS VARCHAR) FROM w WHERE source = 'intercom' AND user_id % 5 <> 0""")
def _str04(spark, sf):
    events, _ = ST.parse_webhooks(_webhooks(spark, sf), keep=["event_id"])
    return events


@query("str04_webhook_rejects", WEBHOOK_SQL + """SELECT event_id, source, CASE source
  WHEN 'hubspot' THEN 'hubspot: expected a non-empty array of events' WHEN 'salesforce' THEN 'salesforce: missing sobject_type'
  ELSE 'intercom: missing topic' END AS error
FROM w WHERE (source = 'hubspot' AND event_type = 'error') OR (source = 'salesforce' AND user_id % 7 = 0)
  OR (source = 'intercom' AND user_id % 5 = 0)""")
def _str04b(spark, sf):
    _, rejects = ST.parse_webhooks(_webhooks(spark, sf), keep=["event_id"])
    return rejects.select("event_id", "source", "error")


ADMIT_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts FROM events),
starts AS (
  SELECT user_id, min(ts) AS s FROM e GROUP BY user_id HAVING min(ts) IS NOT NULL
  UNION ALL
  SELECT st.user_id, min(e.ts) AS s FROM starts st JOIN e ON e.user_id = st.user_id AND e.ts >= st.s + INTERVAL 1 DAY GROUP BY st.user_id),
w AS (SELECT e.event_id, e.user_id, e.ts, st.s FROM e ASOF JOIN starts st ON e.user_id = st.user_id AND e.ts >= st.s)
"""


def _timed_events(spark, sf):
    """events, every fiftieth without a time"""
    ev = load(spark, sf, "events")
    return ev.select("event_id", "user_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"))


@query("str05_admission", ADMIT_SQL + """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS admitted, s AS window_start FROM w""")
def _str05(spark, sf):
    out = ST.admit(_timed_events(spark, sf), "user_id", "ts", limit=3, window_seconds=86_400)
    return out.select("event_id", "user_id", "admitted", F.col("window_start").cast("timestamp_ntz").alias("window_start"))


@query("str05_admission_rejects", "SELECT event_id, 'event has no time' AS error FROM events WHERE event_id % 50 = 0")
def _str05b(spark, sf):
    return ST.admission_rejects(_timed_events(spark, sf), "ts").select("event_id", "error")


@query("str05_stream_any_order", ADMIT_SQL + """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS admitted, s AS window_start FROM w""")
def _str05c(spark, sf):
    """Events arrive in files dealt by their id, one per trigger, so any batch holds any time;
    one more event, ten years later, ends the feed."""
    d = _dir(spark, "str05-in")
    ev = _timed_events(spark, sf)
    ev.repartition(FILES, F.xxhash64("event_id")).write.parquet(d)
    last = ev.groupBy().agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts"))
    last.coalesce(1).write.mode("append").parquet(d)
    src = ST.event_time(ST.read_stream(spark, d, "parquet", "event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ", max_files_per_trigger=2), "ts")
    out = _drain(spark, ST.admit_ordered(src, "user_id", "ts", 3, 86_400, "event_id", "60 days"), "str05")
    return out.where("event_id IS NOT NULL").select("event_id", "user_id", "admitted", F.col("window_start").cast("timestamp_ntz").alias("window_start"))


@query("str06_window_metrics", """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n,
  round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def _str06(spark, sf):
    src = ST.event_time(ST.read_stream(spark, _event_files(spark, sf), "parquet", EVENTS_DDL, max_files_per_trigger=1), "ts")
    agg = ST.window_metrics(src, "ts", "5 minutes", ["event_type"],
                            [F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("value").alias("total")])
    out = _dir(spark, "str06-out")

    def sink(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    ST.run_stream(agg, sink, _dir(spark, "str06-ckpt"), output_mode="update")
    rows = spark.read.parquet(out).select(F.col("window.start").alias("window_start"), "event_type", "n", "total", "_batch")
    last = latest_per_key(rows, ["window_start", "event_type"], ["_batch"])
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
                       F.round("total", 6).alias("total"))


@query("str07_stream_upsert", """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _str07(spark, sf):
    inp = _dir(spark, "str07-in")
    # changes arrive in no order at all: any file may hold older ones
    load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate").repartition(6, F.xxhash64("o_orderkey")).write.parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "o_custkey BIGINT, o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ", max_files_per_trigger=1)
    target = _dir(spark, "str07-table")
    ST.run_stream(src, ST.upsert_sink(target, ["o_custkey"], ["o_orderdate", "o_orderkey"]), _dir(spark, "str07-ckpt"))
    return ST.latest_version(spark, target)


@query("str07_bucket_count", """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _str07c(spark, sf):
    """The job is started again with another number of buckets; the table keeps its own."""
    inp, ckpt, target = (_dir(spark, f"str07c-{x}") for x in ("in", "ckpt", "table"))
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    for part, buckets in ((0, 16), (1, 4)):
        o.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(inp)
        src = ST.read_stream(spark, inp, "parquet", "o_custkey BIGINT, o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ", max_files_per_trigger=1)
        ST.run_stream(src, ST.upsert_sink(target, ["o_custkey"], ["o_orderdate", "o_orderkey"], buckets=buckets), ckpt)
    return ST.latest_version(spark, target)


# --------------------------------------------------------------- quality

@query("dq01_source_report", """SELECT CAST(count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view')) AS BIGINT) AS streams,
  CAST(count(*) FILTER (WHERE event_type IN ('click', 'view')) AS BIGINT) AS records,
  CAST(count(*) FILTER (WHERE event_type = 'purchase' AND value <= 40) AS BIGINT) AS states,
  CAST(count(*) FILTER (WHERE (event_type = 'purchase' AND value > 40) OR (event_type = 'error' AND user_id % 2 <> 0)) AS BIGINT) AS errors
FROM events""")
def _dq01(spark, sf):
    from .q_sources import message_log

    good, _ = MSG.decode_messages(message_log(spark, sf), "value")
    return Q.source_report(good)


@query("dq02_assertions", """SELECT 'events_nonempty' AS check_name, CAST(count(*) AS BIGINT) AS rows_checked, CAST(0 AS BIGINT) AS rejects, count(*) > 0 AS passed FROM events
UNION ALL SELECT 'strict_coercion_no_rejects', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS BIGINT),
  count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) = 0 FROM events""")
def _dq02(spark, sf):
    """The assertions raise on failure; the result reports what they counted."""
    ev = load(spark, sf, "events")
    Q.assert_nonempty(ev, "events")
    coerced = ev.select(C.coerce(F.get_json_object("props", "$.k"), "string", "int", on_error="null").alias("k"))
    Q.assert_no_rejects(coerced.filter(F.col("k").isNull()), "coercion")
    counts = coerced.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if(F.col("k").isNull()).cast("bigint").alias("bad"))
    return counts.select(F.explode(F.array(
        F.struct(F.lit("events_nonempty").alias("check_name"), F.col("n").alias("rows_checked"), F.lit(0).cast("bigint").alias("rejects"), (F.col("n") > 0).alias("passed")),
        F.struct(F.lit("strict_coercion_no_rejects").alias("check_name"), F.col("n").alias("rows_checked"), F.col("bad").alias("rejects"), (F.col("bad") == 0).alias("passed")),
    )).alias("c")).select("c.*")


@query("dq03_idempotent_sync", "SELECT 'only_first' AS side, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'only_second', CAST(0 AS BIGINT)")
def _dq03(spark, sf):
    from .q_core import sync_events

    return Q.idempotency_diff(sync_events(spark, sf), sync_events(spark, sf))


@query("dq04_undeclared_fields", "SELECT DISTINCT event_type, 'extra' AS field FROM events WHERE event_type = 'view'")
def _dq04(spark, sf):
    from ..operators.schema import infer_fields

    ev = load(spark, sf, "events")
    props = F.when(F.col("event_type") == "view", F.regexp_replace("props", r"\}$", ', "extra": true}')).otherwise(F.col("props"))
    observed = infer_fields(ev.withColumn("props", props), "props", "event_type")
    declared = ev.select("event_type", F.lit("k").alias("field")).distinct()
    return Q.undeclared_fields(observed, declared, ["event_type", "field"]).select("event_type", "field")


@query("str07_stream_soft_delete", """SELECT c_custkey, c_name || CASE WHEN c_custkey % 7 <> 0 THEN ' v2' ELSE '' END AS c_name, c_custkey % 7 = 0 AS _deleted FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, c_name || ' v2', false FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0""")
def _str07b(spark, sf):
    """Two full snapshots, each over several micro-batches: the second drops
    some keys, adds others and changes the names; a third never completes."""
    inp = _dir(spark, "str07sd-in")
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    first, second = c.filter(k % 5 != 0), c.filter(k % 7 != 0).withColumn("c_name", F.concat("c_name", F.lit(" v2")))
    for number, rows, extra in ((1, first, 0), (2, second, 0), (3, c.filter(k % 2 == 0), 1)):
        size = rows.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + extra).alias("snapshot_rows"))
        rows.crossJoin(F.broadcast(size)).withColumn("snapshot_id", F.lit(number)).repartition(3).write.mode("append").parquet(inp)
    src = ST.read_stream(spark, inp, "parquet", "c_custkey BIGINT, c_name STRING, snapshot_rows BIGINT, snapshot_id INT", max_files_per_trigger=2)
    target = _dir(spark, "str07sd-table")
    ST.run_stream(src, ST.soft_delete_sink(target, ["c_custkey"], dt.datetime(2024, 2, 1)), _dir(spark, "str07sd-ckpt"))
    return ST.latest_version(spark, target).select("c_custkey", "c_name", "_deleted")


@query("str04_null_source", "SELECT CAST(count(*) FILTER (WHERE event_id % 9 <> 0) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE event_id % 9 = 0) AS BIGINT) AS rejects FROM events")
def _str04c(spark, sf):
    ev = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.lit("zendesk")).alias("source"),
                                          F.lit('{"event_type": "ticket.created", "id": "1"}').alias("body"))
    events, rejects = ST.parse_webhooks(ev, keep=["event_id"])
    both = events.select(F.lit(1).alias("e")).unionByName(rejects.select(F.lit(0).alias("e")))
    return both.agg(F.sum("e").cast("bigint").alias("events"), F.sum(1 - F.col("e")).cast("bigint").alias("rejects"))
