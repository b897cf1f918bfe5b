"""Registered queries: sync job, coercion, expression functions, mapping, filters, dedup.

Each query reads whole driver tables; derived text columns stand in for the
dynamic JSON fields of synced records (FIXTURES §3).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import exprfn as X
from ..functions.paths import get_path, set_path
from ..model import FieldMapping, StreamConfig, SyncConfig
from ..operators import dedup as D
from ..operators import mapping as M
from ..operators.seen import SeenKeys, UniqueCount
from ..session import materialize, scratch_path
from ..sources.tables import load
from .registry import query
from .sync import execute_sync, read_runs, read_table, run_sync

# ------------------------------------------------------------------ inputs

BOOL_WORDS = ["yes", "no", "on", "off", "TRUE", "f", "1", "0", "Y", "N"]


def events_text(spark, sf):
    """events with text fields of the kinds synced records carry."""
    ev = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    s_num = F.concat(F.lit(" "), F.when(F.col("event_type") == "error", "-").otherwise(""), k, F.lit("."),
                     (F.col("user_id") % 10).cast("string"), F.lit(" "))
    s_bool = F.element_at(F.array(*[F.lit(w) for w in BOOL_WORDS]), (F.col("event_id") % 10 + 1).cast("int"))
    m4 = F.col("event_id") % 4
    s_time = (F.when(m4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
              .when(m4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
              .when(m4 == 2, F.date_format("ts", "yyyy-MM-dd"))
              .otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")))
    return ev.select("event_id", "ts", "user_id", "event_type", "value", "props",
                     s_num.alias("s_num"), s_bool.alias("s_bool"), s_time.alias("s_time"))


EV_SQL = """WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
    ' ' || CASE WHEN event_type = 'error' THEN '-' ELSE '' END || json_extract_string(props, '$.k') || '.'
        || CAST(user_id % 10 AS VARCHAR) || ' ' AS s_num,
    ['yes','no','on','off','TRUE','f','1','0','Y','N'][CAST(event_id % 10 AS INTEGER) + 1] AS s_bool,
    CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS VARCHAR) END AS s_time
  FROM events)
"""

STRICT_INT_SQL = ("CASE WHEN regexp_full_match(trim({s}), '[+-]?[0-9]+') THEN CAST(trim({s}) AS BIGINT) "
                  "ELSE CAST(trunc(CAST(trim({s}) AS DOUBLE)) AS BIGINT) END")
STRICT_BOOL_SQL = ("CASE WHEN trim({s}) IN ('1','t','T','TRUE','true','True') THEN true "
                   "WHEN trim({s}) IN ('0','f','F','FALSE','false','False') THEN false "
                   "WHEN lower(trim({s})) IN ('yes','y','1','on') THEN true "
                   "WHEN lower(trim({s})) IN ('no','n','0','off') THEN false END")
PLAIN_NUM_SQL = r"regexp_replace(CAST({x} AS VARCHAR), '\.0$', '')"


def events_with_copies(spark, sf):
    """events plus a later copy of the purchase events (FIXTURES §3 duplicates)."""
    ev = load(spark, sf, "events")
    copy = ev.filter(F.col("event_type") == "purchase").withColumn("value", F.col("value") + 1.0)
    return ev.withColumn("_seq", F.lit(0)).unionByName(copy.withColumn("_seq", F.lit(1)))


# -------------------------------------------------------------- sync (SNK-15)

SYNC_START = dt.datetime(2024, 1, 10)


def sync_config() -> SyncConfig:
    maps = [
        FieldMapping("event_id", "event_id"),
        FieldMapping("user_id", "user_ref", "rename"),
        FieldMapping("payload.k", "k", "cast", cast_type="int"),
        FieldMapping("event_type", "stream", "expression", expression="upper"),
        FieldMapping("value", "amount", "default", default_value=0.0),
        FieldMapping("ts", "ts"),
        FieldMapping("_seq", "_seq"),
    ]
    stream = StreamConfig("events", primary_key=["event_id"], cursor_field="ts", sync_mode="incremental", mappings=maps)
    return SyncConfig("sync-events", stream, cursor_value=SYNC_START, dedup_order_by=["ts", "_seq"])


def sync_events(spark, sf):
    src = events_with_copies(spark, sf).withColumn("payload", F.from_json("props", "k STRING"))
    return run_sync(src, sync_config()).records.drop("_seq")


SYNC_SQL = """SELECT event_id, user_id AS user_ref, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  upper(event_type) AS stream, value AS amount, ts
FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'"""

query("snk15_sync_events", SYNC_SQL)(sync_events)


@query("snk15_sync_dedup_first", """SELECT DISTINCT event_type AS stream, user_id AS user_ref FROM events""")
def _sync_dedup_first(spark, sf):
    """Worker order: whole-payload dedup first, then strict mapping."""
    from ..model import StreamConfig as SC

    ev = load(spark, sf, "events").select("event_type", "user_id")
    cfg = SyncConfig("s2", SC("events", mappings=[FieldMapping("event_type", "stream"), FieldMapping("user_id", "user_ref")]),
                     order="dedup_first")
    return run_sync(ev, cfg).records


def _two_runs(spark, sf, mode, key, maps, mid=dt.datetime(2024, 1, 15)):
    """A first sync of the events before ``mid`` and a second one of them all,
    which goes on from the first one's checkpoint; the home folder."""
    home = scratch_path(spark, f"sync-{mode}-{uuid.uuid4().hex[:12]}")
    stream = StreamConfig("events", primary_key=key, cursor_field="ts", sync_mode="incremental", destination_mode=mode, mappings=maps)
    cfg = SyncConfig(f"events-{mode}", stream, dedup_order_by=["ts", "event_id"])
    ev = load(spark, sf, "events")
    execute_sync(ev.where(F.col("ts") < mid), cfg, home)
    execute_sync(ev, cfg, home)
    return home


_PLAIN = [FieldMapping("event_id", "event_id"), FieldMapping("user_id", "user_ref"), FieldMapping("ts", "ts"), FieldMapping("value", "amount")]
HALVES_SQL = """WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-15' AS late FROM events),
picked AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY late, user_id ORDER BY ts, event_id) = 1)
"""


@query("snk15_append", "SELECT event_id, user_id AS user_ref, ts, value AS amount FROM events")
def _snk15_append(spark, sf):
    return read_table(spark, _two_runs(spark, sf, "append", ["event_id"], _PLAIN))


def _stopped_sync(spark, sf, mode, key):
    """The sync of :func:`_two_runs`, where every run is first stopped once after each of its steps, up to the last one before its commit."""
    class Stop(Exception):
        pass

    home = scratch_path(spark, f"sync-stops-{uuid.uuid4().hex[:12]}")
    cfg = SyncConfig(f"events-{mode}", StreamConfig("events", key, "ts", "incremental", mode, _PLAIN), dedup_order_by=["ts", "event_id"])
    ev = load(spark, sf, "events")
    for part, steps in ((ev.where(F.col("ts") < dt.datetime(2024, 1, 15)), ("written", "state")), (ev, ("counted", "state"))):
        for last in steps:
            def stop(step, folder, last=last):
                if step == last:
                    raise Stop

            try:
                execute_sync(part, cfg, home, on_step=stop)
            except Stop:
                pass
        execute_sync(part, cfg, home)
    return home


@query("snk15_append_after_stops", "SELECT event_id, user_id AS user_ref, ts, value AS amount FROM events")
def _snk15_append_after_stops(spark, sf):
    return read_table(spark, _stopped_sync(spark, sf, "append", ["event_id"]))


@query("snk15_upsert_after_stops", HALVES_SQL + "SELECT event_id, user_id AS user_ref, ts, value AS amount FROM picked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY late DESC) = 1")
def _snk15_upsert_after_stops(spark, sf):
    return read_table(spark, _stopped_sync(spark, sf, "upsert", ["user_ref"]))


@query("snk15_append_runs", """SELECT 'events-append' AS sync_id, CAST(row_number() OVER (ORDER BY late) AS INTEGER) AS run, 'completed' AS status, CAST(n AS BIGINT) AS records_extracted,
  CAST(n AS BIGINT) AS records_transformed, CAST(n AS BIGINT) AS records_loaded, CAST(0 AS BIGINT) AS errors, CAST(NULL AS VARCHAR) AS discrepancy
FROM (SELECT ts >= TIMESTAMP '2024-01-15' AS late, count(*) AS n FROM events GROUP BY 1)""")
def _snk15_append_runs(spark, sf):
    return read_runs(spark, _two_runs(spark, sf, "append", ["event_id"], _PLAIN)).drop("checkpoint")


@query("snk15_upsert", HALVES_SQL + "SELECT event_id, user_id AS user_ref, ts, value AS amount FROM picked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY late DESC) = 1")
def _snk15_upsert(spark, sf):
    return read_table(spark, _two_runs(spark, sf, "upsert", ["user_ref"], _PLAIN))


@query("snk15_upsert_runs", HALVES_SQL + """SELECT CAST(row_number() OVER (ORDER BY late) AS INTEGER) AS run, 'completed' AS status, CAST(n AS BIGINT) AS records_extracted,
  CAST(u AS BIGINT) AS records_transformed, CAST(u AS BIGINT) AS records_loaded, CAST(c AS VARCHAR) AS checkpoint
FROM (SELECT late, count(*) AS n, count(DISTINCT user_id) AS u, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS c FROM e GROUP BY late)""")
def _snk15_upsert_runs(spark, sf):
    runs = read_runs(spark, _two_runs(spark, sf, "upsert", ["user_ref"], _PLAIN))
    return runs.select("run", "status", "records_extracted", "records_transformed", "records_loaded", F.substring("checkpoint", 1, 19).alias("checkpoint"))


@query("snk15_merge", HALVES_SQL + """SELECT user_id AS user_ref, arg_max(event_id, late) AS event_id, arg_max(CASE WHEN event_type <> 'view' THEN value END, late) FILTER (WHERE event_type <> 'view') AS amount
FROM picked GROUP BY user_id""")
def _snk15_merge(spark, sf):
    """An amount that is null in the second run leaves the first one's in place."""
    home = scratch_path(spark, f"sync-merge-{uuid.uuid4().hex[:12]}")
    maps = [FieldMapping("user_id", "user_ref"), FieldMapping("event_id", "event_id"), FieldMapping("amount", "amount"), FieldMapping("ts", "ts")]
    cfg = SyncConfig("events-merge", StreamConfig("events", ["user_ref"], "ts", "incremental", "merge", maps), dedup_order_by=["ts", "event_id"])
    ev = load(spark, sf, "events").withColumn("amount", F.when(F.col("event_type") != "view", F.col("value")))
    execute_sync(ev.where(F.col("ts") < dt.datetime(2024, 1, 15)), cfg, home)
    execute_sync(ev, cfg, home)
    return read_table(spark, home).select("user_ref", "event_id", "amount")


@query("snk15_soft_delete", "SELECT c_custkey AS id, c_name AS name, c_custkey % 7 = 0 AS _deleted FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 <> 0")
def _snk15_soft_delete(spark, sf):
    home = scratch_path(spark, f"sync-soft-{uuid.uuid4().hex[:12]}")
    maps = [FieldMapping("c_custkey", "id"), FieldMapping("c_name", "name")]
    cfg = SyncConfig("customers", StreamConfig("customers", ["id"], destination_mode="soft_delete", mappings=maps))
    c = load(spark, sf, "customer")
    execute_sync(c.where(F.col("c_custkey") % 5 != 0), cfg, home)
    execute_sync(c.where(F.col("c_custkey") % 7 != 0), cfg, home, deleted_at=dt.datetime(2024, 2, 1))
    return read_table(spark, home).select("id", "name", "_deleted")


# --------------------------------------------------------------------- COE

def _coe(name, spark_fn, sql_expr):
    @query(name, EV_SQL + f"SELECT event_id, {sql_expr} AS v FROM ev")
    def _q(spark, sf):
        return events_text(spark, sf).select("event_id", spark_fn().alias("v"))
    return _q


_coe("coe01_string_to_int", lambda: C.coerce("s_num", "string", "int"), STRICT_INT_SQL.format(s="s_num"))
_coe("coe02_int_to_string", lambda: C.coerce("user_id", "int", "string"), "CAST(user_id AS VARCHAR)")
_coe("coe03_string_to_float", lambda: C.coerce("s_num", "string", "float"), "CAST(trim(s_num) AS DOUBLE)")
_coe("coe04_float_to_string", lambda: C.coerce("value", "float", "string"), PLAIN_NUM_SQL.format(x="value"))
_coe("coe05_string_to_bool", lambda: C.coerce("s_bool", "string", "bool"), STRICT_BOOL_SQL.format(s="s_bool"))
_coe("coe06_bool_to_string", lambda: C.coerce(F.col("value") > 20, "bool", "string"), "CAST(value > 20 AS VARCHAR)")
_coe("coe07_string_to_time", lambda: C.coerce("s_time", "string", "time"),
     "CASE event_id % 4 WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END")
_coe("coe08_time_to_string", lambda: C.coerce("ts", "time", "string"), "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")
_coe("coe09_int_to_float", lambda: C.coerce("user_id", "int", "float"), "CAST(user_id AS DOUBLE)")
_coe("coe10_float_to_int",
     lambda: C.coerce(F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")), "float", "int"),
     "CAST(trunc(CASE WHEN event_type = 'error' THEN -value ELSE value END) AS BIGINT)")
_coe("coe11_int_to_bool", lambda: C.coerce(F.col("user_id") % 3, "int", "bool"), "(user_id % 3) <> 0")
_coe("coe12_bool_to_int", lambda: C.coerce(F.col("event_type") == "click", "bool", "int"),
     "CAST(event_type = 'click' AS BIGINT)")
_coe("coe13_float_to_bool", lambda: C.coerce(F.floor(F.col("value") / 10).cast("double"), "float", "bool"),
     "floor(value / 10) <> 0")
_coe("coe14_bool_to_float", lambda: C.coerce(F.col("event_type") == "view", "bool", "float"),
     "CAST(event_type = 'view' AS DOUBLE)")
_coe("coe15_type_synonyms", lambda: C.coerce("s_num", " VARCHAR ", "BigInt"), STRICT_INT_SQL.format(s="s_num"))


@query("coe16_custom_converter", EV_SQL + "SELECT event_id, CAST(length(s_num) AS BIGINT) AS v FROM ev")
def _coe16(spark, sf):
    C.register_converter("text", "integer", lambda c: F.length(c).cast("bigint"))
    try:
        col = C.coerce("s_num", "string", "int")
    finally:
        C.clear_converters()
    return events_text(spark, sf).select("event_id", col.alias("v"))


LENIENT_T = "CASE WHEN event_id % 2 = 0 THEN trim(s_num) ELSE s_num END"


def _lenient_df(spark, sf):
    ev = events_text(spark, sf)
    return ev.select("event_id", "value", "s_bool", "s_time",
                     F.when(F.col("event_id") % 2 == 0, F.trim("s_num")).otherwise(F.col("s_num")).alias("t"))


def _lenient(name, field, target, sql_value, sql_failed):
    @query(name, EV_SQL + f", lv AS (SELECT event_id, ts, value, s_bool, s_time, {LENIENT_T} AS t FROM ev) "
                 f"SELECT event_id, {sql_value} AS v, {sql_failed} AS failed FROM lv")
    def _q(spark, sf):
        out = C.coerce_lenient(_lenient_df(spark, sf), {field: target})
        return out.select("event_id", F.col(field).alias("v"), (F.size("_coerce_errors") > 0).alias("failed"))
    return _q


_lenient("coe17_lenient_to_string", "value", "string", PLAIN_NUM_SQL.format(x="value"), "false")
_lenient("coe18_lenient_to_int", "t", "int64",
         "CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(t AS BIGINT) "
         "WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trunc(CAST(t AS DOUBLE)) AS BIGINT) END",
         "NOT regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')")
_lenient("coe19_lenient_to_float", "t", "float64",
         "CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE) END",
         "NOT regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')")
_lenient("coe20_lenient_to_bool", "s_bool", "bool",
         "CASE WHEN s_bool IN ('1','t','T','TRUE','true','True') THEN true WHEN s_bool IN ('0','f','F','FALSE','false','False') THEN false END",
         "s_bool NOT IN ('1','t','T','TRUE','true','True','0','f','F','FALSE','false','False')")
_lenient("coe21_lenient_to_timestamp", "s_time", "timestamp",
         "CASE event_id % 4 WHEN 3 THEN s_time WHEN 2 THEN s_time || 'T00:00:00Z' "
         "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END",
         "false")


@query("coe22_lenient_error_counts", EV_SQL + f""", lv AS (SELECT event_type, {LENIENT_T} AS t, s_bool FROM ev)
SELECT event_type,
  CAST(sum(CASE WHEN NOT regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 1 ELSE 0 END
         + CASE WHEN s_bool NOT IN ('1','t','T','TRUE','true','True','0','f','F','FALSE','false','False') THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(count(*) AS BIGINT) AS records
FROM lv GROUP BY event_type""")
def _coe22(spark, sf):
    df = _lenient_df(spark, sf).join(load(spark, sf, "events").select("event_id", "event_type"), "event_id")
    out = C.coerce_lenient(df, {"t": "int", "s_bool": "boolean"})
    return out.groupBy("event_type").agg(F.sum(F.size("_coerce_errors")).cast("bigint").alias("errors"),
                                         F.count(F.lit(1)).cast("bigint").alias("records"))


@query("coe23_strict_columns", EV_SQL + f"SELECT event_id, {STRICT_INT_SQL.format(s='s_num')} AS s_num, "
                                        f"{STRICT_BOOL_SQL.format(s='s_bool')} AS s_bool FROM ev")
def _coe23(spark, sf):
    return C.coerce_strict(events_text(spark, sf).select("event_id", "s_num", "s_bool"), {"s_num": "int", "s_bool": "bool"})


# ---------------------------------------------------------------------- FN

def _cust(spark, sf):
    return load(spark, sf, "customer")


def _fn(name, sql_select, build):
    @query(name, f"SELECT c_custkey, {sql_select} FROM customer")
    def _q(spark, sf):
        return _cust(spark, sf).select("c_custkey", *build())
    return _q


_fn("fn01_field_ref", "c_name AS name, c_mktsegment AS tag1, CAST(NULL AS VARCHAR) AS tag5",
    lambda: [
        get_path("account.name", F.struct(F.struct(F.col("c_name").alias("name")).alias("account"))).alias("name"),
        get_path("tags[1]", F.struct(F.array(F.col("c_name"), F.col("c_mktsegment")).alias("tags"))).alias("tag1"),
        get_path("tags[5]", F.struct(F.array(F.col("c_name"), F.col("c_mktsegment")).alias("tags"))).alias("tag5"),
    ])
_fn("fn02_add", "c_acctbal + c_nationkey AS num, c_name || CAST(c_nationkey AS VARCHAR) AS txt",
    lambda: [X.add("c_acctbal", "c_nationkey").alias("num"),
             X.add("c_name", "c_nationkey", as_text=True).alias("txt")])
_fn("fn03_sub_mul_neg", "c_acctbal - c_nationkey AS d, c_acctbal * 2 AS p, -c_acctbal AS n",
    lambda: [X.sub("c_acctbal", "c_nationkey").alias("d"), X.mul("c_acctbal", F.lit(2)).alias("p"),
             X.neg("c_acctbal").alias("n")])
_fn("fn04_div", "CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS q",
    lambda: [X.div("c_acctbal", "c_nationkey", safe=True).alias("q")])
_fn("fn05_concat", "c_name || '-' || c_mktsegment AS s",
    lambda: [X.concat("c_name", F.lit("-"), "c_mktsegment", F.lit(None)).alias("s")])
_fn("fn06_upper", "upper(c_name) AS s", lambda: [X.upper("c_name").alias("s")])
_fn("fn07_lower", "lower(c_mktsegment) AS s", lambda: [X.lower("c_mktsegment").alias("s")])
_fn("fn08_trim", "c_mktsegment AS s",
    lambda: [X.trim(F.concat(F.lit("\t \n"), F.col("c_mktsegment"), F.lit(" \r\n"))).alias("s")])
_fn("fn09_split", "split_part(c_name, '#', 2) AS part2, CAST(len(string_split(c_name, '#')) AS INTEGER) AS n_parts",
    lambda: [F.element_at(X.split("c_name", "#"), 2).alias("part2"), F.size(X.split("c_name", "#")).alias("n_parts")])
_fn("fn10_join", "c_mktsegment || '||' || c_name AS s",
    lambda: [X.join(F.array(F.col("c_mktsegment"), F.lit(None).cast("string"), F.col("c_name")), "|").alias("s")])
_fn("fn11_coalesce", "CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS s",
    lambda: [X.coalesce(F.lit(None).cast("string"),
                        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_mktsegment")), "c_name").alias("s")])
_fn("fn12_if_null", "CASE WHEN c_acctbal < 0 THEN 'NEG' ELSE '' END AS s",
    lambda: [X.if_null(F.when(F.col("c_acctbal") >= 0, F.lit("")), F.lit("NEG")).alias("s")])
_fn("fn13_to_string", PLAIN_NUM_SQL.format(x="c_acctbal") + " AS s, '' AS e",
    lambda: [X.to_string("c_acctbal").alias("s"), X.to_string(F.lit(None).cast("double")).alias("e")])
_fn("fn14_to_int", "CAST(trunc(c_acctbal) AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b",
    lambda: [X.to_int("c_acctbal").alias("a"), X.to_int(F.col("c_nationkey").cast("string")).alias("b")])
_fn("fn15_to_float", "CAST(c_custkey AS DOUBLE) AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS b",
    lambda: [X.to_float(F.col("c_custkey").cast("string")).alias("a"),
             X.to_float(F.col("c_mktsegment") == "BUILDING").alias("b")])


@query("fn13_extreme_numbers", """SELECT l_orderkey, l_linenumber, l_linenumber || repeat('0', 45) AS big, '-0.' || repeat('0', 29) || l_linenumber AS small,
  l_linenumber || '.5' AS plain FROM lineitem""")
def _fn13b(spark, sf):
    n = F.col("l_linenumber").cast("string")
    number = lambda suffix, sign="": F.concat(F.lit(sign), n, F.lit(suffix)).cast("double")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.to_string(number("e45")).alias("big"), X.to_string(number("e-30", "-")).alias("small"),
                                              X.to_string(number(".5")).alias("plain"))


@query("fn14_big_integers", "SELECT l_orderkey, l_linenumber, 9007199254740992 + l_orderkey * 8 + l_linenumber AS v FROM lineitem")
def _fn14b(spark, sf):
    v = F.lit(9007199254740992) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.to_int(v).alias("v"))


@query("fn15_out_of_range", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 4 THEN CAST(l_linenumber || 'e300' AS DOUBLE) END AS v,
  CASE WHEN l_linenumber < 4 THEN CAST('-' || l_linenumber || 'e300' AS DOUBLE) END AS w FROM lineitem""")
def _fn15b(spark, sf):
    """Text beyond the range of doubles is an error, not infinity."""
    n = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") < 4, "e300").otherwise("e400"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.to_float(n, on_error="null").alias("v"),
                                              C.coerce(F.concat(F.lit("-"), n), "string", "float", on_error="null").alias("w"))


_fn("fn16_to_bool", "c_nationkey % 2 = 1 AS a, c_acctbal <> 0 AS b",
    lambda: [X.to_bool((F.col("c_nationkey") % 2).cast("string")).alias("a"), X.to_bool("c_acctbal").alias("b")])
_fn("fn20_substring", "substr(c_name, 3, 5) AS a, c_name AS b, '' AS c",
    lambda: [X.substring("c_name", 2, 5).alias("a"), X.substring("c_name", -3).alias("b"),
             X.substring("c_name", 100).alias("c")])
_fn("fn21_replace", "replace(c_name, '#', ' no. ') AS s", lambda: [X.replace("c_name", "#", " no. ").alias("s")])
_fn("fn22_regex_match", "regexp_matches(c_name, '[13579]$') AS m", lambda: [X.regex_match("c_name", "[13579]$").alias("m")])


ORD_DATE_TEXT_SQL = ("CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
                     "WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d-%b-%Y') END")


def _orders_date_text(spark, sf):
    o = load(spark, sf, "orders")
    m3 = F.col("o_orderkey") % 3
    txt = (F.when(m3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(m3 == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
           .otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")))
    return o.select("o_orderkey", "o_orderdate", txt.alias("d_text"))


@query("fn18_format_date", f"SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d %H:%M') AS s FROM orders")
def _fn18(spark, sf):
    return _orders_date_text(spark, sf).select("o_orderkey", X.format_date("d_text", "YYYY.MM.DD HH:mm").alias("s"))


@query("fn19_parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS s FROM orders")
def _fn19(spark, sf):
    return _orders_date_text(spark, sf).select("o_orderkey", X.parse_date("d_text").alias("s"))


@query("fn24_format_duration", """SELECT event_id,
  CASE WHEN floor(ms / 1000) >= 3600 THEN printf('%dh %02dm %02ds', CAST(floor(floor(ms / 1000) / 3600) AS BIGINT),
         CAST(floor((CAST(floor(ms / 1000) AS BIGINT) % 3600) / 60) AS BIGINT), CAST(floor(ms / 1000) AS BIGINT) % 60)
       WHEN floor(ms / 1000) >= 60 THEN printf('%dm %02ds', CAST(floor(floor(ms / 1000) / 60) AS BIGINT), CAST(floor(ms / 1000) AS BIGINT) % 60)
       ELSE printf('%ds', CAST(floor(ms / 1000) AS BIGINT)) END AS s
FROM (SELECT event_id, CAST(floor(value * 100000) AS BIGINT) AS ms FROM events)""")
def _fn24(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id", X.format_duration(F.floor(F.col("value") * 100000)).alias("s"))


@query("fn25_elapsed_ms", "SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS ms FROM events")
def _fn25(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id", X.elapsed_ms(F.date_trunc("day", F.col("ts").cast("timestamp")), F.col("ts")).alias("ms"))


@query("fn26_format_count", """SELECT o_custkey, format('{:,}', CAST(count(*) * 1000 AS BIGINT)) AS s
FROM orders GROUP BY o_custkey""")
def _fn26(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(X.format_count(F.count(F.lit(1)) * 1000).alias("s"))


# --------------------------------------------------------------------- MAP

@query("map01_strict_customer", r"""SELECT c_custkey AS id, c_name AS contact_name, lower(c_mktsegment) AS segment,
  regexp_replace(CAST(c_acctbal AS VARCHAR), '\.0$', '') AS balance_text
FROM customer""")
def _map01(spark, sf):
    maps = [
        FieldMapping("c_custkey", "id"),
        FieldMapping("c_name", "contact.name", "rename"),
        FieldMapping("c_mktsegment", "segment", "expression", expression="lower"),
        FieldMapping("c_acctbal", "balance_text", "cast", cast_type="string"),
        FieldMapping("missing.path", "ghost"),
    ]
    out = M.map_strict(_cust(spark, sf), maps)
    return out.select("id", F.col("contact.name").alias("contact_name"), "segment", "balance_text")


@query("map02_lenient_orders", """SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS o_orderstatus,
  o_orderdate, o_orderpriority FROM orders""")
def _map02(spark, sf):
    maps = [FieldMapping("o_orderkey", "id"), FieldMapping("o_custkey", "customer"),
            FieldMapping("o_totalprice", "o_orderstatus"), FieldMapping("not_there", "x")]
    return M.map_lenient(load(spark, sf, "orders"), maps)


@query("map03_by_stream", """SELECT event_id, ts, user_id, event_type, props,
  CASE WHEN event_type = 'click' THEN value END AS click_value,
  CASE WHEN event_type = 'purchase' THEN value END AS revenue,
  CASE WHEN event_type NOT IN ('click', 'purchase') THEN value END AS value
FROM events""")
def _map03(spark, sf):
    per = {"click": [FieldMapping("value", "click_value")], "purchase": [FieldMapping("value", "revenue")]}
    return M.map_by_stream(load(spark, sf, "events"), "event_type", per)


@query("map06_expression", """SELECT c_custkey, CAST(strlen(c_name) AS BIGINT) AS name_len, -c_acctbal AS neg,
  c_nationkey AS nk, c_name AS as_text FROM customer""")
def _map06(spark, sf):
    maps = [FieldMapping("c_custkey", "c_custkey"),
            FieldMapping("c_name", "name_len", "expression", expression="length"),
            FieldMapping("c_acctbal", "neg", "expression", expression="negate"),
            FieldMapping("c_nationkey", "nk", "expression", expression="upper"),
            FieldMapping("c_name", "as_text", "expression", expression="tostring")]
    return M.map_strict(_cust(spark, sf), maps)


@query("map07_default", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS bal FROM customer")
def _map07(spark, sf):
    df = _cust(spark, sf).select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b"))
    return M.map_strict(df, [FieldMapping("c_custkey", "c_custkey"), FieldMapping("b", "bal", "default", default_value=0.0)])


@query("map08_identity_last_wins", "SELECT c_custkey, c_mktsegment AS label FROM customer")
def _map08(spark, sf):
    maps = [FieldMapping("c_custkey", "c_custkey"), FieldMapping("c_name", "label"), FieldMapping("c_mktsegment", "label")]
    return M.map_strict(_cust(spark, sf), maps)


@query("map09_get_path_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _map09(spark, sf):
    from ..functions.paths import json_path

    return load(spark, sf, "events").select("event_id", json_path(F.col("props"), "k").alias("k"))


@query("map10_set_path", "SELECT c_custkey, c_acctbal AS amount, c_mktsegment AS seg FROM customer")
def _map10(spark, sf):
    df = _cust(spark, sf).withColumn("info", F.struct(F.col("c_mktsegment").alias("seg")))
    df = set_path(df, "info.balance.amount", F.col("c_acctbal"))
    return df.select("c_custkey", F.col("info.balance.amount").alias("amount"), F.col("info.seg").alias("seg"))


# --------------------------------------------------------------------- FIL

@query("fil01_audit_filter", """SELECT event_id, user_id, event_type, ts FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def _fil01(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return M.audit_filter(ev, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20), event_type="click", user_id=None)


@query("fil02_text_search", """SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') AND c_mktsegment = 'BUILDING'""")
def _fil02(spark, sf):
    c = _cust(spark, sf).select("c_custkey", "c_name", "c_mktsegment")
    return M.text_search(c, ["c_name", "c_mktsegment"], "BUILD", c_mktsegment="BUILDING")


@query("fil03_categories", "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL AND event_type <> ''")
def _fil03(spark, sf):
    return M.categories(load(spark, sf, "events"), "event_type")


# --------------------------------------------------------------------- DED

@query("ded01_first_wins", "SELECT event_id, value, ts FROM events")
def _ded01(spark, sf):
    return D.dedup_by_key(events_with_copies(spark, sf), ["event_id"], ["ts", "_seq"]).select("event_id", "value", "ts")


@query("ded02_composite_key", """SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def _ded02(spark, sf):
    ev = load(spark, sf, "events")
    return D.dedup_by_key(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("ded03_dedup_stats", """SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT event_id) AS BIGINT) AS unique_keys,
  CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS duplicates
FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase')""")
def _ded03(spark, sf):
    return D.dedup_stats(events_with_copies(spark, sf), ["event_id"])


@query("ded04_payload", "SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def _ded04(spark, sf):
    return D.dedup_payload(load(spark, sf, "documents").select(F.md5("text").alias("text_md5")))


@query("ded05_bloom_semi", """SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _ded05(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    small = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return D.bloom_semi_filter(li, small, "l_orderkey")


@query("ded06_unique_keys", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS unique_keys FROM events")
def _ded06(spark, sf):
    return D.unique_key_count(load(spark, sf, "events"), ["user_id"])


@query("ded05_seen_over_batches", """SELECT user_id, CAST(min(event_id % 3) AS INTEGER) AS batch, count(DISTINCT event_id % 3) > 1 AS came_again FROM events GROUP BY user_id""")
def _ded05b(spark, sf):
    """Events in three batches; the filter kept between them is sized for 500 users at one in ten, so
    it often takes new users for seen, which the check against the kept users mends."""
    state = SeenKeys(spark, scratch_path(spark, f"seen-{uuid.uuid4().hex[:12]}"), ["user_id"], n=500, fpp=0.1)
    ev = load(spark, sf, "events").select("user_id", "event_id")
    firsts = None
    for i in range(3):
        new = materialize(state.new_rows(ev.where(F.col("event_id") % 3 == i), ["event_id"]).select("user_id", F.lit(i).alias("batch")), "seen-new")
        state.add(new, str(i))
        firsts = new if firsts is None else firsts.unionByName(new)
    times = ev.select("user_id", (F.col("event_id") % 3).alias("b")).distinct().groupBy("user_id").agg((F.count(F.lit(1)) > 1).alias("came_again"))
    return firsts.join(times, "user_id")


@query("ded06_count_over_batches", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS unique_keys, CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS batches FROM events")
def _ded06b(spark, sf):
    """Five batches, one of them sent twice. Sketches with 2 ** 21 places count a few thousand users exactly."""
    state = UniqueCount(spark, scratch_path(spark, f"unique-{uuid.uuid4().hex[:12]}"), ["user_id"], lg_k=21)
    ev = load(spark, sf, "events").select("user_id", "event_id")
    for i in (0, 1, 2, 3, 4, 2):
        state.add(ev.where(F.col("event_id") % 5 == i), str(i))
    return state.count()


# ----------------------------------------------------------- more MAP / FN

@query("map04_rename", "SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders")
def _map04(spark, sf):
    maps = [FieldMapping("o_orderkey", "order_id", "rename"), FieldMapping("o_custkey", "customer_id", "rename")]
    return M.map_strict(load(spark, sf, "orders"), maps)


@query("map05_cast", """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price_int,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_text, CAST(o_custkey AS DOUBLE) AS customer_float FROM orders""")
def _map05(spark, sf):
    maps = [FieldMapping("o_orderkey", "o_orderkey"),
            FieldMapping("o_totalprice", "price_int", "cast", cast_type="integer"),
            FieldMapping("o_orderdate", "date_text", "cast", cast_type="varchar"),
            FieldMapping("o_custkey", "customer_float", "cast", cast_type="number")]
    return M.map_strict(load(spark, sf, "orders"), maps)


@query("map11_crm_template", """SELECT split_part(c_name, '#', 1) AS firstname, split_part(c_name, '#', 2) AS lastname,
  lower(replace(c_name, '#', '.')) || '@example.com' AS email, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS mobilephone,
  c_mktsegment AS jobtitle, 'Nation ' || CAST(c_nationkey AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS address,
  CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS zip, CAST(NULL AS VARCHAR) AS country
FROM customer""")
def _map11b(spark, sf):
    """Salesforce-shaped contacts derived from customer, mapped by the contact template
    (fields the records lack come out null)."""
    c = _cust(spark, sf)
    contacts = c.select(F.split("c_name", "#").getItem(0).alias("FirstName"), F.split("c_name", "#").getItem(1).alias("LastName"),
                        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("Email"),
                        F.col("c_mktsegment").alias("Title"),
                        F.struct(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("Name")).alias("Account"))
    return M.map_strict(contacts, M.template_mappings("salesforce_to_hubspot_contacts"))


@query("fn17_now", "SELECT event_id, true AS is_rfc3339 FROM events")
def _fn17(spark, sf):
    return load(spark, sf, "events").select("event_id", X.now().rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$").alias("is_rfc3339"))


@query("fn23_user_function", "SELECT c_custkey, c_acctbal * 2 AS doubled, upper(c_name) AS shout FROM customer")
def _fn23(spark, sf):
    X.register_function("double_it", lambda c: X.mul(c, F.lit(2)))
    return _cust(spark, sf).select("c_custkey", X.call("double_it", "c_acctbal").alias("doubled"), X.call("upper", "c_name").alias("shout"))
