"""Registered queries: run analytics, metrics, alerts and quotas (AGG-1..16).

Runs are derived from the driver tables (FIXTURES §3): an order is a run of
the sync named by its customer, for the tenant named by the customer's
nation, through the connector named by the order priority; its line items
are the records (extracted = all, transformed = not returned, loaded =
shipped lines, errors = returned lines).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources.tables import load
from .registry import query


def runs(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("bigint").alias("records_extracted"),
        F.count_if(F.col("l_returnflag") != "R").cast("bigint").alias("records_transformed"),
        F.count_if(F.col("l_linestatus") == "F").cast("bigint").alias("records_loaded"),
        F.count_if(F.col("l_returnflag") == "R").cast("bigint").alias("errors"),
        F.max("l_shipdate").alias("completed_at"))
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("cancelled")
    return (o.join(li, o.o_orderkey == li.l_orderkey).join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("sync_id"), F.col("c_nationkey").alias("tenant"),
                    F.col("o_orderpriority").alias("connector"), status.alias("status"), F.col("o_orderdate").alias("started_at"),
                    "completed_at", "records_extracted", "records_transformed", "records_loaded", "errors"))


RUNS_SQL = """WITH li AS (SELECT l_orderkey, count(*) AS records_extracted, count(*) FILTER (WHERE l_returnflag <> 'R') AS records_transformed,
    count(*) FILTER (WHERE l_linestatus = 'F') AS records_loaded, count(*) FILTER (WHERE l_returnflag = 'R') AS errors,
    max(l_shipdate) AS completed_at FROM lineitem GROUP BY l_orderkey),
runs AS (SELECT o_orderkey AS run_id, o_custkey AS sync_id, c_nationkey AS tenant, o_orderpriority AS connector,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS status,
    o_orderdate AS started_at, completed_at, records_extracted, records_transformed, records_loaded, errors
  FROM orders JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)
"""


@query("agg01_count_by_tenant", RUNS_SQL + "SELECT tenant, CAST(count(*) AS BIGINT) AS runs FROM runs GROUP BY tenant")
def _agg01(spark, sf):
    return R.count_by(runs(spark, sf), ["tenant"], "runs")


@query("agg02_record_totals", RUNS_SQL + """SELECT tenant, connector, CAST(sum(records_extracted) AS BIGINT) AS records_extracted,
  CAST(sum(records_transformed) AS BIGINT) AS records_transformed, CAST(sum(records_loaded) AS BIGINT) AS records_loaded
FROM runs GROUP BY tenant, connector""")
def _agg02(spark, sf):
    cols = ["records_extracted", "records_transformed", "records_loaded"]
    out = R.totals_by(runs(spark, sf), ["tenant", "connector"], cols)
    return out.select("tenant", "connector", *[F.col(c).cast("bigint").alias(c) for c in cols])


@query("agg03_throughput", """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type,
  round(sum(value) / 300.0, 9) AS value_per_sec, round(count(*) / 300.0, 9) AS events_per_sec
FROM events GROUP BY ALL""")
def _agg03(spark, sf):
    ev = load(spark, sf, "events").withColumn("events", F.lit(1))
    out = R.rate_per_window(ev, "ts", ["value", "events"], "5 minutes", 300, keys=["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type",
                      F.round("value_per_sec", 9).alias("value_per_sec"), F.round("events_per_sec", 9).alias("events_per_sec"))


@query("agg04_outcomes_per_window", RUNS_SQL + """SELECT time_bucket(INTERVAL '1 minute', started_at) AS window_start,
  CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS n_completed,
  CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (WHERE status = 'cancelled') AS BIGINT) AS n_cancelled FROM runs GROUP BY 1""")
def _agg04(spark, sf):
    out = R.outcomes_per_window(runs(spark, sf), "started_at", "status", ["completed", "failed", "cancelled"], "1 minute")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


ERR_SQL = """WITH er AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
    CASE WHEN value > 25 THEN 'timeout' ELSE 'validation' END AS error_type, 'c' || CAST(user_id % 5 AS VARCHAR) AS connector
  FROM events WHERE event_type = 'error')
"""


@query("agg05_error_rates", ERR_SQL + """SELECT window_start, error_type, connector, CAST(count(*) AS BIGINT) AS errors,
  CASE GROUPING(window_start, error_type, connector) WHEN 3 THEN 'total' WHEN 1 THEN 'by_type' ELSE 'by_connector' END AS level
FROM er GROUP BY GROUPING SETS ((window_start), (window_start, error_type), (window_start, connector))""")
def _agg05(spark, sf):
    ev = load(spark, sf, "events").filter(F.col("event_type") == "error").select(
        "ts", F.when(F.col("value") > 25, "timeout").otherwise("validation").alias("error_type"),
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("connector"))
    out = R.error_rates(ev, "ts", "error_type", "connector", "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _bucket_sql(v, bounds):
    parts = " ".join(f"WHEN {v} <= {b} THEN {i}" for i, b in enumerate(bounds))
    return f"CASE {parts} ELSE {len(bounds)} END"


def _quantile_sql(source, keys, v, bounds):
    blist = "[" + ", ".join(str(float(b)) for b in bounds) + "]"
    k = ", ".join(keys)
    return f"""WITH b AS (SELECT {k}, {_bucket_sql(v, bounds)} AS bucket FROM {source}),
c AS (SELECT {k}, bucket, count(*) AS cnt FROM b GROUP BY ALL),
h AS (SELECT {k}, bucket, cnt, sum(cnt) OVER (PARTITION BY {k} ORDER BY bucket) AS cum, sum(cnt) OVER (PARTITION BY {k}) AS total FROM c),
qs AS (SELECT CAST(unnest([0.5, 0.9, 0.95, 0.99]) AS DOUBLE) AS q),
pk AS (SELECT {k}, q, min(bucket) AS bucket FROM h, qs WHERE cum >= q * total GROUP BY ALL),
j AS (SELECT pk.*, h.cnt, h.cum, h.total FROM pk JOIN h USING ({k}, bucket))
SELECT {k}, q AS quantile, round(CASE WHEN bucket = {len(bounds)} THEN {float(bounds[-1])}
  ELSE (CASE WHEN bucket = 0 THEN 0.0 ELSE {blist}[bucket] END)
     + ({blist}[bucket + 1] - CASE WHEN bucket = 0 THEN 0.0 ELSE {blist}[bucket] END) * (q * total - (cum - cnt)) / cnt END, 9) AS value
FROM j"""


def _quantiles(df, value, bounds, keys):
    h = R.histogram(df.withColumn("_v", value), "_v", bounds, keys)
    outs = []
    for q in (0.5, 0.9, 0.95, 0.99):
        outs.append(R.histogram_quantile(h, q, bounds, keys, name="value").select(*keys, F.lit(q).alias("quantile"), F.round("value", 9).alias("value")))
    return R.concat_parts(*outs)


@query("agg06_latency_quantiles", _quantile_sql("(SELECT event_type, value / 10 AS v FROM events)", ["event_type"], "v", R.CONNECTOR_OP_BOUNDS))
def _agg06(spark, sf):
    return _quantiles(load(spark, sf, "events"), F.col("value") / 10, R.CONNECTOR_OP_BOUNDS, ["event_type"])


@query("agg07_p95_by_connector", "SELECT * FROM (" + _quantile_sql("(SELECT l_returnflag, l_quantity / 10 AS v FROM lineitem)",
                                                                   ["l_returnflag"], "v", R.CONNECTOR_OP_BOUNDS) + ") WHERE quantile = 0.95")
def _agg07(spark, sf):
    h = R.histogram(load(spark, sf, "lineitem").withColumn("_v", F.col("l_quantity") / 10), "_v", R.CONNECTOR_OP_BOUNDS, ["l_returnflag"])
    q = R.histogram_quantile(h, 0.95, R.CONNECTOR_OP_BOUNDS, ["l_returnflag"], name="value")
    return q.select("l_returnflag", F.lit(0.95).alias("quantile"), F.round("value", 9).alias("value"))


@query("agg08_duration_histogram", f"""WITH b AS (SELECT {_bucket_sql('value * 10', R.SYNC_DURATION_BOUNDS)} AS bucket FROM events),
c AS (SELECT bucket, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY bucket)
SELECT bucket, CASE WHEN bucket < {len(R.SYNC_DURATION_BOUNDS)} THEN {[float(x) for x in R.SYNC_DURATION_BOUNDS]}[bucket + 1] END AS le, count,
  CAST(sum(count) OVER (ORDER BY bucket) AS BIGINT) AS cumulative FROM c""")
def _agg08(spark, sf):
    return R.histogram(load(spark, sf, "events").withColumn("_d", F.col("value") * 10), "_d", R.SYNC_DURATION_BOUNDS)


@query("agg08_batch_sizes", f"""WITH n AS (SELECT event_type, count(*) AS v FROM events GROUP BY event_type, CAST(ts AS DATE)),
b AS (SELECT event_type, {_bucket_sql('v', R.BATCH_SIZE_BOUNDS)} AS bucket FROM n),
c AS (SELECT event_type, bucket, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY ALL)
SELECT event_type, bucket, CASE WHEN bucket < {len(R.BATCH_SIZE_BOUNDS)} THEN {[float(x) for x in R.BATCH_SIZE_BOUNDS]}[bucket + 1] END AS le, count,
  CAST(sum(count) OVER (PARTITION BY event_type ORDER BY bucket) AS BIGINT) AS cumulative FROM c""")
def _agg08b(spark, sf):
    """A batch is what one event type brings in a day."""
    n = load(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("v"))
    return R.histogram(n, "v", R.BATCH_SIZE_BOUNDS, ["event_type"])


@query("agg08_run_durations", RUNS_SQL + f""", b AS (SELECT status, {_bucket_sql('epoch(completed_at - started_at) / 86400 * 30', R.SYNC_DURATION_BOUNDS)} AS bucket FROM runs)
SELECT status, bucket, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY ALL""")
def _agg08c(spark, sf):
    """Run durations (a day in the tables stands for thirty seconds)."""
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return R.histogram(runs(spark, sf).withColumn("_d", seconds / 86400 * 30), "_d", R.SYNC_DURATION_BOUNDS, ["status"]).select("status", "bucket", "count")


@query("agg06_api_latency", f"""WITH b AS (SELECT event_type, {_bucket_sql('value / 100', R.API_LATENCY_BOUNDS)} AS bucket FROM events)
SELECT event_type, bucket, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY ALL""")
def _agg06b(spark, sf):
    ev = load(spark, sf, "events").withColumn("_s", F.col("value") / 100)
    return R.histogram(ev, "_s", R.API_LATENCY_BOUNDS, ["event_type"]).select("event_type", "bucket", "count")


@query("agg09_utilisation", RUNS_SQL + """SELECT connector, round(count(*) FILTER (WHERE status = 'failed') * 100.0
  / greatest(count(*) FILTER (WHERE status = 'completed'), 1), 9) AS utilisation FROM runs GROUP BY connector""")
def _agg09(spark, sf):
    g = runs(spark, sf).groupBy("connector").agg(F.count_if(F.col("status") == "failed").alias("active"),
                                                 F.count_if(F.col("status") == "completed").alias("pool"))
    return g.select("connector", F.round(R.utilisation(F.col("active"), F.col("pool")), 9).alias("utilisation"))


@query("agg10_by_connector_status", RUNS_SQL + "SELECT connector, status, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY ALL")
def _agg10(spark, sf):
    return R.count_by(runs(spark, sf), ["connector", "status"])


@query("agg10_active_connections", RUNS_SQL + """SELECT connector, CAST(count(*) AS BIGINT) AS active FROM runs
WHERE started_at <= TIMESTAMP '1997-06-01' AND (completed_at IS NULL OR completed_at > TIMESTAMP '1997-06-01') GROUP BY connector""")
def _agg10b(spark, sf):
    return R.active_by(runs(spark, sf), ["connector"], "started_at", "completed_at", dt.datetime(1997, 6, 1))


@query("agg10_call_rates", """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, round(count(*) / 300.0, 9) AS calls_per_sec FROM events GROUP BY ALL""")
def _agg10c(spark, sf):
    out = R.call_rates(load(spark, sf, "events"), "ts", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.round("calls_per_sec", 9).alias("calls_per_sec"))


@query("agg11_alert_windows", """WITH p AS (SELECT date_trunc('hour', ts) AS period,
    count(*) FILTER (WHERE event_type = 'error') / count(*) AS failure_rate FROM events GROUP BY 1),
hot AS (SELECT *, CAST(epoch(period) / 3600 AS BIGINT) - row_number() OVER (ORDER BY period) AS island FROM p WHERE failure_rate > 0.25)
SELECT min(period) AS alert_start, max(period) AS alert_end, CAST(count(*) AS BIGINT) AS periods, max(failure_rate) AS peak_rate
FROM hot GROUP BY island HAVING count(*) >= 3""")
def _agg11(spark, sf):
    out = R.alert_windows(load(spark, sf, "events"), "ts", F.col("event_type") == "error", 0.25, hold=3, grain="hour")
    return out.withColumn("alert_start", F.col("alert_start").cast("timestamp_ntz")).withColumn("alert_end", F.col("alert_end").cast("timestamp_ntz"))


ALERT_TYPE_SQL = ("CASE WHEN status = 'failed' AND records_loaded = 0 THEN 'load_failed' WHEN status = 'failed' THEN 'partial_failure' "
                  "WHEN status = 'cancelled' THEN 'sync_degraded' ELSE 'none' END")


@query("agg12_alert_severity", RUNS_SQL + f"""SELECT run_id, {ALERT_TYPE_SQL} AS alert_type,
  CASE {ALERT_TYPE_SQL} WHEN 'load_failed' THEN 'critical' WHEN 'partial_failure' THEN 'warning' WHEN 'sync_degraded' THEN 'warning'
  ELSE 'info' END AS severity FROM runs""")
def _agg12(spark, sf):
    r = runs(spark, sf).withColumn("alert_type", F.expr(ALERT_TYPE_SQL))
    return r.select("run_id", "alert_type", R.alert_severity(F.col("alert_type")).alias("severity"))


@query("agg13_quota_status", RUNS_SQL + """, usage AS (SELECT tenant, date_trunc('month', started_at) AS month, 'records' AS resource,
    CAST(sum(records_extracted) AS BIGINT) AS used FROM runs GROUP BY ALL),
quotas AS (SELECT n_nationkey AS tenant, 'records' AS resource, CAST(50 * (n_regionkey + 1) AS BIGINT) AS quota_limit,
    CASE WHEN n_regionkey = 4 THEN 'suspended' ELSE 'active' END AS status FROM nation)
SELECT u.tenant, month, u.resource, used, quota_limit, status <> 'active' OR used >= quota_limit AS blocked,
  CASE WHEN status <> 'active' THEN 'inactive' WHEN used >= quota_limit THEN 'limit_reached' END AS reason
FROM usage u JOIN quotas q ON u.tenant = q.tenant AND u.resource = q.resource""")
def _agg13(spark, sf):
    r = runs(spark, sf)
    usage = r.groupBy("tenant", F.date_trunc("month", F.col("started_at")).cast("timestamp_ntz").alias("month")).agg(
        F.lit("records").alias("resource"), F.sum("records_extracted").cast("bigint").alias("used"))
    quotas = load(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("tenant"), F.lit("records").alias("resource"),
        (F.lit(50) * (F.col("n_regionkey") + 1)).cast("bigint").alias("quota_limit"),
        F.when(F.col("n_regionkey") == 4, "suspended").otherwise("active").alias("status"))
    usage = usage.withColumn("tenant", F.col("tenant").cast("bigint"))
    return R.quota_status(usage, quotas, "tenant")


@query("agg13_four_resources", RUNS_SQL + """, usage AS (
  SELECT tenant, date_trunc('month', started_at) AS month, 'records' AS resource, CAST(sum(records_extracted) AS BIGINT) AS used FROM runs GROUP BY ALL
  UNION ALL SELECT tenant, NULL, 'connectors', CAST(count(DISTINCT connector) AS BIGINT) FROM runs GROUP BY tenant
  UNION ALL SELECT tenant, NULL, 'syncs', CAST(count(DISTINCT sync_id) AS BIGINT) FROM runs GROUP BY tenant
  UNION ALL SELECT tenant, NULL, 'storage', CAST(sum(records_loaded) * 100 AS BIGINT) FROM runs GROUP BY tenant),
quotas AS (SELECT n_nationkey AS tenant, r AS resource, CAST(l * (n_regionkey + 1) AS BIGINT) AS quota_limit, CASE WHEN n_regionkey = 4 THEN 'suspended' ELSE 'active' END AS status
  FROM nation, (VALUES ('records', 50), ('connectors', 2), ('syncs', 20), ('storage', 30000)) q(r, l))
SELECT u.tenant, month, u.resource, used, quota_limit, status <> 'active' OR used >= quota_limit AS blocked,
  CASE WHEN status <> 'active' THEN 'inactive' WHEN used >= quota_limit THEN 'limit_reached' END AS reason
FROM usage u JOIN quotas q ON u.tenant = q.tenant AND u.resource = q.resource""")
def _agg13b(spark, sf):
    r = runs(spark, sf).withColumn("tenant", F.col("tenant").cast("bigint"))
    monthly = r.groupBy("tenant", F.date_trunc("month", F.col("started_at")).cast("timestamp_ntz").alias("month")).agg(
        F.lit("records").alias("resource"), F.sum("records_extracted").cast("bigint").alias("used"))
    now = r.groupBy("tenant").agg(F.count_distinct("connector").alias("connectors"), F.count_distinct("sync_id").alias("syncs"), (F.sum("records_loaded") * 100).cast("bigint").alias("storage"))
    rest = now.select("tenant", F.lit(None).cast("timestamp_ntz").alias("month"), F.explode(F.create_map(*[x for k in ("connectors", "syncs", "storage") for x in (F.lit(k), F.col(k))])).alias("resource", "used"))
    limits = F.create_map(*[x for k, v in (("records", 50), ("connectors", 2), ("syncs", 20), ("storage", 30000)) for x in (F.lit(k), F.lit(v))])
    quotas = load(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("tenant"), F.explode(limits).alias("resource", "_l"), "n_regionkey",
        F.when(F.col("n_regionkey") == 4, "suspended").otherwise("active").alias("status")).withColumn("quota_limit", (F.col("_l") * (F.col("n_regionkey") + 1)).cast("bigint"))
    return R.quota_status(monthly.unionByName(rest), quotas.select("tenant", "resource", "quota_limit", "status"), "tenant")


@query("agg14_phase_progress", RUNS_SQL + """, p AS (SELECT run_id, CASE status WHEN 'completed' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END AS idx,
    records_extracted AS e, records_loaded AS l, records_extracted + errors AS t FROM runs)
SELECT run_id,
  CASE WHEN idx > 0 THEN 100.0 WHEN t = 0 THEN 0.0 ELSE round(e / t * 100.0, 9) END AS extract_pct,
  CASE WHEN idx > 1 THEN 100.0 WHEN idx = 1 THEN CASE WHEN t = 0 THEN 0.0 ELSE round(e / t * 100.0, 9) END ELSE 0.0 END AS transform_pct,
  CASE WHEN idx = 2 THEN CASE WHEN t = 0 THEN 0.0 ELSE round(l / greatest(e, 1) * 100.0, 9) END ELSE 0.0 END AS load_pct
FROM p""")
def _agg14(spark, sf):
    r = runs(spark, sf)
    phase = F.when(F.col("status") == "completed", "load").when(F.col("status") == "failed", "transform").otherwise("extract")
    cols = R.phase_progress(phase, F.col("records_extracted"), F.col("records_loaded"), F.col("records_extracted") + F.col("errors"))
    names = [f"{p}_pct" for p in R.PHASES]
    return r.select("run_id", *[F.round(c, 9).alias(n) for c, n in zip(cols, names)])


@query("agg15_run_summary", RUNS_SQL + """SELECT run_id, epoch_ms(completed_at) - epoch_ms(started_at) AS duration_ms, CAST(errors AS BIGINT) AS error_count,
  CASE WHEN errors > 0 AND records_extracted = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'completed' END AS result FROM runs""")
def _agg15(spark, sf):
    out = R.run_summary(runs(spark, sf), "started_at", "completed_at", "records_extracted", "records_loaded", "errors")
    return out.select("run_id", "duration_ms", "error_count", "result")


@query("agg16_success_rate", RUNS_SQL + """SELECT tenant, round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 9) AS success_rate
FROM runs GROUP BY tenant""")
def _agg16(spark, sf):
    out = R.success_rate(runs(spark, sf), "status", ["tenant"])
    return out.select("tenant", F.round("success_rate", 9).alias("success_rate"))
