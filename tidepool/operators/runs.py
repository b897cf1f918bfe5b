"""Run analytics: latest / paged / sorted runs, set operations, metrics and alerts
(WIN-1..8, SET-1..3, AGG-1..16).

Skew notes: "latest per key" is a ``max_by`` aggregate (map-side combined),
not a window, so a key holding a third of the rows does not pile into one
task. Histograms aggregate to (group, bucket) counts first; cumulative
counts and quantile interpolation then run on that small table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitions import global_rank

# ----------------------------------------------------------------- windows


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WIN-1 / WIN-6: the row with the greatest ``order`` per key (nulls in
    ``order`` rank lowest, i.e. newest-first with nulls last)."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ordc = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.max_by(row, ordc).alias("_r")).select("_r.*")


def latest_run(runs: DataFrame, sync_col: str, started_col: str, tie_col: str) -> DataFrame:
    """WIN-1: latest run of each sync, newest start first, null starts last."""
    return latest_per_key(runs, [sync_col], [started_col, tie_col])


def run_list(runs: DataFrame, sync_col: str, sync_id, started_col: str, tie_col: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """WIN-2: runs of one sync, newest first, with limit / offset (top-k: the limit is the feature)."""
    out = runs.filter(F.col(sync_col) == F.lit(sync_id)).orderBy(F.col(started_col).desc_nulls_last(), F.col(tie_col).desc())
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


# Page size default and maximum of the listing API.
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100


def clamp_page(page: int | None, size: int | None) -> tuple[int, int]:
    """WIN-3: page >= 1; size defaults to 20 and is capped at 100."""
    p = page if page and page >= 1 else 1
    s = size if size and size >= 1 else DEFAULT_PAGE_SIZE
    return p, min(s, MAX_PAGE_SIZE)


def paginate(df: DataFrame, order: list, page: int | None = 1, size: int | None = DEFAULT_PAGE_SIZE) -> DataFrame:
    """WIN-3: one page of ``df`` in ``order`` plus ``total`` and ``total_pages`` columns.

    The total is a scalar subquery (``DataFrame.scalar``), computed in the
    same job as a one-row aggregate -- no partition-less window.
    """
    p, s = clamp_page(page, size)
    total = df.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    ordered = df.orderBy(*order)
    rows = ordered.offset((p - 1) * s).limit(s) if p > 1 else ordered.limit(s)
    return rows.withColumn("total", total).withColumn("total_pages", F.ceil(total / F.lit(s)).cast("bigint"))


def sort_rank(df: DataFrame, sort_col: str, tie_col: str, descending: bool = False, numeric: bool | None = None, name: str = "sort_rank") -> DataFrame:
    """WIN-4: position of every run when sorted by any column; text sorts with null as "".

    Uses :func:`global_rank` (range partitioning), so the whole table is
    ranked without a single-partition window.
    """
    c = F.col(sort_col)
    if numeric is None:
        numeric = not (df.schema[sort_col].dataType.typeName() == "string")
    key = c if numeric else F.coalesce(c.cast("string"), F.lit(""))
    tmp = df.withColumn("_sk", key)
    o = [F.col("_sk").desc(), F.col(tie_col).desc()] if descending else [F.col("_sk").asc(), F.col(tie_col).asc()]
    return global_rank(tmp, o, name).drop("_sk")


def history(df: DataFrame, time_col: str, tie_col: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """WIN-5 / WIN-7 / WIN-8: newest first, offset then limit (the page is the feature)."""
    out = df.orderBy(F.col(time_col).desc(), F.col(tie_col).desc())
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


# -------------------------------------------------------------------- sets

def concat_parts(*parts: DataFrame) -> DataFrame:
    """SET-1: concatenate partition outputs (same columns)."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def ragged_union(*parts: DataFrame) -> DataFrame:
    """SET-2: union of records with different column sets; missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def field_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3: union of field names of two schemas (per key)."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def field_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3: fields of ``a`` not in ``b``."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


# ----------------------------------------------------------------- metrics

def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """AGG-1 / AGG-10."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(name))


def active_by(df: DataFrame, keys: list[str], started: str, ended: str, at) -> DataFrame:
    """AGG-10: connections (runs) that are active at a time, per key."""
    t = F.lit(at)
    return df.where((F.col(started) <= t) & (F.col(ended).isNull() | (F.col(ended) > t))).groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("active"))


def call_rates(df: DataFrame, ts: str, keys: list[str], duration: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """AGG-10: calls per second in tumbling windows by status, connector, ..."""
    return df.groupBy(window_start(ts, duration).alias("window_start"), *keys).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("calls_per_sec"))


def totals_by(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """AGG-2: sums of record counters by dimension."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def window_start(ts: str, duration: str) -> Column:
    return F.window(F.col(ts).cast("timestamp"), duration).start


def rate_per_window(df: DataFrame, ts: str, cols: list[str], duration: str = "5 minutes", seconds: int = 300, keys: list[str] | None = None) -> DataFrame:
    """AGG-3: per-second rates of counters in tumbling windows."""
    return df.groupBy(window_start(ts, duration).alias("window_start"), *(keys or [])).agg(
        *[(F.sum(c) / F.lit(float(seconds))).alias(f"{c}_per_sec") for c in cols])


def outcomes_per_window(df: DataFrame, ts: str, status: str, statuses: list[str], duration: str = "1 minute") -> DataFrame:
    """AGG-4: run outcomes per window, one column per status."""
    return df.groupBy(window_start(ts, duration).alias("window_start")).agg(
        *[F.count_if(F.col(status) == F.lit(s)).cast("bigint").alias(f"n_{s.lower()}") for s in statuses])


def error_rates(df: DataFrame, ts: str, type_col: str, connector_col: str, duration: str = "1 minute") -> DataFrame:
    """AGG-5: errors per window in total, by type and by connector -- one pass with grouping sets."""
    w = window_start(ts, duration).alias("window_start")
    base = df.select(w, F.col(type_col).alias("error_type"), F.col(connector_col).alias("connector"))
    out = base.groupingSets(
        [["window_start"], ["window_start", "error_type"], ["window_start", "connector"]],
        "window_start", "error_type", "connector",
    ).agg(F.count(F.lit(1)).cast("bigint").alias("errors"), F.grouping_id().alias("_gid"))
    level = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "by_type").otherwise("by_connector")
    return out.withColumn("level", level).drop("_gid")


# Histogram bounds of the metric families.
SYNC_DURATION_BOUNDS = [1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600]
API_LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5]
BATCH_SIZE_BOUNDS = [1, 10, 50, 100, 250, 500, 1000, 2500, 5000, 10000]
CONNECTOR_OP_BOUNDS = [0.01, 0.05, 0.1, 0.5, 1, 5, 15, 30, 60, 300]


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Index of the first bound >= value (``len(bounds)`` = the +Inf bucket)."""
    expr = None
    for i, b in enumerate(bounds):
        cond = value <= F.lit(float(b))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(bounds)))


def histogram(df: DataFrame, value_col: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """AGG-6 / AGG-8: bucket counts and cumulative ("le") counts per group.

    Columns: keys, ``bucket`` (index), ``le`` (upper bound, null for +Inf),
    ``count``, ``cumulative``. The window runs per group over at most
    ``len(bounds)+1`` rows.
    """
    keys = keys or []
    b = bucket_of(F.col(value_col), bounds)
    counts = df.groupBy(*keys, b.alias("bucket")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    ub = F.element_at(F.array(*[F.lit(float(x)) for x in bounds]), F.col("bucket") + 1)
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0) if keys else \
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*keys, "bucket", F.when(F.col("bucket") < len(bounds), ub).alias("le"), "count",
                         F.sum("count").over(w).cast("bigint").alias("cumulative"))


def histogram_quantile(hist: DataFrame, q: float, bounds: list[float], keys: list[str] | None = None, name: str | None = None) -> DataFrame:
    """AGG-6: quantile from bucket counts, linear inside the bucket; the +Inf bucket gives the last bound.

    Bucket i spans (bounds[i-1], bounds[i]] with a lower edge of 0 for the first.
    """
    keys = keys or []
    name = name or f"p{int(round(q * 100))}"
    totals = hist.groupBy(*keys).agg(F.max("cumulative").alias("_total"))
    h = hist.join(totals, keys, "inner") if keys else hist.withColumn("_total", F.max("cumulative").over(Window.partitionBy()))
    h = h.withColumn("_rank", F.lit(q) * F.col("_total"))
    hit = h.filter(F.col("cumulative") >= F.col("_rank"))
    pick = hit.groupBy(*keys).agg(F.min_by(F.struct("bucket", "le", "count", "cumulative", "_rank"), F.col("bucket")).alias("_p")) if keys \
        else hit.agg(F.min_by(F.struct("bucket", "le", "count", "cumulative", "_rank"), F.col("bucket")).alias("_p"))
    bucket = F.col("_p.bucket")
    lo = F.when(bucket == 0, F.lit(0.0)).otherwise(F.element_at(F.array(*[F.lit(float(x)) for x in bounds]), bucket))
    prev = F.col("_p.cumulative") - F.col("_p.count")
    interp = lo + (F.col("_p.le") - lo) * (F.col("_p._rank") - prev) / F.col("_p.count")
    val = F.when(F.col("_p.le").isNull(), F.lit(float(bounds[-1]))).otherwise(interp)
    return pick.select(*keys, val.alias(name))


def utilisation(active: Column, pool: Column) -> Column:
    """AGG-9: active / max(pool, 1) * 100."""
    return active / F.greatest(pool, F.lit(1)) * 100.0


GRAIN_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def alert_windows(df: DataFrame, ts: str, failed: Column, threshold: float, hold: int = 10, grain: str = "minute",
                  keys: list[str] | None = None) -> DataFrame:
    """AGG-11: alert windows where the failure rate per ``grain`` stays above
    ``threshold`` for at least ``hold`` consecutive periods (gaps and islands).

    Periods are aggregated first (one row per series and period); islands
    come from ``period_number - row_number`` per series, so each window holds
    only one series' periods, never raw rows.
    """
    keys = keys or []
    unit = GRAIN_SECONDS[grain]
    p = F.date_trunc(grain, F.col(ts).cast("timestamp"))
    per = df.groupBy(*keys, p.alias("period")).agg((F.count_if(failed) / F.count(F.lit(1))).alias("failure_rate"))
    hot = per.filter(F.col("failure_rate") > F.lit(threshold))
    num = (F.unix_seconds("period") / unit).cast("bigint")
    w = Window.partitionBy(*keys).orderBy("period") if keys else Window.orderBy("period")
    isl = hot.withColumn("_island", num - F.row_number().over(w))
    return isl.groupBy(*keys, "_island").agg(
        F.min("period").alias("alert_start"), F.max("period").alias("alert_end"),
        F.count(F.lit(1)).cast("bigint").alias("periods"), F.max("failure_rate").alias("peak_rate"),
    ).filter(F.col("periods") >= hold).drop("_island")


# Alert type -> severity.
ALERT_SEVERITY = {
    "extract_failed": "critical",
    "load_failed": "critical",
    "transform_failed": "critical",
    "sync_degraded": "warning",
    "partial_failure": "warning",
}


def alert_severity(alert_type: Column) -> Column:
    """AGG-12: severity by alert type, ``info`` otherwise."""
    expr = F.when(F.lit(False), F.lit(None))
    for t, s in ALERT_SEVERITY.items():
        expr = expr.when(alert_type == F.lit(t), F.lit(s))
    return expr.otherwise(F.lit("info"))


def quota_status(usage: DataFrame, quotas: DataFrame, tenant: str, month_col: str = "month") -> DataFrame:
    """AGG-13: usage vs quota per tenant, resource and month; at or over the limit
    is blocked, an inactive tenant is blocked whatever the usage.

    ``usage(tenant, month, resource, used)`` (resource: records of the month, or
    connectors, syncs and storage bytes, whose month is null),
    ``quotas(tenant, resource, quota_limit, status)``.
    """
    j = usage.join(quotas, [tenant, "resource"], "inner")
    blocked = (F.col("status") != F.lit("active")) | (F.col("used") >= F.col("quota_limit"))
    reason = F.when(F.col("status") != F.lit("active"), F.lit("inactive")).when(
        F.col("used") >= F.col("quota_limit"), F.lit("limit_reached"))
    return j.select(tenant, month_col, "resource", "used", "quota_limit", blocked.alias("blocked"), reason.alias("reason"))


PHASES = ("extract", "transform", "load")


def phase_progress(phase: Column, extracted: Column, loaded: Column, total: Column) -> list[Column]:
    """AGG-14: percent per phase: earlier phases 100, later 0; load is loaded over max(extracted, 1)."""
    idx = F.when(phase == "extract", 0).when(phase == "transform", 1).when(phase == "load", 2).otherwise(-1)
    cur = {
        "extract": extracted / total * 100.0,
        "transform": extracted / total * 100.0,
        "load": loaded / F.greatest(extracted, F.lit(1)) * 100.0,
    }
    out = []
    for i, p in enumerate(PHASES):
        v = F.when(idx > i, F.lit(100.0)).when(idx == i, F.when(total == 0, F.lit(0.0)).otherwise(cur[p].cast("double"))).otherwise(F.lit(0.0))
        out.append(v.alias(f"{p}_pct"))
    return out


def run_summary(runs: DataFrame, started: str, completed: str, extracted: str, loaded: str, errors: str) -> DataFrame:
    """AGG-15: duration, counters, error count and result shape of each run.

    Shape: ``failed`` when nothing was extracted and errors exist, ``partial``
    when records were extracted but errors exist, else ``completed``.
    """
    n_err = F.coalesce(F.size(F.col(errors)), F.lit(0)) if dict(runs.dtypes).get(errors, "").startswith("array") else F.coalesce(F.col(errors), F.lit(0))
    dur = F.unix_millis(F.col(completed).cast("timestamp")) - F.unix_millis(F.col(started).cast("timestamp"))
    shape = F.when((n_err > 0) & (F.col(extracted) == 0), "failed").when(n_err > 0, "partial").otherwise("completed")
    return runs.withColumn("duration_ms", dur).withColumn("error_count", n_err.cast("bigint")).withColumn("result", shape)


def success_rate(runs: DataFrame, status: str, keys: list[str] | None = None, ok_value: str = "completed") -> DataFrame:
    """AGG-16: share of runs with the success status."""
    agg = F.avg(F.when(F.col(status) == F.lit(ok_value), 1.0).otherwise(0.0)).alias("success_rate")
    return runs.groupBy(*keys).agg(agg) if keys else runs.agg(agg)
