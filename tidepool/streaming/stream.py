"""Structured Streaming operators (DED-7, STR-1..7).

The same Column functions as the batch operators run on streaming
DataFrames. Sinks go through ``foreachBatch`` with the batch id as the
idempotency key: a replayed batch overwrites exactly what it wrote before,
and data is committed before the checkpoint state (``checkpointLocation``)
moves on, which gives exactly-once output on a file sink.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .admission import admission_rejects, admit, admit_ordered  # noqa: F401  (STR-5)

# Micro-batch size and interval of the loader.
DEFAULT_MAX_ROWS = 1000  # of one load batch, see batch_parquet_sink
DEFAULT_INTERVAL = "5 seconds"


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Zone-less timestamps (``timestamp_ntz``) as instants so watermarks accept them (UTC session)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str,
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """STR-1 source side: a file stream whose micro-batch size is bounded by files per trigger."""
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_dedup(df: DataFrame, keys: list[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """DED-7: drop a key seen before, however long ago: the keys stay in the
    state store (use the RocksDB store where they outgrow memory).

    With ``ts`` and ``watermark`` state older than the watermark is dropped,
    and rows that arrive later than that are lost: a choice for feeds whose
    lateness is known to be bounded.
    """
    if watermark is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def window_metrics(df: DataFrame, ts: str, duration: str, keys: list[str], aggs: list[Column], watermark: str | None = None) -> DataFrame:
    """STR-6: tumbling-window aggregates; late rows change their window (update
    mode). With a ``watermark`` closed windows leave the state, and rows later
    than it are lost."""
    rows = df if watermark is None else df.withWatermark(ts, watermark)
    return rows.groupBy(F.window(ts, duration).alias("window"), *keys).agg(*aggs)


def run_stream(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
               available_now: bool = True, interval: str = DEFAULT_INTERVAL, output_mode: str = "append",
               query_name: str | None = None):
    """STR-1 / STR-3: run ``df`` into ``sink(batch_df, batch_id)`` with a checkpoint.

    ``available_now`` drains what is there and stops (the final flush);
    otherwise micro-batches fire every ``interval``. Returns the finished
    (available-now) or running query.
    """
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(output_mode)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def batch_parquet_sink(target: str, state_target: str | None = None, state_fn: Callable[[DataFrame], DataFrame] | None = None,
                       max_rows: int | None = None):
    """STR-1 / STR-3 / SNK-11: idempotent foreachBatch sink.

    Data of batch ``n`` goes to ``target/batch_id=n`` (overwritten on replay)
    in load batches (files) of at most ``max_rows`` rows; only after that
    write succeeds is the batch's state row written to
    ``state_target/batch_id=n``.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if max_rows:
            w = w.option("maxRecordsPerFile", max_rows)
        w.parquet(os.path.join(target, f"batch_id={batch_id}"))
        if state_target and state_fn is not None:
            state_fn(batch).write.mode("overwrite").parquet(os.path.join(state_target, f"batch_id={batch_id}"))

    return sink


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Committed versions (``v=<n>`` folders holding ``_SUCCESS``) of a versioned table."""
    from ..session import fs_exists, fs_list

    out = []
    for name, is_dir in fs_list(spark, target):
        if is_dir and name.startswith("v=") and fs_exists(spark, f"{target.rstrip('/')}/{name}/_SUCCESS"):
            out.append(int(name[2:]))
    return sorted(out)


def _bucket_paths(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Newest committed folder of each key bucket (of versions below ``before``)."""
    from ..session import fs_list

    out = {}
    for v in _versions(spark, target):
        if before is None or v < before:
            for name, is_dir in fs_list(spark, f"{target.rstrip('/')}/v={v}"):
                if is_dir and name.startswith("_bucket="):
                    out[int(name[len("_bucket="):])] = f"{target.rstrip('/')}/v={v}/{name}"
    return out


def _bucket_count(spark: SparkSession, target: str, buckets: int) -> int:
    """The number of key buckets that the table was made with; ``buckets`` for a new one."""
    from ..session import write_once

    path = f"{target.rstrip('/')}/buckets.json"
    write_once(spark, path, f'{{"buckets": {buckets}}}')
    return spark.read.schema("buckets int").json(path).first()["buckets"]


def upsert_sink(target: str, keys: list[str], order_by: list[str], buckets: int = 16):
    """STR-7: upsert each micro-batch into a parquet table of key buckets.

    The table keeps the number of its buckets from its first batch on, whatever
    ``buckets`` says later. Target and changes compete by ``order_by`` (columns of the table), so an
    older change that arrives later never replaces a newer row; on a tie the
    change wins. Only buckets with changed keys are written, as version
    ``v=<batch>``; the folders they replace are deleted once the version is
    committed. A replayed batch that is committed already does nothing. All
    listing and deleting goes through the Hadoop file system API.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in _versions(spark, target):
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(_bucket_count(spark, target, buckets))).cast("int")
        changes = batch.withColumn("_bucket", bucket)
        touched = [r[0] for r in changes.select("_bucket").distinct().collect()]  # at most `buckets`
        held = _bucket_paths(spark, target, batch_id)
        old = {k: held[k] for k in touched if k in held}
        rows = changes.withColumn("_tag", F.lit(1))
        if old:
            current = spark.read.parquet(*old.values()).withColumn("_bucket", bucket).withColumn("_tag", F.lit(0))
            rows = rows.unionByName(current, allowMissingColumns=True)
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_tag"])
        newest = rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order_by, "_tag")).alias("_r")).select("_r.*")
        newest.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target.rstrip('/')}/v={batch_id}")
        for path in old.values():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return sink


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the newest committed version, for tables written by
    :func:`upsert_sink` (key buckets) and :func:`soft_delete_sink`."""
    paths = _bucket_paths(spark, target)
    if paths:
        return spark.read.parquet(*paths.values())
    return spark.read.parquet(f"{target.rstrip('/')}/v={_versions(spark, target)[-1]}")


def soft_delete_sink(target: str, keys: list[str], deleted_at, snapshot_col: str = "snapshot_id", size_col: str = "snapshot_rows"):
    """STR-7: full snapshots, each possibly spread over many micro-batches.

    Every row names its snapshot (an ascending number) and how many rows that
    has. Batches are staged by snapshot; only open snapshots are read, and what an applied one
    left is deleted. Once all rows of a snapshot are there it is
    applied as version ``v=<snapshot>``: its rows are inserted or replace
    the target's, keys missing from it are flagged deleted (keeping an
    earlier time), keys that come back are live again. A snapshot that never
    completes changes nothing.
    """
    from ..operators.conflict import null_safe_join
    from ..session import fs_delete, fs_list

    staging = f"{target.rstrip('/')}/_staging"

    def apply(spark, snapshot: DataFrame, version: int) -> None:
        live = snapshot.drop(snapshot_col, size_col, "batch_id").withColumns({"_deleted": F.lit(False), "_deleted_at": F.lit(None).cast("timestamp")})
        done = [v for v in _versions(spark, target) if v < version]
        if done:
            current = spark.read.parquet(f"{target.rstrip('/')}/v={done[-1]}")
            gone = null_safe_join(current, live.select(*keys), keys, "left_anti")
            gone = gone.withColumn("_deleted_at", F.coalesce("_deleted_at", F.lit(deleted_at).cast("timestamp"))).withColumn("_deleted", F.lit(True))
            live = live.unionByName(gone, allowMissingColumns=True)
        live.write.mode("overwrite").parquet(f"{target.rstrip('/')}/v={version}")

    def open_snapshots(spark, applied: int | None) -> dict[int, list[str]]:
        """Staged folders by snapshot; those of applied snapshots are deleted."""
        out: dict[int, list[str]] = {}
        for part, _ in fs_list(spark, staging):
            for name, is_dir in fs_list(spark, f"{staging}/{part}"):
                if is_dir and name.startswith(f"{snapshot_col}=") and name.split("=")[1].lstrip("-").isdigit():
                    number = int(name.split("=")[1])
                    if applied is not None and number <= applied:
                        fs_delete(spark, f"{staging}/{part}/{name}")
                    else:
                        out.setdefault(number, []).append(f"{staging}/{part}/{name}")
        return dict(sorted(out.items()))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy(snapshot_col).parquet(f"{staging}/batch_id={batch_id}")
        last = max(_versions(spark, target), default=None)
        for number, paths in open_snapshots(spark, last).items():  # open ones only
            rows = spark.read.parquet(*paths).withColumn(snapshot_col, F.lit(number))
            n, size = rows.agg(F.count(F.lit(1)), F.max(size_col)).first()
            if n == size:
                apply(spark, rows, number)
                last = number
        open_snapshots(spark, last)

    return sink


# ------------------------------------------------------------- webhooks

# Webhook payload shapes and the field each source requires.
WEBHOOK_SCHEMAS = {
    "hubspot": "array<struct<objectId: bigint, propertyName: string, propertyValue: string, subscriptionType: string>>",
    "salesforce": "struct<sobject_type: string, id: string>",
    "zendesk": "struct<event_type: string, id: string>",
    "intercom": "struct<topic: string, id: string>",
}


def parse_webhooks(df: DataFrame, source_col: str = "source", body_col: str = "body", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """STR-4: (events, rejects) from inbound webhook rows.

    HubSpot bodies are non-empty arrays of change events (one output row per
    element); Salesforce needs ``sobject_type``, Zendesk ``event_type``,
    Intercom ``topic``. Works the same on a streaming DataFrame.
    Output events: keep columns, ``source, event_type, object_id``.
    """
    keep = keep or []
    src = F.col(source_col)
    body = F.col(body_col)
    hs = F.from_json(body, WEBHOOK_SCHEMAS["hubspot"])
    sf = F.from_json(body, WEBHOOK_SCHEMAS["salesforce"])
    zd = F.from_json(body, WEBHOOK_SCHEMAS["zendesk"])
    ic = F.from_json(body, WEBHOOK_SCHEMAS["intercom"])
    reason = (
        F.when(~F.coalesce(src.isin(*WEBHOOK_SCHEMAS), F.lit(False)), F.lit("unknown source"))
        .when((src == "hubspot") & (F.coalesce(F.size(hs), F.lit(-1)) <= 0), F.lit("hubspot: expected a non-empty array of events"))
        .when((src == "salesforce") & F.coalesce(sf["sobject_type"], F.lit("")).eqNullSafe(""), F.lit("salesforce: missing sobject_type"))
        .when((src == "zendesk") & F.coalesce(zd["event_type"], F.lit("")).eqNullSafe(""), F.lit("zendesk: missing event_type"))
        .when((src == "intercom") & F.coalesce(ic["topic"], F.lit("")).eqNullSafe(""), F.lit("intercom: missing topic"))
    )
    tagged = df.withColumn("_reason", reason)
    rejects = tagged.filter(F.col("_reason").isNotNull()).select(*keep, source_col, body_col, F.col("_reason").alias("error"))
    ok = tagged.filter(F.col("_reason").isNull())
    one = F.array(F.struct(
        F.coalesce(sf["sobject_type"], zd["event_type"], ic["topic"]).alias("event_type"),
        F.coalesce(sf["id"], zd["id"], ic["id"]).alias("object_id")))
    many = F.transform(hs, lambda e: F.struct(F.coalesce(e["subscriptionType"], e["propertyName"]).alias("event_type"),
                                              e["objectId"].cast("string").alias("object_id")))
    items = F.when(src == "hubspot", many).otherwise(one)
    events = ok.select(*keep, src.alias("source"), F.explode(items).alias("_e")).select(*keep, "source", "_e.event_type", "_e.object_id")
    return events, rejects


# ------------------------------------------------------------ admission

def admit_stream(df: DataFrame, key: str, ts: str, limit: int, window_seconds: float, id_col: str, idle_seconds: float | None = None) -> DataFrame:
    """STR-5 (streaming): the same rule with per-key state ``(window_start, used)``
    kept by ``applyInPandasWithState``; events of a key must arrive in time
    order from batch to batch (inside a batch any order will do; for others see
    :func:`admit_ordered`). The state of a key that has been idle for ``idle_seconds`` (processing time) is dropped;
    that is for queries that run on, as an available-now run would wait for its timers.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    out_schema = f"{key} {dict(df.dtypes)[key]}, {id_col} {dict(df.dtypes)[id_col]}, admitted boolean, window_start timestamp"

    def fn(k, pdfs, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs), ignore_index=True)
        rows = rows[rows[ts].notna()].sort_values([ts, id_col], ignore_index=True)
        t = rows[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        w = int(window_seconds * 1_000_000)
        start, used = (None, 0)
        if state.exists:
            s0, used = state.get
            start = int(pd.Timestamp(s0).value // 1000)
        starts, place = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        i = 0
        while i < len(t):  # one step per window
            if start is None or t[i] >= start + w:
                start, used = int(t[i]), 0
            e = max(int(np.searchsorted(t, start + w, side="left")), i + 1)
            starts[i:e], place[i:e] = start, used + np.arange(1, e - i + 1)
            used += e - i
            i = e
        if start is not None:
            state.update((pd.Timestamp(start, unit="us"), used))
            if idle_seconds is not None:
                state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame({key: rows[key].values, id_col: rows[id_col].values, "admitted": place <= limit, "window_start": starts.astype("datetime64[us]")})

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(key).applyInPandasWithState(fn, out_schema, "start timestamp, used long", "append", timeout)
