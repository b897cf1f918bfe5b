"""End-to-end sync job (SNK-15): extract -> map -> coerce -> dedup -> write -> confirm -> record.

``run_sync`` plans the first half lazily. ``execute_sync`` runs a whole sync
against a home folder on any file system Spark reaches: it reads from the last
committed checkpoint, writes by the stream's destination mode, compares counts,
and makes table, checkpoint and run row visible by one commit record.
Step order is configurable: ``map_first`` (the workflow order: map, coerce, key
dedup) or ``dedup_first`` (the transform worker order: whole-payload dedup,
then map).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce_lenient
from ..model import SyncConfig
from ..operators.dedup import dedup_by_key, dedup_payload
from ..operators.conflict import null_safe_join
from ..operators.mapping import map_lenient, map_strict
from ..operators.writes import merge, reconcile, upsert
from ..session import discard, fs_delete, fs_list, materialize, write_once
from ..sources.tables import next_state, read_incremental


@dataclass
class SyncResult:
    records: DataFrame  # transformed rows ready to write
    errors: DataFrame | None  # lenient coercion errors


def transform(df: DataFrame, cfg: SyncConfig, on_error: str = "raise") -> SyncResult:
    s = cfg.stream
    out = df
    if cfg.order == "dedup_first":
        out = dedup_payload(out)
    if cfg.mapping_mode == "lenient":
        out = map_lenient(out, s.mappings)
    else:
        keep = []
        out = map_strict(out, s.mappings, keep=keep, on_error=on_error)
    errors = None
    coerce_spec = {m.dest_field: m.coerce_type for m in s.mappings if m.coerce_type}
    if coerce_spec:
        out = coerce_lenient(out, coerce_spec)
        errors = out.select(F.explode("_coerce_errors").alias("error"))
        out = out.drop("_coerce_errors")
    if cfg.order != "dedup_first" and s.primary_key:
        out = dedup_by_key(out, s.primary_key, cfg.dedup_order_by or s.primary_key)
    return SyncResult(out, errors)


def run_sync(df: DataFrame, cfg: SyncConfig, on_error: str = "raise") -> SyncResult:
    """Plan a whole sync over ``df``: incremental cursor read, then :func:`transform`."""
    s = cfg.stream
    src = df
    if s.sync_mode == "incremental" and s.cursor_field:
        src = read_incremental(src, s.cursor_field, cfg.cursor_value, cfg.cursor_op)
    return transform(src, cfg, on_error)


RUN_DDL = ("sync_id string, run int, status string, records_extracted bigint, records_transformed bigint, records_loaded bigint, "
           "errors bigint, discrepancy string, checkpoint string")
#: A run's commit record: its row, and the folders that became part of the sync with it.
COMMIT_DDL = f"{RUN_DDL}, mode string, data string, state string"

#: What :func:`execute_sync` has done when it reports a step.
STEPS = ("extracted", "transformed", "written", "counted", "state", "committed")


class RunTaken(RuntimeError):
    """Another attempt committed the run first; what this one wrote is not visible."""


def read_commits(spark: SparkSession, home: str) -> DataFrame:
    """The commit records of a sync, one per run."""
    names = [f for f, is_dir in fs_list(spark, f"{home.rstrip('/')}/commits") if not is_dir and f.endswith(".json") and not f.startswith(".")]
    return spark.read.schema(COMMIT_DDL).json([f"{home.rstrip('/')}/commits/{f}" for f in sorted(names)]) if names else spark.createDataFrame([], COMMIT_DDL)


def _last_run(spark: SparkSession, home: str) -> int:
    return max([0, *[int(f[:-len(".json")]) for f, is_dir in fs_list(spark, f"{home}/commits") if not is_dir and f.endswith(".json") and not f.startswith(".")]])


def _newest(commits: DataFrame, field: str) -> str | None:
    """``field`` of the newest commit that has one."""
    row = commits.where(F.col(field).isNotNull()).orderBy(F.desc("run")).select(field).first()
    return row and row[field]


def _table(spark: SparkSession, home: str, commits: DataFrame, run: int | None = None) -> DataFrame | None:
    seen = commits.where(F.col("data").isNotNull())
    seen = seen if run is None else seen.where(F.col("run") <= run)
    last = seen.orderBy(F.desc("run")).select("mode", "data").first()
    if last is None:
        return None
    if last["mode"] != "append":
        return spark.read.parquet(f"{home}/{last['data']}")
    paths = [f"{home}/{r['data']}" for r in seen.where("mode = 'append'").orderBy("run").select("data").collect()]  # one a run
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_table(spark: SparkSession, home: str, run: int | None = None) -> DataFrame | None:
    """The destination table of a sync as of its last commit (or of run ``run``): all
    appended batches, or the newest version. None before the first. What
    attempts without a commit left behind is never read."""
    home = home.rstrip("/")
    return _table(spark, home, read_commits(spark, home), run)


def read_runs(spark: SparkSession, home: str) -> DataFrame:
    """A row per run, failed ones included."""
    return read_commits(spark, home).drop("mode", "data", "state")


def clean_sync(spark: SparkSession, home: str, keep_versions: int = 1) -> int:
    """Delete what attempts without a commit left behind, and all but the newest
    ``keep_versions`` versions of a table that is written anew by every run (0: none of them
    are deleted). Not while a sync is running. How many folders went."""
    home = home.rstrip("/")
    commits = [r for r in read_commits(spark, home).where("data is not null").orderBy("run").select("mode", "data", "state").collect()]
    wanted = {r["data"].split("/")[1] for r in commits if r["mode"] == "append"}
    versions = [r["data"].split("/")[1] for r in commits if r["mode"] != "append"]
    wanted |= set(versions[-keep_versions:] if keep_versions else versions)
    states = [r["state"].split("/")[1] for r in commits if r["state"]]
    wanted |= set(states[-1:])
    gone = [f for f, is_dir in fs_list(spark, f"{home}/attempts") if is_dir and f not in wanted]
    for f in gone:
        fs_delete(spark, f"{home}/attempts/{f}")
    return len(gone)


def _load(records: DataFrame, current: DataFrame | None, cfg: SyncConfig, path: str, deleted_at) -> None:
    """Write the table that one run makes of ``current`` (None before the first) and its records."""
    keys, mode = cfg.stream.primary_key, cfg.stream.destination_mode
    if mode == "append":
        out = records
    else:
        before = records.limit(0) if current is None else current
        if mode == "upsert":
            out = upsert(before, records, keys, keys)  # one row per key after dedup
        elif mode == "merge":
            out = merge(before, records, keys, keys)
        else:
            live = records.withColumns({"_deleted": F.lit(False), "_deleted_at": F.lit(None).cast("timestamp")})
            if current is not None:
                at = F.coalesce("_deleted_at", F.lit(deleted_at).cast("timestamp")) if deleted_at is not None else F.coalesce("_deleted_at", F.current_timestamp())
                gone = null_safe_join(current, records.select(*keys), keys, "left_anti")
                live = live.unionByName(gone.withColumns({"_deleted": F.lit(True), "_deleted_at": at}), allowMissingColumns=True)
            out = live
    out.write.mode("errorifexists").parquet(path)


def _check(cfg: SyncConfig) -> None:
    s = cfg.stream
    if s.destination_mode not in ("append", "upsert", "merge", "soft_delete"):
        raise ValueError(f"unknown destination mode {s.destination_mode!r}")
    if s.destination_mode != "append" and not s.primary_key:
        raise ValueError(f"destination mode {s.destination_mode} needs a primary key")
    if s.destination_mode == "soft_delete" and s.sync_mode == "incremental":
        raise ValueError("soft delete needs a full snapshot, not an incremental read")


def execute_sync(source: DataFrame, cfg: SyncConfig, home: str, on_error: str = "raise", deleted_at=None, on_step: Callable[[str, str], None] | None = None) -> DataFrame:
    """SNK-15: run one sync of ``source`` into ``home``; the run's row.

    Everything an attempt writes goes to a folder of its own, ``attempts/<run>-<id>``:
    the table (``data``: a batch of appended rows, or the whole new version) and
    the checkpoint (``state``). The run becomes visible in one step, the
    creation of ``commits/<run>.json``, which holds the run's row and names both
    folders; it is created only if no other attempt did so first (``RunTaken``).
    The next run and all readers follow commits alone, so an attempt that stops
    anywhere before that step has changed nothing: the next call reads from
    the same checkpoint and loads the same rows.

    The rows read are fixed by the newest committed checkpoint; they are
    transformed once into a written table, from which they are loaded and
    counted. If the table does not hold all of them the run is committed as
    ``failed``, without table and checkpoint, so that the next one reads them again; with
    coercion errors it is ``partial``. ``on_step(step, folder)`` is called after each of ``STEPS``.
    """
    _check(cfg)
    spark, s, home = source.sparkSession, cfg.stream, home.rstrip("/")
    told = on_step or (lambda step, folder: None)
    run = _last_run(spark, home) + 1
    commits = read_commits(spark, home)
    attempt = f"attempts/{run}-{uuid.uuid4().hex}"
    incremental = bool(s.sync_mode == "incremental" and s.cursor_field)
    cursor = cfg.cursor_value
    if incremental and (state := _newest(commits, "state")):
        cursor = spark.read.parquet(f"{home}/{state}").first()["cursor_state"]
    extracted = read_incremental(source, s.cursor_field, cursor, cfg.cursor_op) if incremental else source
    extracted = materialize(extracted, "sync-extracted")
    told("extracted", f"{home}/{attempt}")
    result = transform(extracted, cfg, on_error)
    records = materialize(result.records, "sync-records")
    n_extracted, n_records = extracted.count(), records.count()
    errors = 0 if result.errors is None else result.errors.count()
    told("transformed", f"{home}/{attempt}")
    append = s.destination_mode == "append"
    path = f"{home}/{attempt}/data"
    _load(records, None if append else _table(spark, home, commits), cfg, path, deleted_at)
    told("written", f"{home}/{attempt}")
    written = spark.read.schema(records.schema).parquet(path) if append else spark.read.parquet(path)
    loaded = (written if append else null_safe_join(written, records.select(*s.primary_key), s.primary_key, "left_semi")).count()
    tally = [F.lit(s.name).alias("stream")]
    check = reconcile(records.select(*tally), spark.range(loaded).select(*tally), "stream").first()
    discrepancy = None if check is None else check["discrepancy"]
    confirmed = discrepancy is None
    told("counted", f"{home}/{attempt}")
    checkpoint = None
    if confirmed and incremental:
        next_state(extracted, s.cursor_field, cursor).write.mode("errorifexists").parquet(f"{home}/{attempt}/state")
        reached = spark.read.parquet(f"{home}/{attempt}/state").first()["cursor_state"]
        checkpoint = None if reached is None else str(reached)
    told("state", f"{home}/{attempt}")
    status = "failed" if not confirmed else "partial" if errors else "completed"
    row = (cfg.sync_id, run, status, n_extracted, n_records, loaded, errors, discrepancy, checkpoint)
    record = dict(zip([c.split()[0] for c in RUN_DDL.split(", ")], row), mode=s.destination_mode,
                  data=f"{attempt}/data" if confirmed else None, state=f"{attempt}/state" if checkpoint is not None else None)
    if not write_once(spark, f"{home}/commits/{run}.json", json.dumps(record)):
        raise RunTaken(f"run {run} of {home} was committed by another attempt")
    told("committed", f"{home}/{attempt}")
    discard(extracted, records)
    return spark.createDataFrame([row], RUN_DDL)
