"""Write modes, dead letters, reconciliation and checkpoint state (SNK-2..12).

Upsert and merge are single aggregations over a tagged union of target and
changes -- one shuffle on the key, combined map-side -- rather than a join
followed by a window: a hot key shrinks to one row per map partition before
it crosses the network.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conflict import null_safe_join


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK-2: append rows; columns missing on either side become null."""
    return target.unionByName(rows, allowMissingColumns=True)


def append_to_table(rows: DataFrame, table: str) -> None:
    """SNK-2 for catalog tables: columns matched by name, target columns the rows
    lack are written as null, extra row columns are refused (as the warehouse would)."""
    spark = rows.sparkSession
    target = spark.table(table).schema
    extra = [c for c in rows.columns if c not in target.fieldNames()]
    if extra:
        raise ValueError(f"columns not in {table}: {extra}")
    aligned = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in target.fields])
    aligned.write.mode("append").insertInto(table)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """SNK-3: a change replaces the target row of its key, else it is inserted;
    repeated keys in ``changes`` resolve to the latest by ``order_by``.

    ``order_by`` columns must exist in ``changes``; target rows rank below
    every change. Columns missing on one side are null.
    """
    ord_t = [F.lit(None).cast(changes.schema[c].dataType).alias(f"_o_{c}") for c in order_by]
    t = target.select("*", F.lit(0).alias("_tag"), *ord_t)
    ch = changes.select("*", F.lit(1).alias("_tag"), *[F.col(c).alias(f"_o_{c}") for c in order_by])
    u = t.unionByName(ch, allowMissingColumns=True)
    allc = [c for c in u.columns if c != "_tag" and not c.startswith("_o_")]
    row = F.struct(*[F.col(f"`{c}`") for c in allc])
    rank = F.struct(F.col("_tag"), *[F.col(f"_o_{c}") for c in order_by])
    return u.groupBy(*keys).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


def merge(target: DataFrame, changes: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """SNK-4: non-null change values overwrite, other columns keep the target value.

    Per column the latest non-null value wins (``max_by`` whose ordering is
    null for null values, so those rows are skipped); keys only in the
    changes are inserted.
    """
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *cols, F.lit(0).alias("_tag"), *[F.lit(None).cast(changes.schema[c].dataType).alias(f"_o_{c}") for c in order_by])
    ch = changes.select(*keys, *[F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in cols],
                        F.lit(1).alias("_tag"), *[F.col(c).alias(f"_o_{c}") for c in order_by])
    u = t.unionByName(ch)
    rank = F.struct(F.col("_tag"), *[F.col(f"_o_{c}") for c in order_by])
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols]
    return u.groupBy(*keys).agg(*aggs)


def soft_delete(target: DataFrame, snapshot: DataFrame, keys: list[str], deleted_at, snapshot_is_full: bool = True,
                flag: str = "_deleted", at_col: str = "_deleted_at") -> DataFrame:
    """SNK-5: target rows whose key is missing from a full source snapshot are flagged with a time.

    Refused on an incremental read (a partial snapshot would delete what it
    did not read).
    """
    if not snapshot_is_full:
        raise ValueError("soft delete needs a full snapshot, not an incremental read")
    present = snapshot.select(*keys).distinct().withColumn("_present", F.lit(True))
    j = null_safe_join(target, present, keys, "left")
    gone = F.col("_present").isNull()
    return j.withColumn(flag, gone).withColumn(at_col, F.when(gone, F.lit(deleted_at).cast("timestamp"))).drop("_present")


def route_writes(df: DataFrame, id_col: str, stream_col: str | None = None, writable: list[str] | None = None) -> dict[str, DataFrame]:
    """SNK-6: ``create`` (no id), ``update`` (id present; id split from ``properties``),
    and ``rejected`` (stream without a write path; a null stream has none)."""
    ok = F.lit(True) if (stream_col is None or writable is None) else F.coalesce(F.col(stream_col).isin(writable), F.lit(False))
    props = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (id_col, stream_col)]).alias("properties")
    keep = [stream_col] if stream_col else []
    return {
        "create": df.filter(ok & F.col(id_col).isNull()).select(*keep, props),
        "update": df.filter(ok & F.col(id_col).isNotNull()).select(*keep, F.col(id_col).alias("id"), props),
        "rejected": df.filter(~ok).withColumn("error", F.concat(F.lit("no write path for stream "), F.coalesce(F.col(stream_col).cast("string"), F.lit("null"))))
        if stream_col and writable is not None else df.filter(F.lit(False)).withColumn("error", F.lit(None).cast("string")),
    }


def split_rejects(df: DataFrame, rules: dict[str, Column], batch_col: str | None = None, batch_failed: Column | None = None,
                  attempts: int = 4, failed_at=None) -> tuple[DataFrame, DataFrame]:
    """SNK-8: (good rows, dead letters).

    ``rules`` maps an error text to a Column that is true when a row is bad.
    With ``batch_col`` and ``batch_failed``, every row of a batch where any
    row fails the batch-level check is dead-lettered with ``BATCH_FAILED``
    (found through a distinct set of failed batch ids, not a window).
    Dead letters carry ``errors``, ``attempts`` and ``failed_at``.
    """
    errs = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for msg, cond in rules.items()])) if rules \
        else F.array().cast("array<string>")
    out = df.withColumn("_errors", errs)
    if batch_col and batch_failed is not None:
        # failed batch ids: a distinct (map-side combined) set joined back on the batch id
        failed = df.filter(batch_failed).select(batch_col).distinct().withColumn("_bf", F.lit(True))
        out = out.join(failed, batch_col, "left")
        out = out.withColumn("_errors", F.when(F.col("_bf").isNotNull(), F.array_union(F.col("_errors"), F.array(F.lit("BATCH_FAILED"))))
                             .otherwise(F.col("_errors"))).drop("_bf")
    bad = F.size("_errors") > 0
    good = out.filter(~bad).drop("_errors")
    ts = F.current_timestamp() if failed_at is None else F.lit(failed_at).cast("timestamp")
    dead = out.filter(bad).withColumnRenamed("_errors", "errors").withColumn("attempts", F.lit(attempts)).withColumn("failed_at", ts)
    return good, dead


def reconcile(expected: DataFrame, actual: DataFrame, stream_col: str, errors: DataFrame | None = None) -> DataFrame:
    """SNK-9: per stream, confirmed only if counts are equal and no errors; discrepancy text otherwise."""
    e = expected.groupBy(stream_col).agg(F.count(F.lit(1)).cast("bigint").alias("expected"))
    a = actual.groupBy(stream_col).agg(F.count(F.lit(1)).cast("bigint").alias("actual"))
    j = null_safe_join(e, a, [stream_col], "full_outer").fillna(0, ["expected", "actual"])
    if errors is not None:
        er = errors.groupBy(stream_col).agg(F.count(F.lit(1)).cast("bigint").alias("errors"))
        j = null_safe_join(j, er, [stream_col], "left").fillna(0, ["errors"])
    else:
        j = j.withColumn("errors", F.lit(0).cast("bigint"))
    mismatch = F.col("expected") != F.col("actual")
    # fixed value: the discrepancy text
    msg = F.when(mismatch, F.format_string("record count mismatch: expected %d, got %d (delta: %d)",
                                           F.col("expected"), F.col("actual"), F.col("expected") - F.col("actual")))
    return j.select(stream_col, "expected", "actual", "errors", (~mismatch & (F.col("errors") == 0)).alias("confirmed"),
                    msg.alias("discrepancy"))


def write_totals(batch_results: DataFrame, written_col: str = "records_written", error_col: str = "error") -> DataFrame:
    """SNK-10: records written summed over batches and the number of errors.

    The error texts stay rows (``batch_results.filter(error is not null)``);
    they are not gathered into one value.
    """
    return batch_results.agg(F.sum(written_col).cast("bigint").alias("records_written"),
                             F.count(F.col(error_col)).cast("bigint").alias("errors"))


GLOBAL_STREAM = "__global"


def merge_states(states: DataFrame, stream_col: str, data_col: str, seq_col: str) -> DataFrame:
    """SNK-12: later state wins per stream; a state without a stream is the global one."""
    s = states.withColumn("_stream", F.coalesce(F.nullif(F.col(stream_col), F.lit("")), F.lit(GLOBAL_STREAM)))
    return s.groupBy(F.col("_stream").alias(stream_col)).agg(F.max_by(F.col(data_col), F.col(seq_col)).alias(data_col),
                                                             F.max(seq_col).alias(seq_col))


def save_state(current: DataFrame, new: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """SNK-11: checkpoint upsert per (sync, stream). Data must be committed before
    this runs (see :mod:`tidepool.streaming` for the streaming order)."""
    return upsert(current, new, keys, order_by)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
