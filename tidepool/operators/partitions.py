"""Range plans, partition assignment, global ranks and batches
(SRC-14..18, SNK-7, WIN-3 support).

Plans are DataFrames built with ``spark.range`` so their size may grow with
the data without passing through the driver; rows are assigned to slices by
arithmetic on the key, never by a range join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_BATCH_SIZE = 1000  # records per batch of the source system
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _num_partitions(total: int, size: int) -> int:
    size = size if size > 0 else 1
    n = total // size + (1 if total % size else 0)
    return max(n, 1)


# ------------------------------------------------------------------- time

def time_partitions(spark: SparkSession, start: _dt.datetime, end: _dt.datetime, total: int, size: int) -> DataFrame:
    """SRC-14: ``n = ceil(total/size)`` equal slices of [start, end); the last absorbs the rest.

    Columns: ``partition_id, lo, hi`` (timestamps, ``hi`` exclusive).
    """
    n = _num_partitions(total, size)
    us = int((end - start).total_seconds() * 1_000_000)
    step = us // n if us // n > 0 else 1_000_000
    start_us = F.unix_micros(F.lit(start).cast("timestamp"))
    end_c = F.lit(end).cast("timestamp")
    lo = F.timestamp_micros(start_us + F.col("id") * F.lit(step))
    hi = F.when(F.col("id") == n - 1, end_c).otherwise(F.least(F.timestamp_micros(start_us + (F.col("id") + 1) * F.lit(step)), end_c))
    return spark.range(n).select(F.col("id").cast("int").alias("partition_id"), lo.alias("lo"), hi.alias("hi")).filter(F.col("lo") < F.col("hi")) if n > 1 else \
        spark.range(1).select(F.lit(0).alias("partition_id"), F.lit(start).cast("timestamp").alias("lo"), end_c.alias("hi"))


def assign_time_partition(df: DataFrame, ts_col: str, start: _dt.datetime, end: _dt.datetime, total: int, size: int, name: str = "partition_id") -> DataFrame:
    """SRC-14: slice id of each row (null outside [start, end)), by arithmetic."""
    n = _num_partitions(total, size)
    us = int((end - start).total_seconds() * 1_000_000)
    step = us // n if us // n > 0 else 1_000_000
    last = max((us - 1) // step, 0) if us > 0 else 0
    last = min(last, n - 1)
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    s0 = F.unix_micros(F.lit(start).cast("timestamp"))
    e0 = F.unix_micros(F.lit(end).cast("timestamp"))
    idx = F.least(F.floor((t - s0) / F.lit(step)).cast("int"), F.lit(last))
    return df.withColumn(name, F.when((t >= s0) & (t < e0), idx))


# --------------------------------------------------------------------- id

def id_partitions(spark: SparkSession, min_id: int, max_id: int, total: int, size: int) -> DataFrame:
    """SRC-15: slices of the inclusive id range; stops when ids run out."""
    n = _num_partitions(total, size)
    rng = max_id - min_id + 1
    per = max(rng // n, 1)
    count = min(n, -(-rng // per))
    lo = F.lit(min_id) + F.col("id") * F.lit(per)
    hi = F.when(F.col("id") == count - 1, F.lit(max_id)).otherwise(F.least(lo + F.lit(per - 1), F.lit(max_id)))
    return spark.range(count).select(F.col("id").cast("int").alias("partition_id"), lo.alias("lo"), hi.alias("hi"))


def assign_id_partition(df: DataFrame, id_col: str, min_id: int, max_id: int, total: int, size: int, name: str = "partition_id") -> DataFrame:
    """SRC-15: slice id of each row (null outside [min, max])."""
    n = _num_partitions(total, size)
    rng = max_id - min_id + 1
    per = max(rng // n, 1)
    count = min(n, -(-rng // per))
    c = F.col(id_col)
    idx = F.least(F.floor((c - F.lit(min_id)) / F.lit(per)).cast("int"), F.lit(count - 1))
    return df.withColumn(name, F.when((c >= min_id) & (c <= max_id), idx))


# ----------------------------------------------------------------- offset

def offset_partitions(spark: SparkSession, total: int, size: int) -> DataFrame:
    """SRC-16: offset slices whose sizes differ by at most one (remainder to the first)."""
    n = _num_partitions(total, size)
    q, rem = divmod(total, n)
    i = F.col("id")
    sz = F.when(i < rem, F.lit(q + 1)).otherwise(F.lit(q))
    off = F.when(i < rem, i * (q + 1)).otherwise(F.lit(rem * (q + 1)) + (i - rem) * q)
    return spark.range(n).select(i.cast("int").alias("partition_id"), off.alias("start"), (off + sz - 1).alias("end"))


def offset_partition_of(rank0: Column, total: int, size: int) -> Column:
    """Slice of a 0-based global offset under :func:`offset_partitions`."""
    n = _num_partitions(total, size)
    q, rem = divmod(total, n)
    head = rem * (q + 1)
    return F.when(rank0 < head, F.floor(rank0 / (q + 1))).otherwise(
        F.lit(rem) + F.floor((rank0 - head) / max(q, 1))).cast("int")


def plan_partitions(spark: SparkSession, total: int, cap: int, batch: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """SRC-17: ``total/batch`` clamped to 1..cap partitions (cap: how many extracts may
    run at once, the caller's choice); the last takes the remainder."""
    n = min(max(total // batch, 1), cap)
    per = total // n
    i = F.col("id")
    off = i * per
    lim = F.when(i == n - 1, F.lit(total) - off).otherwise(F.lit(per))
    return spark.range(n).select(i.cast("int").alias("partition_id"), off.alias("offset"), lim.alias("limit"))


def extract_parallel(df: DataFrame, id_col: str, min_id: int, max_id: int, total: int, size: int,
                     name: str = "partition_id") -> DataFrame:
    """SRC-18: partitioned extract as one plan over disjoint id slices.

    Each row gets the slice id of :func:`id_partitions` by arithmetic; rows
    outside [min, max] are dropped by a plain filter that reaches the scan. The
    union of the parts is this one scan, so no row is read twice (the source
    system re-reads everything per part), and nothing is shuffled: Spark's own
    splits read the slices in parallel.
    """
    inside = df.where((F.col(id_col) >= min_id) & (F.col(id_col) <= max_id))
    return assign_id_partition(inside, id_col, min_id, max_id, total, size, name)


# ------------------------------------------------------------ global rank

def global_rank(df: DataFrame, order_by: list, name: str = "_rank", num_partitions: int | None = None,
                cut_lineage: bool = True) -> DataFrame:
    """1-based rank of every row in a total order, without a partition-less window.

    Range-partition on the order (skew-safe when ``order_by`` ends in a unique
    column, since a hot value then splits across ranges), sort within
    partitions, take each row's in-partition index from
    ``monotonically_increasing_id``, count rows per partition (one small row
    per partition), turn counts into offsets and add. The offsets table has
    one row per partition, so broadcasting it is bounded by the partition
    count, not the data.

    The counts and the row ids must describe the same cut of the data. Range
    bounds are sampled from the input, and the row order of a shuffled input
    varies between runs, so two instances of the range exchange (column
    pruning makes the count branch its own instance) or a recomputation after
    a lost executor may cut differently. ``cut_lineage=True`` (the default)
    therefore materialises the id'd rows once as a parquet table under
    ``spark.checkpoint.dir`` (``session.materialize``); both branches and
    every retry read those files. ``cut_lineage=False`` skips the write and is
    only safe when the input's row order is fixed (a plain file scan).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ided = ranged.withColumn("_mid", F.monotonically_increasing_id())
    ided = ided.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    if cut_lineage:
        from ..session import materialize

        ided = materialize(ided, "rank")
    counts = ided.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return ided.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_off") + F.col("_loc") + 1).cast("bigint")).drop("_mid", "_pid", "_loc", "_off")


def rank_in_group(df: DataFrame, group_by: list[str], order_by: list, name: str = "_rank") -> DataFrame:
    """1-based rank of each row inside its group, for groups that are small by
    nature (the fields of one stream with one name or type). ``order_by``
    should end in a column unique within the group. For groups that can be
    hot use :func:`global_rank`, which spreads any group over many tasks."""
    w = Window.partitionBy(*group_by).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def assign_batches(df: DataFrame, order_by: list, n: int = DEFAULT_BATCH_SIZE, name: str = "batch_id") -> DataFrame:
    """SNK-7: contiguous batches of at most ``n`` rows in ``order_by`` order."""
    r = global_rank(df, order_by, "_r")
    return r.withColumn(name, F.floor((F.col("_r") - 1) / F.lit(n)).cast("bigint")).drop("_r")


def batch_sizes(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """SNK-7: rows per batch."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).cast("bigint").alias("batch_rows"))
