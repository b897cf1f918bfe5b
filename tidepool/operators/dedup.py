"""Deduplication (DED-1..6; the streaming form DED-7 lives in ``tidepool.streaming``).

Design for skew: "first record wins" is an aggregate, not a window. The
winning row per key is ``min_by(row, order)``, which Spark combines map-side
(partial aggregation) before the shuffle, so a key holding a third of all rows
sends at most one row per input partition across the network instead of the
whole group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import text_hash


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def first_rows(df: DataFrame, keys: list[str], picks: dict) -> DataFrame:
    """Per key the first row of several choices, in one aggregate: the keys and a struct column for each of
    ``picks`` (name: row struct, order struct, condition or None); null where no row meets the condition.
    A row None stands for the order struct itself, which then travels once."""
    first = lambda row, order: F.min(order) if row is None else F.min_by(row, order)
    firsts = [first(row, order if when is None else F.when(when, order)).alias(name) for name, (row, order, when) in picks.items()]
    named = [F.col(f"`{k}`") for k in keys]
    return df.groupBy(*text_hash(df, keys), *named).agg(*firsts).select(*named, *picks)


def dedup_by_key(
    df: DataFrame,
    keys: list[str],
    order_by: list[str] | None = None,
    empty_key_passthrough: bool = False,
) -> DataFrame:
    """DED-1/DED-2: keep the first row per key (null keys equal each other).

    ``order_by`` defines "first" (Spark has no arrival order); it should end
    in a unique column so the winner is deterministic. With no keys the input
    passes through. ``empty_key_passthrough`` reproduces the source rule that
    a single empty-string key is never deduplicated.
    """
    if not keys:
        return df
    order_by = order_by or keys
    cols = df.columns
    body = df
    passthrough = None
    if empty_key_passthrough and len(keys) == 1:
        k = F.col(keys[0])
        passthrough = df.filter(k.isNotNull() & (k.cast("string") == F.lit("")))
        body = df.filter(k.isNull() | (k.cast("string") != F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    order = F.struct(*_cols(order_by))
    out = first_rows(body, keys, {"_first": (row, order, None)}).select("_first.*")
    return out if passthrough is None else out.unionByName(passthrough)


def dedup_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """DED-3: ``(records, unique_keys, duplicates)`` in one aggregation pass."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").cast("bigint").alias("records"),
        F.count(F.lit(1)).cast("bigint").alias("unique_keys"),
        (F.sum("_n") - F.count(F.lit(1))).cast("bigint").alias("duplicates"),
    )


def dedup_payload(df: DataFrame, payload_col: str | None = None) -> DataFrame:
    """DED-4: drop byte-equal payloads (whole row when ``payload_col`` is None). Exact."""
    return df.dropDuplicates([payload_col]) if payload_col else df.dropDuplicates()


def bloom_semi_filter(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """DED-5: keep rows of ``big`` whose key is in ``small`` (membership test), exactly.

    Expressed as a ``left_semi`` join on the distinct key set. Spark's
    runtime filter (``spark.sql.optimizer.runtime.bloomFilter.enabled``)
    builds a bloom filter from the small side -- sized by its row count, so
    bounded -- and probes it in the big side's scan stage before the
    shuffle; the join itself removes the filter's false positives.
    """
    return big.join(small.select(key).distinct(), key, "left_semi")


def unique_key_count(df: DataFrame, keys: list[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """DED-6: number of distinct keys seen (exact, or HyperLogLog++ with ``rsd``)."""
    k = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    if exact:
        return df.select(*keys).distinct().agg(F.count(F.lit(1)).cast("bigint").alias("unique_keys"))
    return df.agg(F.approx_count_distinct(k, rsd).cast("bigint").alias("unique_keys"))
