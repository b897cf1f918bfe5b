"""Conflict detection and resolution between two copies of a table (CON-1..8).

Both copies are keyed by a primary key, so every join here is a one-to-one
equi-join on unique keys: no key can fan out, and a shuffle on the key
spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import KEY_HASH, text_hash


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; one column per key in the result. A hash of the
    text keys is compared first (:mod:`.keys`); a null leaves it as it is."""
    mark = text_hash(a, keys, b)
    if mark:
        j = _null_safe_join(a.withColumn(KEY_HASH, mark[0]), b.withColumn(KEY_HASH, mark[0]), [KEY_HASH, *keys], how)
        return j.drop(KEY_HASH)
    return _null_safe_join(a, b, keys, how)


def _null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = {k: f"_other_{k}" for k in keys}
    b = b.select(*[F.col(f"`{k}`").alias(other[k]) for k in keys], *[F.col(f"`{c}`") for c in b.columns if c not in keys])
    # the hash is never null
    cond = [a[k] == b[other[k]] if k == KEY_HASH else a[f"`{k}`"].eqNullSafe(b[f"`{other[k]}`"]) for k in keys]
    j = a.join(b, cond, how)
    if how in ("left_semi", "left_anti"):
        return j
    first = [F.coalesce(F.col(f"`{k}`"), F.col(f"`{other[k]}`")).alias(k) for k in keys]
    return j.select(*first, *[F.col(f"`{c}`") for c in j.columns if c not in keys and c not in other.values()])


STRATEGIES = ("source_wins", "dest_wins", "last_write_wins", "merge", "skip")


def _payload_cols(df: DataFrame, keys: list[str], ts: str) -> list[str]:
    return [c for c in df.columns if c not in keys and c != ts]


def find_conflicts(source: DataFrame, dest: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """CON-1: keys present on both sides with differing content.

    Output: keys, ``source`` and ``dest`` structs of the payload columns,
    ``source_ts``, ``dest_ts``. Comparison is null-safe (``<=>``).
    """
    cols = _payload_cols(source, keys, ts)
    s = source.select(*keys, F.struct(*cols).alias("source"), F.col(ts).alias("source_ts"))
    d = dest.select(*keys, F.struct(*cols).alias("dest"), F.col(ts).alias("dest_ts"))
    return null_safe_join(s, d, keys).filter(~F.col("source").eqNullSafe(F.col("dest")))


def _merge_struct(newer: Column, older: Column, cols: list[str]) -> Column:
    return F.struct(*[F.coalesce(newer.getField(c), older.getField(c)).alias(c) for c in cols])


def resolve(conflicts: DataFrame, strategy: str, cols: list[str]) -> DataFrame:
    """CON-2..6: resolved record per conflict.

    ``source_wins`` / ``dest_wins``: that side. ``last_write_wins``: the newer
    timestamp, a tie goes to the source. ``merge``: per column the newer
    side's value unless null, then the older one. ``skip``: conflicts are
    removed (the caller reports them). Output: keys, ``winner``,
    ``resolved`` struct.
    """
    src_newer = F.coalesce(F.col("source_ts") >= F.col("dest_ts"), F.col("dest_ts").isNull())
    if strategy == "source_wins":
        winner, rec = F.lit("SOURCE"), F.col("source")
    elif strategy == "dest_wins":
        winner, rec = F.lit("DEST"), F.col("dest")
    elif strategy == "last_write_wins":
        winner = F.when(src_newer, F.lit("SOURCE")).otherwise(F.lit("DEST"))
        rec = F.when(src_newer, F.col("source")).otherwise(F.col("dest"))
    elif strategy == "merge":
        winner = F.lit("MERGED")
        rec = F.when(src_newer, _merge_struct(F.col("source"), F.col("dest"), cols)).otherwise(
            _merge_struct(F.col("dest"), F.col("source"), cols))
    elif strategy == "skip":
        return conflicts.filter(F.lit(False)).select(*[c for c in conflicts.columns if c not in ("source", "dest", "source_ts", "dest_ts")],
                                                     F.lit(None).cast("string").alias("winner"), F.col("source").alias("resolved"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    keys = [c for c in conflicts.columns if c not in ("source", "dest", "source_ts", "dest_ts")]
    return conflicts.select(*keys, winner.alias("winner"), rec.alias("resolved"))


def sync_two_way(source: DataFrame, dest: DataFrame, keys: list[str], ts: str, strategy: str = "last_write_wins") -> DataFrame:
    """CON-7: one full outer join classifies every key.

    ``action``: ``to_dest`` (only in source), ``to_source`` (only in dest),
    ``none`` (equal), ``resolved`` (conflict resolved by ``strategy``),
    ``skipped`` (conflict under ``skip``). ``record`` is the row both sides
    should hold afterwards (null when skipped).
    """
    cols = _payload_cols(source, keys, ts)
    s = source.select(*keys, F.struct(*cols).alias("source"), F.col(ts).alias("source_ts"), F.lit(True).alias("_in_s"))
    d = dest.select(*keys, F.struct(*cols).alias("dest"), F.col(ts).alias("dest_ts"), F.lit(True).alias("_in_d"))
    j = null_safe_join(s, d, keys, "full_outer")
    in_s, in_d = F.col("_in_s").isNotNull(), F.col("_in_d").isNotNull()
    equal = F.col("source").eqNullSafe(F.col("dest"))
    src_newer = F.coalesce(F.col("source_ts") >= F.col("dest_ts"), F.col("dest_ts").isNull())
    if strategy == "source_wins":
        win_rec, win = F.col("source"), F.lit("SOURCE")
    elif strategy == "dest_wins":
        win_rec, win = F.col("dest"), F.lit("DEST")
    elif strategy == "merge":
        win_rec = F.when(src_newer, _merge_struct(F.col("source"), F.col("dest"), cols)).otherwise(
            _merge_struct(F.col("dest"), F.col("source"), cols))
        win = F.lit("MERGED")
    else:
        win_rec = F.when(src_newer, F.col("source")).otherwise(F.col("dest"))
        win = F.when(src_newer, F.lit("SOURCE")).otherwise(F.lit("DEST"))
    conflict_action = F.lit("skipped") if strategy == "skip" else F.lit("resolved")
    action = (F.when(in_s & ~in_d, F.lit("to_dest")).when(~in_s & in_d, F.lit("to_source"))
              .when(equal, F.lit("none")).otherwise(conflict_action))
    record = (F.when(in_s & ~in_d, F.col("source")).when(~in_s & in_d, F.col("dest")).when(equal, F.col("source"))
              .otherwise(F.lit(None) if strategy == "skip" else win_rec))
    winner = F.when(in_s & in_d & ~equal, F.lit(None) if strategy == "skip" else win)
    return j.select(*keys, action.alias("action"), winner.cast("string").alias("winner"), record.alias("record"))


def two_way_summary(result: DataFrame) -> DataFrame:
    """CON-7: counts of the two-way result: forward / reverse changes, conflicts found and resolved."""
    a = F.col("action")
    return result.agg(
        F.count_if(a == "to_dest").cast("bigint").alias("forward_changes"),
        F.count_if(a == "to_source").cast("bigint").alias("reverse_changes"),
        F.count_if(a.isin("resolved", "skipped")).cast("bigint").alias("conflicts_found"),
        F.count_if(a == "resolved").cast("bigint").alias("conflicts_resolved"),
    )


def matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """CON-8: rows of ``a`` with a partner in ``b``."""
    return null_safe_join(a, b.select(*keys), keys, "left_semi")


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """CON-8: rows of ``a`` without a partner in ``b``."""
    return null_safe_join(a, b.select(*keys), keys, "left_anti")
