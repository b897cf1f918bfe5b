"""Table scans: full refresh, incremental by cursor, bounded ranges, pruned fields,
checkpoint computation (SRC-7..13).

Every cursor predicate is a plain Column filter, so for parquet / JDBC /
catalog tables Catalyst pushes it into the scan (``PushedFilters``) and, on
a partitioned table, prunes partitions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_full(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """SRC-7: full-refresh read of a table name or a path."""
    if fmt == "table":
        return spark.read.table(source)
    return spark.read.format(fmt).options(**options).load(source)


def _cursor_lit(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (_dt.datetime, _dt.date)):
        return F.lit(value)
    return F.lit(value)


def read_incremental(df: DataFrame, cursor: str, state=None, op: str = ">", order: bool = False) -> DataFrame:
    """SRC-8 / SRC-9: rows with cursor strictly after (``>``) or at-or-after (``>=``) the state.

    No state means a first (full) read. ``>=`` returns boundary rows again, so
    its sink must upsert. Sorting is only added when asked for.
    """
    out = df
    if state is not None:
        c = F.col(cursor)
        v = _cursor_lit(state)
        out = out.filter(c > v if op == ">" else c >= v)
    return out.orderBy(cursor) if order else out


def read_incremental_epoch(df: DataFrame, cursor: str, state_seconds: int | None = None) -> DataFrame:
    """SRC-10: cursor state held as epoch seconds, default 0; compared as a timestamp."""
    secs = 0 if state_seconds is None else int(state_seconds)
    return df.filter(F.col(cursor) > F.timestamp_seconds(F.lit(secs)).cast(df.schema[cursor].dataType))


def read_between(df: DataFrame, cursor: str, lo=None, hi=None, lookback_months: int = 6) -> DataFrame:
    """SRC-11: bounded range [lo, hi] at date grain; ``hi`` defaults to today,
    ``lo`` to ``hi`` minus ``lookback_months``."""
    hi_c = F.current_date() if hi is None else F.to_date(F.lit(hi))
    lo_c = F.add_months(hi_c, -lookback_months) if lo is None else F.to_date(F.lit(lo))
    d = F.to_date(F.col(cursor))
    return df.filter((F.col(cursor) >= lo_c.cast("timestamp")) & (d <= hi_c))


def read_fields(df: DataFrame, fields: list[str] | None, key: str | None = None) -> DataFrame:
    """SRC-12: project the declared fields that exist (ReadSchema pruning); fall back to the key."""
    present = [f for f in (fields or []) if f in df.columns]
    if not present:
        present = [key] if key else list(df.columns)
    return df.select(*present)


def next_state(df: DataFrame, cursor: str, previous=None) -> DataFrame:
    """SRC-13: new checkpoint = max cursor seen (the previous state when nothing new). One row."""
    agg = df.agg(F.max(cursor).alias("cursor_state"))
    if previous is None:
        return agg
    return agg.select(F.coalesce(F.col("cursor_state"), F.lit(previous).cast(df.schema[cursor].dataType)).alias("cursor_state"))


def drop_wrapper(df: DataFrame, *cols: str) -> DataFrame:
    """SRC-21: drop wrapper metadata columns (``attributes``)."""
    return df.drop(*cols)


def lift_struct(df: DataFrame, wrapper: str = "properties", keep: list[str] | None = None) -> DataFrame:
    """SRC-20: lift ``wrapper.*`` beside the kept columns; a lifted field wins on a name clash."""
    inner = df.schema[wrapper].dataType.fieldNames()
    kept = [c for c in (keep or ["id"]) if c not in inner]
    return df.select(*kept, f"{wrapper}.*")
