"""Data-quality reports and assertions (DQ-1..4), re-aimed from the connector test harness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.messages import payload_present


def source_report(msgs: DataFrame) -> DataFrame:
    """DQ-1: streams, records, states and errors of a decoded message log, in one aggregation."""
    t = F.col("type")
    ok = payload_present()
    return msgs.agg(
        F.count_distinct(F.when((t == "RECORD") & ok, F.col("record.stream"))).cast("bigint").alias("streams"),
        F.count_if((t == "RECORD") & ok).cast("bigint").alias("records"),
        F.count_if((t == "STATE") & ok).cast("bigint").alias("states"),
        F.count_if(~ok).cast("bigint").alias("errors"),
    )


class QualityError(AssertionError):
    pass


def assert_nonempty(df: DataFrame, what: str = "read") -> None:
    """DQ-2: fail when a catalog or a read is empty (``isEmpty`` stops at the first row)."""
    if df.isEmpty():
        raise QualityError(f"{what} is empty")


def assert_no_rejects(rejects: DataFrame, what: str = "write") -> None:
    """DQ-2: fail when a write produced dead letters / rejects."""
    if not rejects.isEmpty():
        raise QualityError(f"{what} produced rejected records")


def idempotency_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """DQ-3: rows only in the first or only in the second result (multiset difference both ways)."""
    a = first.exceptAll(second).agg(F.count(F.lit(1)).cast("bigint").alias("rows")).withColumn("side", F.lit("only_first"))
    b = second.exceptAll(first).agg(F.count(F.lit(1)).cast("bigint").alias("rows")).withColumn("side", F.lit("only_second"))
    return a.unionByName(b).select("side", "rows")


def assert_idempotent(run: Callable[[], DataFrame]) -> None:
    """DQ-3: the same sync run twice yields equal tables."""
    diff = idempotency_diff(run(), run())
    bad = diff.filter(F.col("rows") > 0)
    if not bad.isEmpty():
        raise QualityError("sync is not idempotent")


def undeclared_fields(observed: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-4: fields seen in records but absent from the declared schema (``left_anti`` on field tables)."""
    return observed.join(declared.select(*keys), keys, "left_anti")
