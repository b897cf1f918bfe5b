"""Connector message logs: decode, route and count (SRC-25, SRC-26).

A message log is newline-delimited JSON: ``{"type": ..., "record": {...}}``
and so on, exactly one payload per message. Decoding is ``from_json`` with a
declared schema; lines that do not parse go to a reject output instead of
stopping the read (the source stops at the first bad line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Message types and the payload field each one carries.
MESSAGE_TYPES = {
    "RECORD": "record",
    "STATE": "state",
    "LOG": "log",
    "CONTROL": "control",
    "SCHEMA": "schema",
    "SPEC": "spec",
}

MESSAGE_DDL = (
    "type STRING, "
    "record STRUCT<stream: STRING, namespace: STRING, data: STRING, emitted_at: STRING>, "
    "state STRUCT<type: STRING, stream: STRING, data: STRING>, "
    "log STRUCT<level: STRING, message: STRING>, "
    "control STRUCT<type: STRING, data: STRING>, "
    "schema STRUCT<stream: STRING, schema: STRING>, "
    "spec STRUCT<data: STRING>, "
    "_corrupt_record STRING"
)


def decode_messages(df: DataFrame, text_col: str = "value", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-25: (decoded messages, rejected lines).

    Nested JSON values (``data``) stay JSON text; parse them per stream with
    a declared schema or ``parse_json``.
    """
    parsed = F.from_json(F.col(text_col), MESSAGE_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    cols = [F.col(c) for c in (keep or [])]
    m = df.select(*cols, F.col(text_col).alias("_line"), parsed.alias("_m"))
    bad = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull() | F.col("_m.type").isNull()
    good = m.filter(~bad).select(*(keep or []), "_m.*").drop("_corrupt_record")
    rejects = m.filter(bad).select(*(keep or []), F.col("_line").alias("line"))
    return good, rejects


def payload_present(t=None):
    """True when a message carries the payload its type names."""
    t = F.col("type") if t is None else t
    expr = F.when(F.lit(False), F.lit(False))
    for name, field in MESSAGE_TYPES.items():
        expr = expr.when(t == F.lit(name), F.col(field).isNotNull())
    return expr.otherwise(F.lit(False))


def route_messages(msgs: DataFrame) -> dict[str, DataFrame]:
    """SRC-26: one DataFrame per message type (payload present), plus ``errors``.

    All outputs share the same lazily read input; each is a filter.
    """
    ok = payload_present()
    out = {name: msgs.filter((F.col("type") == name) & ok) for name in MESSAGE_TYPES}
    out["errors"] = msgs.filter(~ok)
    return out


def message_stats(msgs: DataFrame) -> DataFrame:
    """SRC-26: counts per kind; a missing payload or an unknown type counts as an error."""
    kind = F.when(payload_present(), F.lower(F.col("type"))).otherwise(F.lit("error"))
    return msgs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).cast("bigint").alias("messages"))


def records_of(msgs: DataFrame) -> DataFrame:
    """Record messages as rows ``(stream, namespace, data, emitted_at)``."""
    return msgs.filter((F.col("type") == "RECORD") & F.col("record").isNotNull()).select("record.*")
