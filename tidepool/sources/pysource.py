"""Connector SDK on Spark's Python data source API (SRC-24, SNK-14).

A connector is a ``pyspark.sql.datasource.DataSource``: ``spec`` / ``check``
/ ``discover`` are plain methods, ``read`` is a ``DataSourceReader`` whose
``partitions()`` split the work into tasks and whose ``pushFilters`` takes
cursor predicates so they run inside the source. A destination is a
``DataSourceArrowWriter`` whose per-task commit messages are gathered by
the driver-side ``commit`` into one manifest (so a failed job leaves no
half-visible output).

The concrete pair here reads and writes a folder of parquet files with
pyarrow inside tasks -- one input partition per row group -- standing in for
any remote store a connector would page through.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

_ARROW_TO_DDL = {
    "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "double": "double", "float": "float",
    "string": "string", "large_string": "string", "bool": "boolean", "date32[day]": "date", "binary": "binary",
}


def arrow_type_ddl(t) -> str:
    import pyarrow as pa

    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz else "timestamp_ntz"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{arrow_type_ddl(t.value_type)}>"
    return _ARROW_TO_DDL.get(str(t), "string")


class SyncSource(DataSource):
    """Base of source connectors: ``spec`` (option names), ``check`` (can we
    read?), ``discover`` (streams and their schemas) and the Spark reader."""

    def spec(self) -> dict:
        return {"options": []}

    def check(self) -> tuple[bool, str]:
        return True, "ok"

    def discover(self) -> list[dict]:
        return []


class SyncSink(DataSource):
    """Base of destination connectors: ``spec``, ``check``, ``capabilities`` and the Spark writer."""

    def spec(self) -> dict:
        return {"options": []}

    def check(self) -> tuple[bool, str]:
        return True, "ok"

    def capabilities(self) -> list[str]:
        return ["append"]


def _parquet_files(path: str) -> list[str]:
    out = []
    for root, _, files in os.walk(path):
        for f in files:
            if f.endswith(".parquet") and not f.startswith((".", "_")):
                out.append(os.path.join(root, f))
    return sorted(out)


class ParquetFolderSource(SyncSource):
    """``spark.read.format("tidepool_parquet").option("path", p).load()``."""

    @classmethod
    def name(cls) -> str:
        return "tidepool_parquet"

    def spec(self) -> dict:
        return {"options": ["path"]}

    def check(self) -> tuple[bool, str]:
        p = self.options.get("path", "")
        return (os.path.isdir(p), "ok" if os.path.isdir(p) else f"no folder {p}")

    def discover(self) -> list[dict]:
        return [{"stream": os.path.basename(self.options["path"].rstrip("/")), "schema": self.schema()}]

    def schema(self) -> str:
        import pyarrow.parquet as pq

        files = _parquet_files(self.options["path"])
        if not files:
            raise ValueError(f"no parquet files under {self.options['path']}")
        s = pq.read_schema(files[0])
        return ", ".join(f"`{f.name}` {arrow_type_ddl(f.type)}" for f in s)

    def reader(self, schema):
        return ParquetFolderReader(self.options["path"], schema)


@dataclass
class RowGroupPartition(InputPartition):
    path: str
    row_group: int


_OPS = {GreaterThan: ">", GreaterThanOrEqual: ">=", EqualTo: "==", LessThan: "<", LessThanOrEqual: "<="}


class ParquetFolderReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path = path
        self.schema = schema
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Accept comparisons on top-level columns (cursor predicates); the rest stay in Spark."""
        for f in filters:
            op = _OPS.get(type(f))
            if op and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], op, f.value))
            else:
                yield f

    def partitions(self):
        import pyarrow.parquet as pq

        parts = []
        for f in _parquet_files(self.path):
            n = pq.ParquetFile(f).num_row_groups
            parts.extend(RowGroupPartition(f, i) for i in range(n))
        return parts

    def read(self, partition: RowGroupPartition):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        names = [f.name for f in self.schema.fields]
        table = pq.ParquetFile(partition.path).read_row_group(partition.row_group, columns=names)
        for col, op, val in self.filters:
            c = table[col]
            if hasattr(val, "tzinfo") and val.tzinfo is not None and getattr(c.type, "tz", None) is None:
                val = val.replace(tzinfo=None)
            mask = {">": pc.greater, ">=": pc.greater_equal, "==": pc.equal, "<": pc.less, "<=": pc.less_equal}[op](c, val)
            table = table.filter(mask)
        yield from table.to_batches()


class ParquetFolderSink(SyncSink):
    """``df.write.format("tidepool_parquet_sink").option("path", p).mode("append").save()``.

    Every task writes its own file into ``path/_data``; ``commit`` appends one
    manifest line listing the files and row counts of the job. Readers take
    the files named by the manifest, so the output of an aborted job is
    never visible.
    """

    @classmethod
    def name(cls) -> str:
        return "tidepool_parquet_sink"

    def capabilities(self) -> list[str]:
        return ["append"]

    def writer(self, schema, overwrite: bool):
        return ParquetFolderWriter(self.options["path"])


@dataclass
class FileCommit(WriterCommitMessage):
    file: str
    rows: int


class ParquetFolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.parquet as pq

        data = os.path.join(self.path, "_data")
        os.makedirs(data, exist_ok=True)
        target = os.path.join(data, f"part-{uuid.uuid4().hex}.parquet")
        writer, rows = None, 0
        for batch in iterator:
            if writer is None:
                writer = pq.ParquetWriter(target, batch.schema)
            writer.write_table(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if writer is None:
            return FileCommit("", 0)
        writer.close()
        return FileCommit(target, rows)

    def commit(self, messages):
        entry = {"files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}
        os.makedirs(self.path, exist_ok=True)
        with open(os.path.join(self.path, "_manifest.jsonl"), "a", encoding="utf-8") as fh:
            fh.write(json.dumps(entry) + "\n")

    def abort(self, messages):
        pass  # files of an aborted job are never listed in the manifest


def committed_files(path: str) -> list[str]:
    """Files of all committed jobs of a :class:`ParquetFolderSink` folder."""
    out = []
    with open(os.path.join(path, "_manifest.jsonl"), encoding="utf-8") as fh:
        for line in fh:
            out.extend(json.loads(line)["files"])
    return out


def register(spark) -> None:
    """Register the connector pair with a session (and let readers take pushed filters)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ParquetFolderSource)
    spark.dataSource.register(ParquetFolderSink)
