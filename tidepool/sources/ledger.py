"""Incremental file reads by a ledger of processed files (SRC-6).

A time as checkpoint loses files: one that lands between the listing and the
read, one with the checkpoint's own time, one that is copied in with an older time.
Here a file is new if its (path, modified, size) is not in the ledger. One listing, kept as
a table, serves the read and the commit: rows of files that are not in it are left
for the next run, and only listed files are committed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fs_list, materialize, write_once
from .files import file_glob

_FILE = ["path", "modified", "size"]


def _meta() -> list:
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size")]


class FileLedger:
    """Files of one folder and format, each read exactly once.

    ``home`` holds a folder of file rows per commit and a commit record that names it,
    created in one step; a run that stops before it has processed nothing.
    """

    def __init__(self, spark: SparkSession, home: str, path: str, fmt: str, by_extension: bool = True, recursive: bool = False):
        self.spark, self.home, self.path, self.fmt = spark, home.rstrip("/"), path, fmt
        self.options = {"pathGlobFilter": file_glob(fmt) if by_extension else "*", "recursiveFileLookup": str(recursive).lower()}

    def _commits(self) -> list[int]:
        return sorted(int(f[:-5]) for f, is_dir in fs_list(self.spark, f"{self.home}/commits") if not is_dir and f.endswith(".json") and not f.startswith("."))

    def processed(self) -> DataFrame:
        """(path, modified, size) of all committed files."""
        numbers = self._commits()
        if not numbers:
            return self.spark.createDataFrame([], "path string, modified timestamp, size long")
        rows = self.spark.read.schema("folder string").json([f"{self.home}/commits/{n}.json" for n in numbers])
        return self.spark.read.parquet(*[f"{self.home}/{r['folder']}" for r in rows.collect()])  # one a run

    def checkpoint(self) -> DataFrame:
        """The latest modification time processed, one row (null at first)."""
        return self.processed().agg(F.max("modified").alias("cursor_state"))

    def list_new(self) -> DataFrame:
        """Files that are there now and were not processed in this state: a file that was
        written anew since is new, one without a byte is not listed. No file is opened."""
        listed = self.spark.read.format("binaryFile").options(**self.options).load(self.path).select(*_meta())
        return materialize(listed.join(self.processed(), _FILE, "left_anti"), "new-files")

    def read(self, new: DataFrame, **options) -> DataFrame:
        """Rows of the files of ``new``, with ``_source_file`` and ``_source_modified``. Files older than all of
        them are not opened; others that are there are, but none of their rows pass."""
        least = new.agg(F.date_format(F.min("modified") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).first()["t"]
        reader = self.spark.read.format(self.fmt).options(**self.options).options(**options)
        df = (reader.option("modifiedAfter", least).option("timeZone", self.spark.conf.get("spark.sql.session.timeZone")) if least else reader).load(self.path)
        names = df.columns
        rows = df.select(*[F.col(f"`{c}`") for c in names], *[c.alias(f"_source_{n}") for c, n in zip(_meta(), ("file", "modified", "size"))])
        known = new.select(F.col("path").alias("_source_file"), F.col("modified").alias("_source_modified"), F.col("size").alias("_source_size"))
        return rows.join(known, known.columns, "left_semi").select(*[F.col(f"`{c}`") for c in names], "_source_file", "_source_modified")

    def commit(self, new: DataFrame) -> None:
        """Count the files of ``new`` as processed; call it when their rows are safe."""
        number, folder = max(self._commits(), default=0) + 1, f"files/{uuid.uuid4().hex}"
        new.select(*_FILE).write.parquet(f"{self.home}/{folder}")
        if not write_once(self.spark, f"{self.home}/commits/{number}.json", json.dumps({"folder": folder})):
            raise RuntimeError(f"another run committed files to {self.home}")
