"""File sources and sinks: JSON / CSV / parquet scans, lineage columns, stream
prefixes, incremental file reads, file writes and tenant layout
(SRC-1..6, SNK-1, SNK-13, SCH-2).

All reads are Spark file sources (split across tasks, pruned by
``pathGlobFilter`` / ``modifiedAfter`` before any file is opened); nothing
is listed or read on the driver beyond the schema probe of a CSV header.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .json_arrays import array_elements

# File extensions per stream format.
FORMAT_EXTENSIONS = {
    "json": ("json", "jsonl", "ndjson"),
    "csv": ("csv", "tsv"),
    "parquet": ("parquet",),
}

def file_glob(fmt: str) -> str:
    """File name pattern of a format."""
    exts = FORMAT_EXTENSIONS[fmt]
    return "*." + (exts[0] if len(exts) == 1 else "{" + ",".join(exts) + "}")


def _typed(values: DataFrame, fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """Columns of a variant column ``_v`` that holds objects; a value that is not
    of its column's type is null there, the record stays."""
    cols = [F.try_variant_get("_v", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields]
    return values.where(F.schema_of_variant("_v").startswith("OBJECT")).select(*cols, *keep)


def _elements(values: DataFrame, keep: list[str]) -> DataFrame:
    """Objects of ``_v``: itself, or the elements of an array."""
    is_array = F.schema_of_variant("_v").startswith("ARRAY")
    items = F.when(is_array, F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    return values.select(*keep, F.explode(items).alias("_v"))


def read_json(spark: SparkSession, path: str, layout: str = "lines", schema: T.StructType | str | None = None,
              recursive: bool = False, by_extension: bool = True) -> DataFrame:
    """SRC-1: records of JSON files.

    ``layout="lines"``: one object per line (or an array of objects);
    ``"array"``: one top-level array per file, cut into elements by many tasks
    (see :mod:`.json_arrays`); ``"auto"``: each file by its
    first character that is not white space. Lines that are no JSON are passed
    over, as is an array file that is not; every object is kept, whatever the
    types of its values (see :func:`_typed`). Without a ``schema`` Spark
    infers one from all records (an array file is one value then).
    """
    options = {"pathGlobFilter": file_glob("json") if by_extension else "*", "recursiveFileLookup": str(recursive).lower()}
    if schema is None:
        return spark.read.options(**options).option("mode", "DROPMALFORMED").option("multiLine", str(layout == "array").lower()).json(path)
    fields = (spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema).fields

    def parse(texts: DataFrame) -> DataFrame:
        # as the only element of an array, so that anything behind the value makes it invalid
        one = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<variant>")
        return texts.withColumn("_one", one).where(F.size("_one") == 1).withColumn("_v", F.col("_one")[0]).drop("_one")

    lineage = ["_source_file", "_source_modified"]
    text = lambda **more: spark.read.options(**options, **more).text(path)
    if layout == "lines":
        return _typed(_elements(parse(with_lineage(text())), lineage), fields, lineage)
    if layout == "array":
        return _typed(array_elements(text), fields, lineage)
    # each file's first fragment up to a comma shows what it is, however long its lines are
    marks = with_lineage(text(lineSep=",")).where(F.col("value").rlike(r"\S")).select(*lineage, F.col("_metadata.file_block_start").alias("_start"), F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1).alias("c"), F.monotonically_increasing_id().alias("_at"))
    kinds = materialize(marks.groupBy("_source_file").agg(F.min_by("c", F.struct("_start", "_at")).alias("c")), "json-kinds")
    arrays = kinds.where("c = '['").select("_source_file")
    if arrays.isEmpty():
        return _typed(_elements(parse(with_lineage(text())), lineage), fields, lineage)
    found = _typed(array_elements(text, only=arrays), fields, lineage)
    # files with lines are named to the reader (the driver lists all files anyway), so that no line of another is read
    others = [r[0] for r in kinds.where("c <> '['").select("_source_file").toLocalIterator()]
    return found.unionByName(_typed(_elements(parse(with_lineage(spark.read.text(others))), lineage), fields, lineage)) if others else found


def _csv(spark: SparkSession, delimiter: str, by_extension: bool, multi_line: bool):
    r = spark.read.option("delimiter", delimiter).option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower())
    return r.option("inferSchema", "false").option("mode", "PERMISSIVE").option("pathGlobFilter", file_glob("csv") if by_extension else "*")


def csv_header(spark: SparkSession, path: str, delimiter: str = ",", by_extension: bool = True) -> list[str]:
    """SCH-2: header names of a CSV stream (first record), trimmed; every column is text."""
    cols = _csv(spark, delimiter, by_extension, False).option("header", "true").csv(path).columns
    return [c.strip() for c in cols]


def csv_schema(spark: SparkSession, path: str, delimiter: str = ",", by_extension: bool = True) -> T.StructType:
    """SCH-2 as a Spark schema (all strings, nullable)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in csv_header(spark, path, delimiter, by_extension)])


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, by_extension: bool = True, multi_line: bool | None = None) -> DataFrame:
    """SRC-2: CSV with ragged rows, all cells text; quotes inside quotes are
    doubled, quoted cells may hold delimiters and line ends.

    With a header, cell ``i`` is named by the trimmed header name, cells past
    the header width ``_col{i}``; without one, ``col_{i}``. One aggregate over the lines looks at
    quotes and delimiters: without a header and quotes it gives the widest record, else
    one over the records finds it; where one may have more cells than the schema
    they were read with, they are read again with a schema that wide. Missing and
    empty cells are null. A file is one task's only where a cell may hold a line end: if
    every line has an even number of quotes, none does and files are split over tasks (``multi_line``
    says so without a look).
    """
    most = width = None
    if multi_line is None:
        lines = spark.read.option("pathGlobFilter", file_glob("csv") if by_extension else "*").text(path)
        number = lambda text, part: (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
        quotes, value = number("value", '"'), F.col("value")
        written = F.rtrim(value, F.lit(delimiter))  # up to the last cell that is not empty
        used = F.when(value.rlike(r"[^\x00-\x20]"), F.when(written == "", 0).otherwise(number(written, delimiter) + 1))  # other lines are no records
        seen = lines.agg(F.bool_or(quotes % 2 == 1), F.max(quotes), F.max(number("value", delimiter) + 1), F.max(used)).first()
        multi_line = bool(seen[0])
        if not multi_line:  # a record is a line, a delimiter inside quotes counts for nothing more than a bound
            most = int(seen[2] or 0)
            width = int(seen[3] or 0) if not header and not seen[1] and len(delimiter) == 1 else None
    reader = _csv(spark, delimiter, by_extension, multi_line).option("header", str(header).lower()).option("enforceSchema", "true")
    names = csv_header(spark, path, delimiter, by_extension) if header else []
    size = max(1, len(names), most) if most is not None else max(32, 2 * len(names))
    while True:
        raw = [f"_c{i}" for i in range(size)]
        text = [T.StructField(c, T.StringType(), True) for c in raw]
        if width is not None:
            break
        whole = reader.option("columnNameOfCorruptRecord", "_record").schema(T.StructType([*text, T.StructField("_record", T.StringType(), True)])).csv(path)
        last = F.array_max(F.array(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)) for i, c in enumerate(raw)]))
        # a record of another width comes whole as well; its delimiters bound its cells
        cells = F.length("_record") - F.length(F.replace("_record", F.lit(delimiter), F.lit(""))) + 1
        width, most = whole.agg(F.max(last), F.max(cells)).first()
        if (most or 0) <= size:
            break
        size = most
    df = reader.schema(T.StructType(text)).csv(path)
    width = width or 0
    width = max(width, len(names))
    cols = [(names[i] if i < len(names) else f"_col{i}") if header else f"col_{i}" for i in range(width)]
    return df.select(*[F.col(r).alias(c) for r, c in zip(raw, cols)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: parquet data (the source system only listed the files)."""
    return spark.read.option("pathGlobFilter", file_glob("parquet")).parquet(path)


def file_inventory(spark: SparkSession, path: str, fmt: str | None = None, recursive: bool = True) -> DataFrame:
    """SRC-3 / SRC-5: one metadata row per file -- ``key, modified, size, format`` --
    without reading file contents (the ``content`` column is pruned)."""
    r = spark.read.format("binaryFile")
    if fmt:
        r = r.option("pathGlobFilter", file_glob(fmt))
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(F.lit(False), F.lit(None))
    for k, exts in FORMAT_EXTENSIONS.items():
        kind = kind.when(ext.isin(*exts), F.lit(k))
    return df.select(F.col("path").alias("key"), F.col("modificationTime").alias("modified"),
                     F.col("length").alias("size"), kind.alias("format"))


def with_lineage(df: DataFrame) -> DataFrame:
    """SRC-4: source file path and modification time of every row (file sources only)."""
    if "_source_file" in df.columns:
        return df
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"),
                     F.col("_metadata.file_modification_time").alias("_source_modified"))


def list_stream_files(spark: SparkSession, root: str, stream: str, fmt: str) -> DataFrame:
    """SRC-5: files of one stream (prefix ``root/stream``) with the format's extensions."""
    return file_inventory(spark, f"{root.rstrip('/')}/{stream}", fmt)


def read_files_incremental(spark: SparkSession, path: str, fmt: str, state: _dt.datetime | None = None,
                           **options) -> tuple[DataFrame, DataFrame]:
    """SRC-6: files modified strictly after the checkpoint, and the new checkpoint
    (max modification time listed; the old one when nothing is new).

    ``modifiedAfter`` prunes files at listing time; filters on ``_metadata`` make
    both boundaries exact: the listing is made once, before the read, and files
    later than its newest are left for the next run. A file that lands afterwards with a time
    at or before the checkpoint is not found this way; see :class:`.ledger.FileLedger`.
    """
    # the checkpoint comes from the listing, so files without rows count and no data is read
    new_state = file_inventory(spark, path, fmt).agg(F.max("modified").alias("cursor_state"))
    if state is not None:
        new_state = new_state.select(F.greatest("cursor_state", F.lit(state).cast("timestamp")).alias("cursor_state"))
    new_state = materialize(new_state, "file-checkpoint")
    listed = F.lit(new_state.select(F.unix_micros("cursor_state")).first()[0]).cast("long")
    r = spark.read.format(fmt).option("pathGlobFilter", file_glob(fmt)).options(**options)
    if state is not None:
        r = r.option("modifiedAfter", state.strftime("%Y-%m-%dT%H:%M:%S"))
    df = with_lineage(r.load(path))
    if state is not None:
        df = df.filter(F.col("_source_modified") > F.lit(state))
    return df.filter(F.unix_micros("_source_modified") <= listed), new_state


def write_files(df: DataFrame, path: str, fmt: str = "json", stream_col: str | None = None,
                rows_per_file: int = 10_000, mode: str = "append") -> None:
    """SNK-1: one directory per stream, at most ``rows_per_file`` rows per file.

    CSV files carry a header of the sorted union of all columns, null as an
    empty cell; JSON lines omit null fields.
    """
    cols = sorted(c for c in df.columns if c != stream_col)
    out = df.select(*cols, *([stream_col] if stream_col else []))
    w = out.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if stream_col:
        w = w.partitionBy(stream_col)
    if fmt == "csv":
        w.option("header", "true").option("nullValue", "").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def write_tenant(df: DataFrame, root: str, tenant_col: str = "tenant_id", stream_col: str = "stream",
                 fmt: str = "parquet", mode: str = "append") -> str:
    """SNK-13: tenant-prefixed layout ``root/tenants/tenant_id=<id>/stream=<s>/``.

    Partition directories let readers prune by tenant without listing others.
    """
    target = f"{root.rstrip('/')}/tenants"
    df.write.mode(mode).partitionBy(tenant_col, stream_col).format(fmt).save(target)
    return target
