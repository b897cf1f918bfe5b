"""Registered queries: file round trips (SRC-1..6, SNK-1, SNK-13, SCH-2).

Each query writes files derived from a driver table into a fresh folder
under the session's checkpoint directory (the shared folder on a cluster),
then reads them back with the operator under test.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from ..operators.partitions import assign_batches
from ..session import materialize, scratch_path
from ..sources import files as FL
from ..sources.ledger import FileLedger
from ..sources.tables import load
from .registry import query


def _dir(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _event_lines(spark, sf):
    ev = load(spark, sf, "events")
    js = F.to_json(F.struct("event_id", "event_type", "value", "user_id"))
    bad = (F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)
    return ev.select(F.when(bad, F.substring(js, 1, 15)).otherwise(js).alias("value"))


BAD_EVENTS_SQL = "NOT (event_type = 'error' AND user_id % 2 = 0)"


@query("src01_json_lines", f"SELECT event_id, event_type, value FROM events WHERE {BAD_EVENTS_SQL}")
def _src01(spark, sf):
    d = _dir(spark, "json-lines")
    _event_lines(spark, sf).write.text(d)
    df = FL.read_json(spark, d, schema="event_id BIGINT, event_type STRING, value DOUBLE, user_id BIGINT", by_extension=False)
    return df.select("event_id", "event_type", "value")


@query("src01_json_arrays", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def _src01b(spark, sf):
    from ..sources.pages import pack_pages

    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    pages = pack_pages(li, "l_orderkey", 100, ["l_orderkey", "l_linenumber", "l_quantity"])
    per = pages.select("l_orderkey", F.array_join(F.transform("records", lambda r: F.to_json(r)), ",").alias("els"))
    per = per.join(o, "l_orderkey")
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("["), F.col("els"), F.lit(',{"l_orderkey":]'))) \
        .otherwise(F.concat(F.lit("["), F.col("els"), F.lit("]")))
    d = _dir(spark, "json-arrays")
    per.select(line.alias("value")).write.text(d)
    return FL.read_json(spark, d, schema="l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE", by_extension=False).select("l_orderkey", "l_linenumber", "l_quantity")


@query("src01_mixed_types", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS value FROM events")
def _src01c(spark, sf):
    """A value that is no number for a number column leaves the record in place."""
    ev = load(spark, sf, "events")
    odd = F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(', "value": "n/a", "more": [1, {"a": 2}]}'))
    d = _dir(spark, "json-mixed")
    ev.select(F.when(F.col("event_id") % 3 == 0, odd).otherwise(F.to_json(F.struct("event_id", "value"))).alias("value")).write.text(d)
    return FL.read_json(spark, d, schema="event_id BIGINT, value DOUBLE", by_extension=False).select("event_id", "value")


#: Records of one written array file.
ARRAY_RECORDS = 2000


@query("src01_auto_layout", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def _src01d(spark, sf):
    """A folder with files of one array over many lines, array files that are cut short, and JSON lines.
    An array file holds at most ARRAY_RECORDS records, so files grow in number, not in size."""
    ev = load(spark, sf, "events").select("event_id", "event_type")
    d = _dir(spark, "json-auto")
    ev.filter(F.col("event_type") != "click").write.mode("append").json(d)
    one = ev.filter(F.col("event_type") == "click").select(F.to_json(F.struct("event_id", "event_type")).alias("j"))
    part = F.expr(f"monotonically_increasing_id() div {ARRAY_RECORDS}")
    packed = one.groupBy(part.alias("g")).agg(F.array_join(F.collect_list("j"), ",\n  ").alias("j"))
    for line in (F.concat(F.lit("\n [\n  "), "j", F.lit("\n]")), F.concat(F.lit("[ "), "j")):
        packed.select(line.alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(d)
    df = FL.read_json(spark, d, layout="auto", schema="event_id BIGINT, event_type STRING", by_extension=False)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("event_id").cast("bigint").alias("ids"))


def _ragged_csv(spark, sf):
    """customer as CSV text: padded header names, quoted segments, two extra cells on every tenth row.
    Each output file starts with its own header line (added per partition)."""
    c = load(spark, sf, "customer")
    seg = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"'))
    base = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_name"), seg)
    line = F.when(F.col("c_custkey") % 10 == 0, F.concat(base, F.lit(",x1,x2"))).otherwise(base)

    def with_header(batches):
        import pandas as pd

        first = True
        for pdf in batches:
            if first:
                yield pd.DataFrame({"value": [" c_custkey , c_name ,c_mktsegment"]})
                first = False
            yield pdf

    d = _dir(spark, "csv")
    c.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(d)
    return d


@query("src02_csv_ragged", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment,
  CASE WHEN c_custkey % 10 = 0 THEN 'x1' END AS _col3, CASE WHEN c_custkey % 10 = 0 THEN 'x2' END AS _col4 FROM customer""")
def _src02(spark, sf):
    return FL.read_csv(spark, _ragged_csv(spark, sf), ",", header=True, by_extension=False)


@query("src02_csv_quotes", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ' "the|' || c_mktsegment || '"' AS title,
  CASE WHEN c_custkey % 4 = 0 THEN 'two' || chr(10) || 'lines' ELSE 'plain' END AS note, CASE WHEN c_custkey % 10 = 0 THEN 'more' END AS _col3 FROM customer""")
def _src02b(spark, sf):
    """``|`` between cells, doubled quotes, delimiters and line ends inside quotes."""
    c = load(spark, sf, "customer")
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))
    title = quoted(F.concat("c_name", F.lit(' "the|'), "c_mktsegment", F.lit('"')))
    note = F.when(F.col("c_custkey") % 4 == 0, quoted(F.lit("two\nlines"))).otherwise(F.lit("plain"))
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), title, note, F.when(F.col("c_custkey") % 10 == 0, F.lit("more")))

    def with_header(batches):
        import pandas as pd

        for i, pdf in enumerate(batches):
            yield pd.concat([pd.DataFrame({"value": ["id| title |note"]}), pdf]) if i == 0 else pdf

    d = _dir(spark, "csv-quotes")
    c.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(d)
    return FL.read_csv(spark, d, "|", header=True, by_extension=False)


@query("src02_csv_wide", "SELECT 'col_' || CAST(l_linenumber * 10 - 1 AS VARCHAR) AS name, CAST(count(*) AS BIGINT) AS cells FROM lineitem GROUP BY 1")
def _src02c(spark, sf):
    """Without a header; row widths follow the data and pass the first schema's size."""
    li = load(spark, sf, "lineitem")
    d = _dir(spark, "csv-wide")
    li.select(F.concat(F.repeat(F.lit(","), (F.col("l_linenumber") * 10 - 1).cast("int")), F.col("l_orderkey").cast("string")).alias("value")).write.text(d)
    df = FL.read_csv(spark, d, ",", header=False, by_extension=False)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("cells")) for c in df.columns])).alias("r")).select("r.*").where("cells > 0")


@query("sch02_csv_schema", """SELECT name, 'string' AS type, CAST((SELECT count(*) FROM customer) AS BIGINT) AS rows
FROM (SELECT DISTINCT 'segment ' || c_mktsegment AS name FROM customer)""")
def _sch02(spark, sf):
    """The header holds the segments of the table; every row has one cell per segment."""
    c = load(spark, sf, "customer")
    segments = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    cells = c.select(*[(F.col("c_mktsegment") == s).cast("string").alias(f" segment {s} ") for s in segments])
    d = _dir(spark, "csv-schema")
    cells.write.option("header", "true").csv(d)
    schema = FL.csv_schema(spark, d, ",", by_extension=False)
    names = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields], "name string, type string")
    rows = FL.read_csv(spark, d, ",", by_extension=False).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    return names.join(F.broadcast(rows))


@query("src03_parquet_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _src03(spark, sf):
    d = _dir(spark, "parquet")
    load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(d)
    return FL.read_parquet(spark, d)


@query("src03_file_inventory", "SELECT o_orderpriority AS folder, 'parquet' AS format, true AS non_empty, CAST(ceil(count(*) / 2000.0) AS BIGINT) AS least_files FROM orders GROUP BY 1")
def _src03b(spark, sf):
    d = _dir(spark, "inventory")
    load(spark, sf, "orders").repartition("o_orderpriority").write.option("maxRecordsPerFile", 2000).partitionBy("o_orderpriority").parquet(d)
    inv = FL.file_inventory(spark, d, "parquet")
    folder = F.url_decode(F.regexp_extract("key", "o_orderpriority=([^/]+)/", 1))
    return inv.groupBy(folder.alias("folder"), "format").agg(F.min(F.col("size") > 0).alias("non_empty"), F.count(F.lit(1)).cast("bigint").alias("least_files"))


@query("src04_lineage", f"SELECT event_id, true AS from_file FROM events WHERE {BAD_EVENTS_SQL}")
def _src04(spark, sf):
    d = _dir(spark, "lineage")
    _event_lines(spark, sf).write.text(d)
    df = FL.with_lineage(FL.read_json(spark, d, schema="event_id BIGINT, event_type STRING", by_extension=False))
    return df.select("event_id", (F.col("_source_file").contains(d.split("/")[-1]) & F.col("_source_modified").isNotNull()).alias("from_file"))


@query("src05_stream_files", "SELECT event_type AS stream, 'json' AS format, CAST(ceil(count(*) / 500.0) AS BIGINT) AS files FROM events GROUP BY 1")
def _src05(spark, sf):
    """Every event type is a stream with its own folder, written by many tasks: 500 rows in a file, the rest in the last."""
    root = _dir(spark, "streams")
    ev = load(spark, sf, "events").select("event_id", "event_type", "value")
    streams = [r[0] for r in ev.select("event_type").distinct().collect()]
    for stream in streams:
        files = assign_batches(ev.filter(F.col("event_type") == stream), ["event_id"], 500, "file")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files.repartition(tasks, "file").write.option("maxRecordsPerFile", 500).partitionBy("file").json(f"{root}/{stream}")
        ev.filter(F.col("event_type") == stream).limit(1).write.mode("append").csv(f"{root}/{stream}")  # another format beside
    found = [FL.list_stream_files(spark, root, s, "json").withColumn("stream", F.lit(s)) for s in streams]
    files = found[0]
    for f in found[1:]:
        files = files.unionByName(f)
    in_stream = files.where(F.col("key").contains(F.concat(F.lit("/"), "stream", F.lit("/"))))
    return in_stream.groupBy("stream", "format").agg(F.count(F.lit(1)).cast("bigint").alias("files"))


@query("src06_incremental_files", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def _src06(spark, sf):
    d = _dir(spark, "incremental")
    ev = load(spark, sf, "events").select("event_id", "event_type")
    ev.filter(F.col("event_type") != "purchase").write.mode("append").parquet(d)
    _, state = FL.read_files_incremental(spark, d, "parquet")
    checkpoint = state.first()[0]
    time.sleep(1.1)  # the next batch lands strictly later
    ev.filter(F.col("event_type") == "purchase").write.mode("append").parquet(d)
    new, _ = FL.read_files_incremental(spark, d, "parquet", checkpoint)
    return new.select("event_id")


@query("src06_file_ledger", "SELECT event_id, CAST(event_id % 3 AS INTEGER) AS round FROM events")
def _src06b(spark, sf):
    """Three drops of files; the second and third land between a listing and its read, all within
    one second. Every file is read once, in the round after the listing that shows it."""
    d = _dir(spark, "ledger-files")
    ledger = FileLedger(spark, _dir(spark, "ledger"), d, "parquet")
    ev = load(spark, sf, "events").select("event_id")
    drop = lambda i: ev.where(F.col("event_id") % 3 == i).write.mode("append").parquet(d)
    out = None
    drop(0)
    for i in range(3):
        new = ledger.list_new()
        if i < 2:
            drop(i + 1)
        rows = materialize(ledger.read(new).select("event_id", F.lit(i).alias("round")), "ledger-rows")
        ledger.commit(new)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snk01_write_files", "SELECT event_type, CAST(count(*) AS BIGINT) AS rows, true AS files_within_limit FROM events GROUP BY event_type")
def _snk01(spark, sf):
    d = _dir(spark, "sink")
    ev = load(spark, sf, "events").select("event_id", "event_type", "value", "props")
    FL.write_files(ev, d, "csv", stream_col="event_type", rows_per_file=500)
    back = FL.with_lineage(spark.read.option("header", "true").csv(d))
    per_file = back.groupBy("event_type", "_source_file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("event_type").agg(F.sum("n").cast("bigint").alias("rows"), (F.max("n") <= 500).alias("files_within_limit"))


@query("snk13_tenant_layout", """SELECT CAST(c_nationkey AS INTEGER) AS tenant_id, o_orderpriority AS stream, CAST(count(*) AS BIGINT) AS runs
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def _snk13(spark, sf):
    root = _dir(spark, "tenants")
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = o.select(F.col("c_nationkey").alias("tenant_id"), F.col("o_orderpriority").alias("stream"), "o_orderkey")
    target = FL.write_tenant(runs, root)
    back = spark.read.parquet(target)
    return back.groupBy(F.col("tenant_id").cast("int").alias("tenant_id"), "stream").agg(F.count(F.lit(1)).cast("bigint").alias("runs"))
