"""WARC archives of pages and their capture index by external merge.

``write_archives`` writes one record per page; each file is sorted by URL key
and time, so its records are one sorted run. ``read_archives`` parses the
files back. ``merge_index`` range-partitions the index entries by (URL key,
time, page) and merges, in each range, the slices of all runs with a loser
tree: the ranges one after another are the capture histories in global
order. Splitting by time as well keeps a URL with very many captures from
landing in one task.

Spark's text writer makes the files: a record's text ends where the next line
separator, ``CR LF CR LF``, is written, which is how a WARC record ends. So
archives go to any file system that Spark can write.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import scratch_path

from .common import cut

#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 100
RECORDS_PER_FILE = 10_000
#: 2024-01-01T00:00:00Z; pages without a capture time are taken page_id seconds later.
EPOCH = 1_704_067_200
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "url_key binary, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, seq long, offset long"
_SCHEMA = pa.schema([("url_key", pa.binary()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("run", pa.string()), ("seq", pa.int64()), ("offset", pa.int64())])


def url_key(url: F.Column) -> F.Column:
    """Sort-friendly form: ``com,example,www)/path?query`` in lower-case host order, no fragment."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(u, pattern, 1)), r"^www[0-9]*\.", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.regexp_extract(u, pattern, 2))


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", capture_time: str | None = None) -> DataFrame:
    """What each page's record will hold. Of equal payloads of at least
    ``MIN_REVISIT`` bytes the smallest page_id is the response, the others
    revisit it; rows that repeat that page_id are responses as well. Null html
    is an empty payload; a null page_id revisits a page with an id, if there
    is one, and else is a response."""
    when = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(page_id), F.lit(0))) if capture_time is None else F.col(capture_time)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capture_time"),
    )
    firsts = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = rows.join(firsts, rows.payload_digest == firsts["_digest"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select(*rows.columns, url_key(F.col("url")).alias("url_key"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record_text(r: DataFrame) -> F.Column:
    """The record up to, not with, the closing empty lines."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(k + ": "), v)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.col("capture_time")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), F.when(revisit, line("WARC-Refers-To", name(F.col("refers_to")))), F.when(revisit, F.lit("WARC-Profile: " + _PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block)


def write_archives(records: DataFrame, path: str) -> None:
    """One sorted run of WARC records in each gzipped file under ``path``."""
    runs = records.sortWithinPartitions("url_key", "capture_time", "page_id").select(record_text(records).alias("value"))
    runs.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of the records of an uncompressed WARC stream, one at a time."""
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {start}")
        headers = {}
        while (line := stream.readline()).strip():
            at += len(line)
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        at += len(line)
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n:
            raise ValueError(f"record at byte {start} is cut short")
        at += n
        yield headers, block, start


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:"):-1])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Index entries of all records, with ``payload`` if asked for.

    A response's digest and length come from the payload as read and must
    equal what its header says; a revisit's are the header's.
    """
    schema = pa.schema([*_SCHEMA, ("url", pa.string()), ("payload", pa.binary())]) if with_payload else pa.schema([*_SCHEMA, ("url", pa.string())])

    def entries(run: str, content: bytes):
        for seq, (h, block, offset) in enumerate(parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 18))):
            http, _, payload = block.partition(b"\r\n\r\n")
            n, digest = int(http.rpartition(b"Content-Length: ")[2]), h["warc-payload-digest"].removeprefix("sha256:")
            if h["warc-type"] == "response" and (n, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
            yield (h["warc-date"], _page(h["warc-record-id"]), n, digest, h["warc-type"], _page(h.get("warc-refers-to")), run, seq, offset, h.get("warc-target-uri", ""), payload)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for row in entries(name.rpartition("/")[2], content.as_py()):
                    rows.append(row)
                    size += len(row[-1]) if with_payload else 300
                    if size > 8 << 20:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)

    def emit(rows):
        columns = list(zip(*rows))[: len(schema) - 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.binary())] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, _INDEX + ", url string" + ", payload binary" * with_payload)
    return found.withColumn("url_key", F.encode(url_key(F.col("url")), "UTF-8"))


class LoserTree:
    """Merges sorted lists: the loser of each match stays in its node, the winner moves up."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i, filling=True)

    def _key(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._key(i), self._key(j)
        return a is not None and (b is None or (a, i) < (b, j))

    def _play(self, i: int, filling: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            j = self.losers[node]
            if j < 0 and filling:
                self.losers[node] = i
                return
            if self._beats(j, i):
                self.losers[node], i = i, j
            node //= 2
        self.winner = i

    def __iter__(self):
        if not self.k:
            return
        while (key := self._key(self.winner)) is not None:
            yield key
            self.at[self.winner] += 1
            self._play(self.winner)


def merge_index(entries: DataFrame) -> DataFrame:
    """Index entries in global order of (url_key, capture_time, page_id) within
    and across partitions; ``run`` and ``seq`` tell file and place of a record."""

    def run(batches):
        runs: dict[str, list] = {}
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["url_key"], r["capture_time"], r["page_id"] is not None, r["page_id"] or 0)
                runs.setdefault(r["run"], []).append((r["seq"], key, len(rows)))
                rows.append(r)
        # a run's slice in the order of its file
        slices = [[x[1:] for x in sorted(v)] for v in runs.values()]
        merged = [rows[i] for _, i in LoserTree(slices)]
        for i in range(0, len(merged), 10_000):
            yield pa.RecordBatch.from_pylist(merged[i:i + 10_000], schema=_SCHEMA)

    names = [f.name for f in _SCHEMA]
    ranged = entries.select(*names).repartitionByRange("url_key", "capture_time", "page_id")
    return ranged.mapInArrow(run, _INDEX)


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write pages as WARC files under ``path``, read them back, and return
    the merged capture index. An empty table gives no files and no rows."""
    spark = pages.sparkSession
    if path is None:
        path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(plan_records(pages, **columns), path)
    return merge_index(cut(read_archives(spark, path), "warc-index"))
