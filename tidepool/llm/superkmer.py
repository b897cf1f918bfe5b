"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the
least hash of its ``m``-word grams. Consecutive windows with the same
minimiser are one super-k-mer: their words travel as one packed string to the
bucket of the minimiser, together with document and position. Equal windows
have equal minimisers, so they meet in one bucket, where sorting brings them
together; all but the first (smallest doc_id, then start) are repeats.

Skew: a gram with more than ``heavy_share`` of all grams would make a hot
bucket. A first pass counts grams in all texts and finds these (see
``heavy_grams``; at most ``2 / heavy_share``, which bounds the broadcast list); in the order of grams
they come last, so a window is known by one of its rarer grams if it has
any. Windows of heavy grams alone lie inside text that is repeated over and
over: of those a task sends each distinct string once, for the first place
it has seen, and reports the other places as repeats at once.

Packed strings of a chunk are compressed together for each bucket. Windows
are compared by two independent 64-bit hashes of their word sequence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Words, chunks, cut, ints, mix, partitions, record, squeezed, text_of, unsqueezed, word_runs

WINDOW = 20
GRAM = 4
HEAVY_SHARE = 1e-5
#: Longest super-k-mer, in windows; longer runs (periodic text) are cut.
RUN_WINDOWS = 512
BUCKETS_PER_PARTITION = 8
_SEND_BYTES = 4 << 20
_SEEN = 1 << 20
_HIGH = np.uint64(1 << 63)

_PLACES = "doc long, tag int, start int, end int"


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (null: before all others), tag (tells apart rows that share an id) and text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(text_of(text)).alias("tag"), text_of(text).alias("text"))


def heavy_grams(docs: DataFrame, text: str = "text", m: int = GRAM, share: float = HEAVY_SHARE) -> DataFrame:
    """Hashes of word grams that make a hot bucket: those with about ``share`` of all
    gram occurrences or more.

    Each chunk reports its grams that stand there twice at least and have
    ``share / 2`` of the chunk's grams. What a gram loses that way in a chunk is one occurrence,
    or less than ``share / 2`` of the chunk. So a gram is found if it has ``share`` of the whole and more than twice
    as many occurrences as there are chunks that hold it; one that stands once in each of
    many chunks is not, however many they are. It has one occurrence in some 45,000 grams then (a
    chunk of 256 KiB), which is less than a bucket's even share as long as there are fewer buckets than
    that; only with chunks of few grams (very small partitions) can it be more. At most
    ``2 / share`` grams are found. Results don't depend on which.
    """
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, data, offsets in chunks(batches):
            words = Words(data, offsets)
            if len(words) < m:
                continue
            grams = mix(word_runs(words.hashes()).each(m))[words.doc[: 1 - m or None] == words.doc[m - 1:]]
            values, counts = np.unique(grams, return_counts=True)
            keep = counts >= max(2, share / 2 * len(grams))
            yield record(schema, np.append(values[keep].view(np.int64), 0), np.append(counts[keep], 0))
            yield record(pa.schema([("gram", pa.int64()), ("n", pa.int64())]), np.array([0]), np.array([-len(grams)]))

    # rows of gram 0 with n < 0 carry the total
    sums = cut(docs.select(text_of(text).alias("text")).mapInArrow(run, "gram long, n long").where("n <> 0").groupBy("gram", F.expr("n < 0").alias("total")).agg(F.sum("n").alias("n")), "grams")
    total = sums.where("total").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sums.where(~F.col("total") & (F.col("n") >= max(2.0, -total * share / 2))).select("gram")


def _send(docs: DataFrame, heavy: np.ndarray, k: int, m: int, buckets: int) -> DataFrame:
    """Rows (bucket, blob) of packed super-k-mers, and (doc, tag, start, end) of certain repeats."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # sorted; at most 2 / share entries

    def run(batches):
        heavy, seen, pack = shared.value, {}, zstandard.ZstdCompressor(level=6)
        for batch, data, offsets in chunks(batches, size=_SEND_BYTES):
            words = Words(data, offsets)
            n = len(words) - k + 1
            if n < 1:
                continue
            hashes = words.hashes()
            one, two = word_runs(hashes, 0), word_runs(hashes, 1)
            grams = mix(one.each(m))
            order = grams >> np.uint64(1)
            if len(heavy):
                order = np.where(heavy[np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)] == grams, order | _HIGH, order)
            least, span = order, 1
            while span < k - m + 1:  # least of `span` grams, doubled up to the window
                step = min(span, k - m + 1 - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            valid = words.doc[:n] == words.doc[k - 1:]
            fresh = np.ones(n, bool)
            fresh[1:] = ~valid[:-1] | (least[1:] != least[:-1])
            heads = np.flatnonzero(fresh & valid)
            if not len(heads):
                continue
            ends = np.append(heads[1:], n)
            bad = np.append(np.flatnonzero(~valid), n)
            ends = np.minimum(ends, bad[np.searchsorted(bad, heads)])
            if (ends - heads).max() > RUN_WINDOWS:
                parts = -(-(ends - heads) // RUN_WINDOWS)
                k_of = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                last = np.repeat(ends, parts)
                heads = np.repeat(heads, parts) + k_of * RUN_WINDOWS
                ends = np.minimum(heads + RUN_WINDOWS, last)
            row = words.doc[heads]
            doc, tag = ints(batch, "doc")[row], ints(batch, "tag")[row]
            start = heads - words.first[row]
            stop = ends + k - 1  # of words
            key, key2 = one.of(heads, stop), two.of(heads, stop)
            minimiser = mix(least[heads])
            send = np.ones(len(heads), bool)
            # equal strings of this chunk: the first place stands for all
            by = np.lexsort((tag, start, doc, key2, key))
            same = np.zeros(len(by), bool)
            same[1:] = (key[by][1:] == key[by][:-1]) & (key2[by][1:] == key2[by][:-1])
            # ... if its place is before theirs, not the same place of a repeated row
            first = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
            later = same & ((doc[by] != doc[first]) | (start[by] != start[first]))
            # ... and of another text with that id and place, which is not later but must be judged too
            other = same & ~later & np.append(False, tag[by][1:] != tag[by][:-1])
            send[by[same & ~other]] = False
            sure = by[later]
            for i in np.flatnonzero(send & (least[heads] >= _HIGH)).tolist():
                place, at = (int(key[i]), int(key2[i])), (int(doc[i]), int(start[i]))
                if at > (known := seen.get(place, (1 << 63, 0))):
                    send[i] = False
                    sure = np.append(sure, i)
                elif at < known:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen[place] = at
            if len(sure):
                yield record(schema, (mix(doc[sure].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), pa.nulls(len(sure), pa.binary()), doc[sure], tag[sure], start[sure], (start + ends - heads)[sure])
            chosen = np.flatnonzero(send)
            bucket = (minimiser[chosen] % np.uint64(buckets)).astype(np.int32)
            chosen, bucket = chosen[o := np.argsort(bucket, kind="stable")], np.sort(bucket, kind="stable")
            packed, at = words.packed()
            raw = packed.tobytes()
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            blobs = []
            for a, b in zip(cuts, np.append(cuts[1:], len(chosen))):
                part = chosen[a:b]
                text = b"\n".join([raw[s:e] for s, e in zip(at[heads[part]].tolist(), (at[stop[part]] - 1).tolist())])
                head = np.array([len(part)], np.int64).tobytes() + doc[part].tobytes() + tag[part].astype(np.int32).tobytes() + start[part].astype(np.int32).tobytes()
                blobs.append(pack.compress(head + text))
            none = pa.nulls(len(blobs), pa.int64())
            yield record(schema, bucket[cuts], blobs, none, none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int32()))

    return docs.mapInArrow(run, "bucket int, blob binary, " + _PLACES)


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """doc, tag, start and words of the super-k-mers of some blobs."""
    doc, tag, start, text = [], [], [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        doc.append(np.frombuffer(raw, np.int64, n, 8))
        tag.append(np.frombuffer(raw, np.int32, n, 8 + 8 * n))
        start.append(np.frombuffer(raw, np.int32, n, 8 + 12 * n))
        text.append(raw[8 + 16 * n:])
    data = np.frombuffer(b"\n".join(text), np.uint8)
    breaks = np.flatnonzero(data == 10)  # words have no line feed
    offsets = np.concatenate([[0], breaks + 1, [len(data)]])
    return np.concatenate(doc), np.concatenate(tag), np.concatenate(start), Words(data, offsets)


def _repeats(sent: DataFrame, k: int) -> DataFrame:
    """Places (doc, tag, start, end) of runs of windows that start earlier elsewhere."""
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def of(blobs: list[bytes]) -> pa.RecordBatch:
        doc, tag, start, words = _unpack(blobs)
        hashes = words.hashes()
        n = len(words) - k + 1
        first = np.flatnonzero(words.doc[:n] == words.doc[k - 1:])
        key = word_runs(hashes, 0).each(k)[first]
        run = words.doc[first]
        at = start[run] + (first - words.first[run])
        by = np.argsort(key)
        equal = key[by][1:] == key[by][:-1]
        some = by[np.append(False, equal) | np.append(equal, False)]
        key2 = word_runs(hashes, 1).of(first[some], first[some] + k)
        some = some[o := np.lexsort((at[some], doc[run[some]], key2, key[some]))]
        a, b, c, d = key[some], key2[o], doc[run[some]], at[some]
        same = np.zeros(len(some), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))
        later = some[same & ((c != c[head]) | (d != d[head]))]
        # neighbouring windows of one super-k-mer become one run
        later.sort()
        r, p = run[later], at[later]
        new = np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)) if len(later) else np.zeros(0, bool)
        last = np.append(np.flatnonzero(new)[1:] - 1, len(later) - 1) if len(later) else np.zeros(0, int)
        return record(schema, doc[r[new]], tag[r[new]], p[new], p[last] + 1)

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            known = batch.filter(batch.column("blob").is_null())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(f.name) for f in schema], schema=schema)
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if blob is None:
                    continue
                if b != bucket and held:
                    yield of(held)
                    held = []
                bucket = b
                held.append(blob)
        if held:
            yield of(held)

    n = partitions(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PLACES)


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = GRAM, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Runs of repeated windows: (doc, tag, start, end), window starts in words, end exclusive."""
    rows = _documents(docs, key, text)
    heavy = np.sort(np.array([r[0] for r in heavy_grams(docs, text, m, heavy_share).toLocalIterator()], np.int64).view(np.uint64))
    buckets = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    return _repeats(_send(rows, heavy, k, m, buckets), k)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = GRAM, heavy_share: float = HEAVY_SHARE, with_text: bool = True) -> DataFrame:
    """Documents without the words of windows that start earlier elsewhere:
    (key, n_words, n_removed, kept_sha256[, kept_text]).

    *Earlier* is a smaller key, or the same key and an earlier start; a null
    key comes before all others. Rows that share a key and text are judged
    alike (none is earlier than its twin); rows that share only a key are kept
    apart by a hash of the text. A null text has no words; texts of fewer than
    ``k`` words have no window and stay whole; an empty table gives no rows.
    ``kept_text`` is the kept words joined by one space.
    """
    out = [("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
    schema = pa.schema(out)

    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(unsqueezed(batch.column("text").to_pylist()), batch.column("runs").to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in runs or ():
                    gone[r["start"]] += 1
                    gone[r["end"] + k - 1] -= 1
                kept = words if not runs else [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = list(zip(*rows))[: len(out) - 1] if rows else [[]] * (len(out) - 1)
            yield record(schema, batch.column("id"), *columns)

    runs = repeated_windows(docs, key, text, k, m, heavy_share).groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    both = squeezed(_documents(docs, key, text)).join(runs, ["doc", "tag"], "left").select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("id"), "text", "runs")
    return both.mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text).withColumnRenamed("key", key)
