"""Benchmark passages in documents by q-gram lemma filtering.

Texts are normalised: A-Z lowered, white space runs to one space; characters
below are the bytes of that text's UTF-8. A passage of m characters may occur with
up to e = ``RATE`` * m edits. By the q-gram lemma such an occurrence shares at
least m - q + 1 - q * e of the passage's q-grams, on diagonals (document position less
passage position) that differ by at most e. Shared q-grams are counted in overlapping
bands of diagonals; bands that meet the bound are verified by an alignment inside the band.

With ``passage`` set, an item longer than ``LEAST_PASSAGE`` is also looked for in
overlapping passages of half its length (at least ``LEAST_PASSAGE``, at most
``passage``), one from every quarter of a passage on, each with its own budget, so a document that holds part of
an item is found too: every unchanged stretch of 1.25 passages holds one. Items over ``WHOLE_ITEM``
are looked for in passages only, as a whole one within the budget has a passage within its own.

The benchmark is read in blocks of at most ``BLOCK_BYTES``; each block's q-gram
index is sent to the tasks, so what is broadcast is bounded, and all documents are
scanned for each block. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Runs, Words, chunks, cut, mix, record, spare, text_of

Q = 12
RATE = 0.05
BLOCK_BYTES = 2 << 20
#: Lengths in bytes of normalised text: the passages of a long item, the shortest passage of any, the longest item looked for whole.
PASSAGE, LEAST_PASSAGE, WHOLE_ITEM = 200, 80, 2000
#: Cells of one alignment table (a row more than that is worked on alone).
_CELLS = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20
_FILTER_BITS = 22


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q-gram of ``text``, worked out a slice at a time."""
    parts = []
    for i in range(0, max(len(text) - q + 1, 0), _SLICE):
        parts.append(mix(Runs(text[i:i + _SLICE + q - 1].astype(np.uint64) + np.uint64(1), _BASE).each(q)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


@dataclass
class Index:
    """q-grams of a block of passages: postings in the order of their hash."""

    ids: np.ndarray  # item id of each passage
    whole: np.ndarray  # whether it is the whole item
    texts: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    band: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def edit_budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in a passage: its share, but no more than leave one whole q-gram."""
    return max(min(int(rate * m), (m - q) // q), 0)


def passages_of(text: np.ndarray, passage: int | None) -> list[tuple[bool, np.ndarray]]:
    """(whether it is all of it, bytes) of what is looked for of an item."""
    out = [(True, text)] if passage is None or len(text) <= WHOLE_ITEM else []
    if passage is not None:
        size = max(LEAST_PASSAGE, min(len(text) // 2, passage))
        last = len(text) - size
        if last > 0:
            out += [(False, text[i:i + size]) for i in sorted({*range(0, last, size // 4), last})]
    return out


def build_index(items: list[tuple[int, bytes]], q: int, rate: float, passage: int | None = None) -> Index:
    ids, whole, texts, edits, hashes, item, place = [], [], [], [], [], [], []
    for item_id, raw in items:
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)
        for all_of_it, text in passages_of(words.packed()[0][:-1], passage):
            if len(text) < q:
                continue
            h = grams(text, q)
            hashes.append(h)
            item.append(np.full(len(h), len(ids)))
            place.append(np.arange(len(h)))
            ids.append(item_id)
            whole.append(all_of_it)
            texts.append(text)
            edits.append(edit_budget(len(text), q, rate))
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    h, edits = cat(hashes, np.uint64), np.array(edits, np.int64)
    by = np.argsort(h, kind="stable")
    keys, first = np.unique(h[by], return_index=True)
    lens = np.array([len(t) for t in texts], np.int64)
    held = np.zeros(1 << _FILTER_BITS, bool)
    held[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return Index(np.array(ids, np.int64), np.array(whole, bool), texts, edits, np.maximum(lens - q + 1 - q * edits, 1), edits + 8, keys, np.append(first, len(h)), cat(item, np.int64)[by], cat(place, np.int64)[by], held)


def align(passages: list[np.ndarray], regions: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each passage (all of one band width) against its region, and the region position behind that match.

    Column k of the table is diagonal k: passage character i against region
    character i + k. Start and end in the region are free; characters outside are 0 and
    match nothing.
    """
    n, m = len(passages), max(map(len, passages))
    lens = np.array([len(p) for p in passages])
    p, r = np.zeros((n, m), np.int16), np.zeros((n, m + width), np.int16)
    for i, (a, b) in enumerate(zip(passages, regions)):
        p[i, :len(a)] = a.astype(np.int16) + 1
        r[i, :len(b)] = b
    r = np.where(r == 0, np.int16(-1), r + 1)
    steps = np.arange(width, dtype=np.int32)
    cost = np.zeros((n, width), np.int32)
    best, end = np.full(n, 1 << 20, np.int32), np.zeros(n, np.int64)
    for i in range(m):
        now = cost + (p[:, i:i + 1] != r[:, i:i + width])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)  # passage character left out
        cost = np.minimum.accumulate(now - steps, axis=1) + steps  # region characters put in
        done = np.flatnonzero(lens == i + 1)
        if len(done):
            k = cost[done].argmin(1)
            best[done], end[done] = cost[done, k], i + 1 + k
    return best, end


def scan(index: Index, words: Words, q: int) -> list[tuple[int, int, int, int]]:
    """(document, passage, end in the document's normalised text, edits) of the best match in each band that holds one."""
    text, at = words.packed()
    if not len(text) or not len(index.keys):
        return []
    starts = at[words.first]  # of documents, in text
    h = grams(text, q)
    maybe = np.flatnonzero(index.filter[h >> np.uint64(64 - _FILTER_BITS)])
    key = np.searchsorted(index.keys, h[maybe])
    key = np.minimum(key, len(index.keys) - 1)
    hit = index.keys[key] == h[maybe]
    pos, key = maybe[hit], key[hit]
    doc = np.searchsorted(starts, pos, side="right") - 1
    inside = pos + q <= starts[doc + 1] - 1  # not over a document's last character
    pos, key, doc = pos[inside], key[inside], doc[inside]
    many = index.first[key + 1] - index.first[key]
    total = np.cumsum(many)
    if not len(total) or not total[-1]:
        return []
    posting = np.repeat(index.first[key] - (total - many), many) + np.arange(total[-1])
    item, place = index.item[posting], index.place[posting]
    gap = int(max(map(len, index.texts)))  # keeps diagonals positive
    diagonal = np.repeat(pos - starts[doc], many) - place + gap
    cell = diagonal // index.band[item]
    row = np.repeat(doc, many)
    by = np.lexsort((cell, item, row))
    row, item, cell = row[by], item[by], cell[by]
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])))
    count = np.diff(np.append(heads, len(row)))
    row, item, cell = row[heads], item[heads], cell[heads]
    # A band is two neighbouring cells; an occurrence's diagonals lie in the band that starts at the
    # cell of its least one, which may have no hits itself.
    next_one = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (cell[1:] == cell[:-1] + 1)
    lone = np.flatnonzero(~np.append(False, next_one))
    band = np.append(count + np.append(np.where(next_one, count[1:], 0), 0), count[lone])
    row, item, cell = np.append(row, row[lone]), np.append(item, item[lone]), np.append(cell, cell[lone] - 1)
    good = np.flatnonzero(band >= index.need[item])
    lens = np.array([len(t) for t in index.texts], np.int64)
    out = []
    for width in np.unique(index.band[item[good]]):
        some = good[index.band[item[good]] == width]
        # alike long ones together, as many as a table of bounded size holds
        size = lens[item[some]] + 2 * width
        some, size = some[by := np.argsort(size, kind="stable")], size[by]
        i = 0
        while i < len(some):
            many = np.arange(1, len(some) - i + 1) * size[i:]
            part = some[i:i + max(1, min(256, int(np.searchsorted(many, _CELLS, side="right"))))]
            i += len(part)
            passages, regions, begins = [], [], []
            for r, t, c in zip(row[part].tolist(), item[part].tolist(), cell[part].tolist()):
                low, reach = c * int(width) - gap, len(index.texts[t]) + 2 * int(width)
                a, b = starts[r], starts[r + 1] - 1
                piece = text[max(a, a + low): max(a, min(b, a + low + reach))]
                passages.append(index.texts[t])
                regions.append(np.concatenate([np.zeros(max(-low, 0), np.uint8), piece]))
                begins.append(low)
            edits, ends = align(passages, regions, 2 * int(width))
            for k in np.flatnonzero(edits <= index.edits[item[part]]).tolist():
                out.append((int(row[part[k]]), int(item[part[k]]), begins[k] + int(ends[k]), int(edits[k])))
    return out


def blocks(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Distinct passages (id, text) in blocks of at most ``size`` bytes, or one passage; always one block at least."""
    held, total = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("long"), F.lit(NULL_ID)).alias("i"), F.encode(text_of(item_text), "UTF-8").alias("t")).distinct()
    for r in rows.toLocalIterator():
        if held and total + len(r["t"]) > size:
            yield held
            held, total = [], 0
        held.append((r["i"], bytes(r["t"])))
        total += len(r["t"])
    yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES, passage: int | None = None) -> DataFrame:
    """(doc_id, item_id, edits, end, n_bytes): documents that hold an item or, with
    ``passage``, a passage of one, with the best match: the whole item before a passage, then
    fewest edits, then the first end (in bytes of the normalised text). ``n_bytes`` is the length of what
    was looked for.

    Null or empty texts hold nothing, null or empty passages and those of fewer than
    ``q`` characters are in no document. Null ids stay null. Repeated rows of a document
    give one row for an id, as do repeated passages. Empty tables give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.bool_()), ("edits", pa.int64()), ("end", pa.int64()), ("n_bytes", pa.int64())])
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text).alias("text"))

    def block(items: list[tuple[int, bytes]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(build_index(items, q, rate, passage))

        def run(batches):
            index = shared.value
            for batch, data, offsets in chunks(batches):
                found = scan(index, Words(data, offsets, lower=True), q)
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*[(ids[d], int(index.ids[t]), not index.whole[t], e, end, len(index.texts[t])) for d, t, end, e in found])) or [[]] * 6
                yield record(schema, *columns)

        return rows.mapInArrow(run, "doc_id long, item_id long, part boolean, edits long, end long, n_bytes long")

    parts: list[DataFrame] = []
    for items in blocks(benchmark, item, item_text, block_bytes):
        if parts:  # one block's index at a time; what it found is written once
            parts[-1] = cut(parts[-1], "leaks")
        parts.append(block(items))
    found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("part", "edits", "end", "n_bytes")).alias("m"))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return best.select(shown("doc_id"), shown("item_id"), "m.edits", "m.end", "m.n_bytes")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES, passage: int | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item (nor passage of one, with ``passage``); decided
    where a row is read, without a shuffle. Rows with a null or empty text stay, as do all if the benchmark is empty or
    its items are null or shorter than ``q``; repeated rows are decided alike; an empty table gives no rows."""
    names, spark, normal = docs.columns, docs.sparkSession, spare(docs, "_normal")

    def block(rows: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_index(items, q, rate, passage))

        def run(batches):
            index = shared.value
            for batch, data, offsets in chunks(batches, normal):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in scan(index, Words(data, offsets, lower=True), q)]] = False
                yield batch.filter(pa.array(keep)).select(names)

        return rows.withColumn(normal, text_of(text)).mapInArrow(run, docs.schema)

    rows = None
    for items in blocks(benchmark, item, item_text, block_bytes):
        rows = block(docs if rows is None else cut(rows, "clean"), items)
    return rows
