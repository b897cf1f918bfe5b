"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lowered, white space collapsed and trimmed) and
hashed to 128 bits; for each host Spark counts the distinct documents (rows
that repeat an id and its text are one) that hold a line. Lines over a
host's limit are boilerplate and are taken out; a document of which too much
is gone is depleted and rejected. Base rules per text come along: length,
symbols, repeated lines and repeated 8-word windows.

The first count is keyed by host, line and document, so a host with a third of
all rows is spread; the second combines on the map side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Runs, Words, chunks, cut, mix, record, spare, text_of, word_runs

#: A line is boilerplate when more than this share of its host's documents, and more than this many, hold it.
LINE_SHARE, LINE_TEXTS = 0.01, 20
#: Documents of a host that the share is taken of at most, so that the limit does not loosen as a host grows.
HOST_DOCUMENTS = 10_000
#: A document is depleted when at least this share of its words is in boilerplate lines.
DEPLETED = 0.8
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30  # per cent of words
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = 0x9E3779B97F4A7C15


def _per_doc(mask_doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(mask_doc, minlength=n).astype(np.int64)


def _later_twins(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over elements in order: equal to an earlier one of the document, and equal to any other one."""
    by = np.lexsort((*keys[::-1], doc))  # stable: equal ones stay in order
    same = np.zeros(len(by), bool)
    same[1:] = doc[by][1:] == doc[by][:-1]
    for k in keys:
        same[1:] &= k[by][1:] == k[by][:-1]
    later, twin = np.zeros(len(by), bool), np.zeros(len(by), bool)
    later[by] = same
    twin[by] = same | np.append(same[1:], False)
    return later, twin


def text_facts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Base figures per document, and its lines that have a word: (document, two hashes, words)."""
    n = len(offsets) - 1
    where = np.repeat(np.arange(n), np.diff(offsets))
    words = Words(data, offsets)
    count = np.diff(words.first)
    lead = (data & 0xC0) != 0x80
    at = np.append(0, np.cumsum(lead))
    word_chars = np.zeros(n, np.int64)
    np.add.at(word_chars, words.doc, at[words.end] - at[words.start])
    symbols = _per_doc(where[_SYMBOL[data]], n)
    hashes = words.hashes()
    # words of windows that the text holds twice
    repeated = np.zeros(n, np.int64)
    if len(words) >= WINDOW:
        first = np.flatnonzero(words.doc[: 1 - WINDOW] == words.doc[WINDOW - 1:])
        keys = [word_runs(hashes, b).each(WINDOW)[first] for b in (0, 1)]
        _, twin = _later_twins(words.doc[first], *keys)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, first[twin], 1)
        np.add.at(cover, first[twin] + WINDOW, -1)
        repeated = _per_doc(words.doc[np.cumsum(cover)[:-1] > 0], n)
    heads, stops, doc, size, keys = line_keys(data, offsets, words)
    raw = data.astype(np.uint64) + np.uint64(1)
    later, _ = _later_twins(doc, *[mix(Runs(raw, base).of(heads, stops)) for base in (_BASE, 0xA0761D6478BD642F)])
    dup_lines = _per_doc(doc[later], n)
    return [count.astype(np.int64), word_chars, symbols, dup_lines, repeated], [doc, *keys, size]


def line_keys(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The lines that have a word: first byte, end, document, words, and two hashes of the normalised line."""
    # cut at \n and at documents' ends
    heads = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    heads = heads[heads < len(data)]
    stops = np.append(heads[1:], len(data))[: len(heads)]
    stops = stops - (data[stops - 1] == 10)
    a, b = np.searchsorted(words.start, heads), np.searchsorted(words.start, stops)
    heads, stops, a, b = (x[some] for x in (heads, stops, a, b)) if (some := b > a).any() else (heads[:0],) * 4
    low = Words(data, offsets, lower=True).hashes()
    return heads, stops, words.doc[a], (b - a).astype(np.int64), [mix(word_runs(low, k).of(a, b)) for k in (0, 1)]


_BASE_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINE = "struct<h1:long,h2:long,words:long>"


def line_facts(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Each row's id, host, text hash, base figures and lines (distinct, with their words in total)."""
    base = [f.split()[0] for f in _BASE_DDL.split(", ")]
    line = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), *((b, pa.int64()) for b in base), ("lines", pa.list_(line))])

    def run(batches):
        for batch, data, offsets in chunks(batches):
            facts, (doc, one, two, size) = text_facts(data, offsets)
            by = np.lexsort((two, one, doc))
            d, a, b = doc[by], one[by], two[by]
            new = np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(by) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            total = np.add.reduceat(size[by], heads) if len(heads) else np.zeros(0, np.int64)
            structs = pa.StructArray.from_arrays([pa.array(a[heads].view(np.int64)), pa.array(b[heads].view(np.int64)), pa.array(total)], fields=list(line))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d[heads], np.arange(len(offsets))), pa.int32()), structs)
            yield record(schema, *(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "host", "text_hash")), *facts, lists)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, host string, text_hash long, {_BASE_DDL}, lines array<{_LINE}>")


def boilerplate(facts: DataFrame, share: float = LINE_SHARE, texts: int = LINE_TEXTS, host_documents: int = HOST_DOCUMENTS) -> DataFrame:
    """(host, h1, h2) of lines that too many of a host's documents hold."""
    host = F.coalesce("host", F.lit("")).alias("host")  # rows without a host are one host
    held = facts.select(host, "doc_id", "text_hash", F.explode("lines").alias("line")).select("host", "doc_id", "text_hash", "line.h1", "line.h2").distinct()
    counts = held.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > texts)
    sizes = facts.select(host, "doc_id", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return counts.join(sizes, "host").where(F.col("n") > F.least("all", F.lit(host_documents)) * share).select("host", "h1", "h2")


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", share: float = LINE_SHARE, texts: int = LINE_TEXTS, depleted: float = DEPLETED) -> DataFrame:
    """Every row's figures and verdict: (doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, boilerplate_words).

    A null text has no words (and so fails the base rules); a null host is the
    host of all rows without one; repeated rows are judged alike, and count
    once as they are one document, copies under other ids count each; a line that exactly as many
    hold as the limit says stays; an empty table gives no rows. ``boilerplate_words`` are the words of the lines that go.
    """
    facts = cut(line_facts(docs, key, host, text).withColumn("_row", F.monotonically_increasing_id()), "line-facts")
    lines = facts.select("_row", F.coalesce("host", F.lit("")).alias("host"), F.explode("lines").alias("line")).select("_row", "host", "line.h1", "line.h2", "line.words")
    gone = lines.join(boilerplate(facts, share, texts), ["host", "h1", "h2"], "left_semi").groupBy("_row").agg(F.sum("words").alias("_gone"))
    out = facts.drop("host", "text_hash", "lines").join(gone, "_row", "left").withColumn("boilerplate_words", F.coalesce("_gone", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~failed & (F.col("boilerplate_words") < depleted * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "boilerplate_words")


def without_boilerplate(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", share: float = LINE_SHARE, texts: int = LINE_TEXTS) -> DataFrame:
    """All rows and columns, with ``text`` rid of boilerplate lines. Each document gets the hashes of
    its own lines that go (host, id and text hash join them), never a host's whole list. A null text stays
    null, repeated rows lose the same lines, an empty table gives no rows."""
    place, gone = spare(docs, "_place"), spare(docs, "_gone")
    where = lambda i, h, t: F.struct(F.coalesce(i, F.lit(NULL_ID)).alias("i"), F.coalesce(h, F.lit("")).alias("h"), t.alias("t")).alias(place)
    facts = cut(line_facts(docs, key, host, text), "line-facts")
    lines = facts.select(where(F.col("doc_id"), F.col("host"), F.col("text_hash")), F.coalesce("host", F.lit("")).alias("host"), F.explode("lines").alias("line")).select(place, "host", "line.h1", "line.h2")
    own = lines.join(boilerplate(facts, share, texts), ["host", "h1", "h2"], "left_semi").groupBy(place).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    joined = docs.withColumn(place, where(F.col(key).cast("long"), F.col(host).cast("string"), F.xxhash64(text_of(text)))).join(own, place, "left")
    names, at, schema = docs.columns, docs.columns.index(text), docs.schema

    def strip(value: str, drop: set[tuple[int, int]]) -> str:
        raw = np.frombuffer(value.encode(), np.uint8)
        offsets = np.array([0, len(raw)])
        heads, _, _, _, keys = line_keys(raw, offsets, Words(raw, offsets))
        number = np.append(0, np.cumsum(raw == 10))[heads]
        out = {n for n, *k in zip(number.tolist(), *(x.view(np.int64).tolist() for x in keys)) if tuple(k) in drop}
        return "\n".join(line for n, line in enumerate(value.split("\n")) if n not in out)

    def run(batches):
        for batch in batches:
            found = [t if t is None or not g else strip(t, {(x["h1"], x["h2"]) for x in g}) for t, g in zip(batch.column(text).to_pylist(), batch.column(gone).to_pylist())]
            yield batch.select(names).set_column(at, pa.field(text, pa.string()), pa.array(found, pa.string()))

    return joined.select(*[F.col(f"`{c}`") for c in names], F.col(gone)).mapInArrow(run, schema)
