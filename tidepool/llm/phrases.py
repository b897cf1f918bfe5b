"""Phrase collocations from external count streams.

A *window* is a word with the words behind it in its piece, as many as the
longest phrase has. Every word begins one window, so a phrase's count is the
number of windows it begins: one stream of windows in prefix order holds the
counts of all lengths.

1. Map tasks sort the windows of some MiB of text, add up equal ones and cut
   the sorted run into compressed blocks by splitters: keys of a bounded
   sample, as many as there are parts. They decide how evenly parts are
   filled, never what is counted.
2. A task reads the blocks of a part in order of their first window and merges
   them: what lies before the first window of the next block is final. Lockstep
   run lengths at every prefix length give the counts. A phrase that touches
   the edge of a merged section may go on in the next one, so its count is
   given as a part sum, whatever it is; all others below the least count end here.
3. Phrases met in sections are added up by Spark. The phrases of at least
   the least count are written as a table: the count stream. Joined with
   itself by sort-merge in prefix order it gives the counts of the first parts of
   each phrase, in suffix order those of the rests; the longest extension of a
   phrase by a word before or behind it is a maximum over the same streams.

No phrase, word or language is gathered in one task: equal windows are one
row of a run, and a frequent word's windows lie in as many parts as they fill.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, record, text_of

LONGEST = 4
LEAST = 30
CONTAINED = 80
TOP = 2000
NO_LANG = "und"
#: Keys that the splitters are chosen from: so many a part, and in all.
SAMPLE_KEYS, SAMPLE_IN_ALL = 200, 2_000_000
_SAMPLE_STEP = 50
_WORD_BYTES = 6  # about, to size the parts

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

RUNS = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("block", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


class Sizes(NamedTuple):
    """What tasks hold at once; results don't depend on it."""

    run_chars: int = 3 << 20  # text of one sorted run
    part: int = 1_000_000  # windows of a part, about
    block: int = 1 << 16  # windows of a block
    section: int = 1_000_000  # windows merged at once (twice what the last merge left over, if that is more)


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words, each with a tab behind it, and the number of the piece each stands in.
    A tab is in no word, so byte order of words and of windows agree."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    kind = _KIND[data]
    solid = kind == 0
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    if len(data) and solid[0]:
        starts = np.concatenate([[0], starts])
    piece = np.cumsum(kind == 2)[starts]
    solid[ends] = True
    packed = _LOWER[data[solid]]
    at = np.cumsum(ends - starts + 1)
    packed[at - 1] = 9
    offsets = np.concatenate([[0], at]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]), piece


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and each word's place there, from 1."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint32)


def windows_of(ids: np.ndarray, piece: np.ndarray, longest: int) -> list[np.ndarray]:
    """Columns of the windows: the word itself, the next one, ...; 0 behind the end of the piece."""
    out = [ids]
    for k in range(1, longest):
        col = np.zeros(len(ids), np.uint32)
        same = piece[k:] == piece[:-k]
        col[:max(len(ids) - k, 0)][same] = ids[k:][same]
        out.append(col)
    return out


def sort_order(cols: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by their columns, the first one first."""
    keys = []
    for i in range(0, len(cols), 2):
        key = cols[i].astype(np.uint64) << np.uint64(32)
        keys.append(key | cols[i + 1] if i + 1 < len(cols) else key)
    return np.lexsort(keys[::-1])


def changes(cols: list[np.ndarray]) -> list[np.ndarray]:
    """For each length of prefix, where a sorted row's differs from the one before."""
    out, change = [], np.zeros(len(cols[0]), bool)
    change[:1] = True
    for col in cols:
        change = change.copy()
        change[1:] |= col[1:] != col[:-1]
        out.append(change)
    return out


class Run:
    """Sorted distinct windows: ``vocab`` (words in byte order), ``cols`` (places there, from 1) and counts ``n``."""

    def __init__(self, vocab: pa.Array, cols: list[np.ndarray], n: np.ndarray):
        self.vocab, self.cols, self.n = vocab, cols, n

    def __len__(self) -> int:
        return len(self.n)

    @staticmethod
    def merged(words: pa.Array, cols_of, n: np.ndarray | None, longest: int, keys: list[bytes]) -> tuple["Run", np.ndarray]:
        """Sort and add up the windows that ``cols_of`` makes from the places of ``words`` in byte order
        (``n`` times each); also how many rows lie before each of the ascending ``keys``."""
        cut_words = [k.split(b"\t")[:-1] for k in keys]
        extra = [w + b"\t" for ws in cut_words for w in ws]
        vocab, ids = ranked(pa.concat_arrays([words, pa.array(extra, pa.large_binary())]))
        cols = cols_of(ids[:len(words)])
        n = np.ones(len(cols[0]), np.int64) if n is None else n
        marks = np.zeros((len(keys), longest), np.uint32)
        at = len(words)
        for row, ws in zip(marks, cut_words):
            row[:len(ws)] = ids[at:at + len(ws)]
            at += len(ws)
        order = sort_order([np.concatenate([marks[:, i], col]) for i, col in enumerate(cols)])
        is_mark = order < len(keys)
        places = np.flatnonzero(is_mark) - np.arange(len(keys))
        order = order[~is_mark] - len(keys)
        cols = [col[order] for col in cols]
        starts = np.flatnonzero(changes(cols)[-1])
        n = np.add.reduceat(n[order], starts) if len(starts) else n[:0]
        return Run(vocab, [col[starts] for col in cols], n), np.searchsorted(starts, places)

    def rows(self, a: int, b: int) -> "Run":
        """Rows a .. b - 1 with the words they hold."""
        cols = [col[a:b] for col in self.cols]
        used = np.zeros(len(self.vocab) + 1, bool)
        for col in cols:
            used[col] = True
        used[0] = False
        place = np.cumsum(used).astype(np.uint32)
        place[0] = 0
        place[~used] = 0
        return Run(self.vocab.filter(pa.array(used[1:])), [place[col] for col in cols], self.n[a:b])

    def key(self, i: int) -> bytes:
        return b"".join(self.vocab[int(col[i]) - 1].as_py() for col in self.cols if col[i])

    def packed(self) -> bytes:
        """The rows as one compressed value."""
        words = b"".join(self.vocab.to_pylist())
        first = np.diff(self.cols[0], prepend=np.uint32(0))
        planes = [np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for a in (first, *self.cols[1:])]
        planes.append(np.ascontiguousarray(self.n.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes())
        return struct.pack("<IQ", len(self), len(words)) + zstandard.ZstdCompressor(level=3).compress(words + b"".join(planes))

    @staticmethod
    def unpacked(block: bytes, longest: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        """Words, columns and counts of a packed run."""
        n, size = struct.unpack_from("<IQ", block)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[12:]), np.uint8)
        words = raw[:size]
        offsets = np.concatenate([[0], np.flatnonzero(words == 9) + 1]).astype(np.int64)
        vocab = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(words)])
        cols = [np.ascontiguousarray(raw[size + 4 * n * i: size + 4 * n * (i + 1)].reshape(4, n).T).view("<u4").ravel() for i in range(longest)]
        cols[0] = np.cumsum(cols[0], dtype=np.uint32)
        counts = np.ascontiguousarray(raw[size + 4 * n * longest:].reshape(8, n).T).view("<i8").ravel().astype(np.int64)
        return vocab, cols, counts

    def phrases(self, least: int) -> Iterator[tuple[str, int, int]]:
        """(phrase, words, count) of every prefix of at least ``least`` windows, and of those
        that the first or last row begins with; as no words, the number of windows."""
        yield "", 0, int(self.n.sum())
        for k, change in enumerate(changes(self.cols), 1):
            starts = np.flatnonzero(change)
            n = np.add.reduceat(self.n, starts)
            keep = n >= least
            keep[[0, -1]] = True
            keep &= self.cols[k - 1][starts] != 0
            at = starts[keep]
            words = [self.vocab.take(pa.array(col[at] - 1)).to_pylist() for col in self.cols[:k]]
            for phrase, count in zip(zip(*words), n[keep].tolist()):
                yield b"".join(phrase)[:-1].replace(b"\t", b" ").decode(), k, count


def _texts(batches, size: int) -> Iterator[dict[str, list[str]]]:
    """Texts by language, about ``size`` characters at a time."""
    held: dict[str, list[str]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            n += len(text)
            if n >= size:
                yield held
                held, n = {}, 0
    if held:
        yield held


def splitters(texts: DataFrame, longest: int, part_windows: int) -> list[tuple[str, bytes]]:
    """Ascending (lang, window) keys that cut all windows into parts of about
    ``part_windows``, from a sample of the texts. They only balance the parts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (_WORD_BYTES * part_windows))
    if parts < 2:
        return []
    keys = min(SAMPLE_KEYS * parts, SAMPLE_IN_ALL)
    share = min(1.0, keys * _SAMPLE_STEP * _WORD_BYTES / size)

    def run(batches):
        for held in _texts(batches, 1 << 20):
            for lang, some in held.items():
                words, piece = words_of(some)
                cols = windows_of(np.arange(1, len(words) + 1, dtype=np.uint32), piece, longest)
                found = [b"".join(words[int(col[i]) - 1].as_py() for col in cols if col[i]) for i in range(0, len(words), _SAMPLE_STEP)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], ["lang", "key"])

    found = sorted((r[0], bytes(r[1])) for r in texts.where(F.rand(1) < share).mapInArrow(run, "lang string, key binary").collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def sorted_runs(texts: DataFrame, cuts: list[tuple[str, bytes]], longest: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Blocks of sorted runs of windows: (part, lang, first, block)."""

    def run(batches):
        for held in _texts(batches, sizes.run_chars):
            for lang, some in held.items():
                words, piece = words_of(some)
                if not len(words):
                    continue
                low = bisect.bisect_left(cuts, (lang, b""))
                high = bisect.bisect_left(cuts, (lang + "\x00", b""))
                whole, at = Run.merged(words, lambda ids: windows_of(ids, piece, longest), None, longest, [k for _, k in cuts[low:high]])  # noqa: B023
                edges = [0, *at.tolist(), len(whole)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    for c in range(a, b, sizes.block):
                        block = whole.rows(c, min(c + sizes.block, b))
                        yield record(RUNS, [low + i], [lang], [block.key(0)], [block.packed()])

    return texts.mapInArrow(run, "part int, lang string, first binary, block binary")


def merge_runs(blocks: DataFrame, longest: int, least: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Part sums (lang, phrase, words, n) from blocks that come part by part in order of their first window."""

    def run(batches):
        pool: list[tuple] = []
        held, limit, where = 0, sizes.section, None

        def section(key: bytes | None) -> Run | None:
            """Merge the pool; its rows before ``key`` (all, if None) come out, the others stay."""
            nonlocal pool, held
            sizes = np.cumsum([0] + [len(v) for v, _, _ in pool])
            cols = [np.concatenate([np.where(p[1][i] > 0, p[1][i] + np.uint32(s), np.uint32(0)) for p, s in zip(pool, sizes)]) for i in range(longest)]
            n = np.concatenate([p[2] for p in pool])
            words = pa.concat_arrays([p[0] for p in pool])
            pool = []
            place = lambda ids: [np.concatenate([[np.uint32(0)], ids])[col] for col in cols]
            whole, at = Run.merged(words, place, n, longest, [] if key is None else [key])
            end = len(whole) if key is None else int(at[0])
            if end < len(whole):
                rest = whole.rows(end, len(whole))
                pool = [(rest.vocab, rest.cols, rest.n)]
            held = len(whole) - end
            return whole.rows(0, end) if end else None

        def given(lang, done):
            if done is None:
                return
            rows = list(zip(*done.phrases(least)))
            yield record(COUNTS, [lang] * len(rows[0]), *rows)

        for batch in batches:
            for part, lang, first, block in zip(*(c.to_pylist() for c in batch.columns)):
                if where != (part, lang):
                    if pool:
                        yield from given(where[1], section(None))
                    pool, held, limit, where = [], 0, sizes.section, (part, lang)
                elif held >= limit:
                    yield from given(lang, section(first))
                    limit = max(sizes.section, 2 * held)
                pool.append(Run.unpacked(block, longest))
                held += len(pool[-1][2])
        if pool:
            yield from given(where[1], section(None))

    return blocks.mapInArrow(run, "lang string, phrase string, words int, n long")


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, sizes: Sizes = Sizes()) -> DataFrame:
    """The count stream: (lang, phrase, words, n) of all phrases of 1 to ``longest`` words
    that stand at least ``least`` times in pieces; with no words, the number of words of a language.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into
    pieces, these at spaces and tabs into words. A null text is empty, a null
    lang is ``und``; repeated rows count each.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_of().alias("text"))
    cuts = splitters(texts, longest, sizes.part)
    blocks = sorted_runs(texts, cuts, longest, sizes).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "lang", "first")
    sums = merge_runs(blocks, longest, least, sizes).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return cut(sums.where((F.col("words") == 0) | (F.col("n") >= least)), "phrases")


def _first(phrase, k):
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def score_phrases(stream: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """Candidates of a count stream with their lowest-scoring cut: (lang, phrase, a, l, r, score).

    A cut into the first words (l times) and the rest (r times) scores
    ``floor(2000000 a / (l + r))``; the lowest counts, of equals the first.
    Candidates are dropped that are part of a longer one with at least
    ``contained`` % of their count (as a longer phrase is nowhere more frequent
    than one inside it, those with one more word decide).
    """
    phrases = stream.where("words > 0").select("lang", "phrase", "words", F.col("n").alias("a"))
    cands, key = phrases.where("words > 1"), F.col("phrase")
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _first(key, F.col("k")).alias("_left"), _first(key, F.col("k") - F.col("words")).alias("_right"))
    left = phrases.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l")).hint("merge")
    right = phrases.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r")).hint("merge")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).withColumns({"_top": F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), "_sum": wide("l") + wide("r")})
    scored = both.withColumn("score", F.expr("cast(_top div _sum as bigint)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("_b")).select("lang", "phrase", "_b.a", "_b.l", "_b.r", "_b.score")
    longer = cands.where("words > 2").select("lang", "a", F.explode(F.array(_first(key, F.col("words") - 1), _first(key, 1 - F.col("words")))).alias("phrase"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer")).hint("merge")
    kept = best.join(longest, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (wide("_longer") * 100 < wide("a") * F.lit(contained)))
    return kept.select("lang", "phrase", "a", "l", "r", "score")


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score and count, descending, then phrase in
    byte order, with their ``rank`` from 1. First picked inside slices of a language, so that none is ranked whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = Window.partitionBy("lang", "_slice").orderBy(*order)
    some = scored.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(partitions(scored.sparkSession)))).withColumn("_r", F.row_number().over(slices)).where(F.col("_r") <= top)
    ranked_ = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked_.select("lang", "rank", "phrase", "a", "l", "r", "score")


def mine_phrases(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, contained: int = CONTAINED, sizes: Sizes = Sizes()) -> DataFrame:
    """The collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    See :func:`count_phrases`, :func:`score_phrases` and :func:`top_phrases`
    for what counts, the score and ties. Empty tables and texts give no rows;
    columns other than ``lang`` and ``text`` are not read.
    """
    stream = count_phrases(docs, longest, least, sizes)
    found = top_phrases(score_phrases(stream, contained), top)
    return found.join(stream.where("words = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
