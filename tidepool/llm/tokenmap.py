"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Texts are shuffled by their full (compressed) text and counted, so that
   copies are one row with a multiplicity.
2. Each distinct text is encoded by both tokenizers and its tokens are aligned
   at the byte offsets where both have one end. A task works on chunks of some
   MiB of text; a chunk gives a row per text with its measures, a row per
   distinct id pair with its links in the chunk (times multiplicity), and the
   places of its texts' pairs as one compressed value.
3. Spark adds up the pairs of all chunks, finds the highest count of each B id,
   and sends the counts back to the chunks that asked; there they are summed per text.
4. Measures are joined to the documents by the text's SHA-256.

Encoding and alignment go by *unit*: the text after one space in front is cut
before every space that follows a character which is no white space. Neither
tokenizer joins characters across such a cut (A's splitter starts a new piece
there, no piece of B has a space behind another character, which is checked
when it is loaded), so ids of a text are those of its units in turn, and units seen
before need no work. Units are compared byte by byte, not by hash.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, squeezed, unsqueezed

#: Text of one chunk, and of the slices whose group texts are written at once.
CHUNK_BYTES, SLICE_UNITS = 6 << 20, 1 << 17
#: A worker forgets its units beyond so many, or so many bytes of them.
KEPT_UNITS, KEPT_BYTES = 600_000, 32 << 20
_LEARN = 4096

ROWS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("place", pa.int32()), ("key", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
ROWS_DDL = "kind int, chunk long, place int, key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long, body binary"
TEXT, BODY, PAIR = 0, 1, 2
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_TABLES: dict[tuple[str, str], "Units"] = {}


def flat(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``at[0], at[0] + 1, ..`` (``size[0]`` of them), then those of ``at[1]``, and so on."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """A list of byte strings in one array."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        return self.data[flat(self.at[which], self.size[which])]


def byte_level(entries: dict[str, int]) -> list[bytes]:
    """The bytes of the entries of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else b""
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of the pieces of a piece vocabulary with byte fallback."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece has a space behind another character: texts can't be cut into units")
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Units:
    """What is known of each unit seen: tokens, groups, links and their pairs."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a, self.bytes_b = Pieces(byte_level(self.a.get_vocab())), Pieces(piece_bytes(self.b))
        self.digits = Pieces([f"{i},".encode() for i in range(max(len(self.bytes_a.size), len(self.bytes_b.size)))])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        #: by unit: n_a, n_b, n_groups, n_links, and 0 if its tokens' bytes are not its own
        self.facts = np.zeros((0, 5), np.int64)
        self.text_at, self.pair_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.text, self.pairs = np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def of(self, units: list[bytes]) -> np.ndarray:
        """Places of distinct units; those not seen before are encoded."""
        if len(self.index) > KEPT_UNITS or self.held > KEPT_BYTES:
            self.clear()
        new = [u for u in units if u not in self.index]
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def _learn(self, units: list[bytes]) -> None:
        found = []
        for i in range(0, len(units), _LEARN):
            some = units[i:i + _LEARN]
            texts = [u.decode() for u in some]
            ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            found.append(self.align(some, ids_a, self.b.encode([t[1:] for t in texts], num_threads=1)))
        facts, text, text_size, pairs, pair_size = (np.concatenate(x) for x in zip(*found))
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units))))
        self.held += sum(map(len, units))
        self.facts = np.concatenate([self.facts, facts])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(text_size)])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(pair_size)])
        self.text, self.pairs = np.concatenate([self.text, text]), np.concatenate([self.pairs, pairs])

    def align(self, units: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]):
        """Facts, group texts (closed by ``;``) and pairs (B id * 2**32 + A id) of all links of each unit."""
        n = len(units)
        count_a, count_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(count.sum())) for ids, count in ((ids_a, count_a), (ids_b, count_b)))
        of_a, of_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        own = Pieces(units)
        good = np.ones(n, bool)
        for ids, of, table in ((a, of_a, self.bytes_a), (b, of_b, self.bytes_b)):
            good &= np.bincount(of, weights=table.size[ids], minlength=n).astype(np.int64) == own.size
        for ids, of, table in ((a, of_a, self.bytes_a), (b, of_b, self.bytes_b)):
            fits = np.flatnonzero(good)
            differ = table.joined(ids[good[of]]) != own.joined(fits)
            good[fits[np.searchsorted(np.cumsum(own.size[fits]), np.flatnonzero(differ), side="right")]] = False
        a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
        # byte offsets over the good units one after another
        ends_a, ends_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        shared = ends_a[np.isin(ends_a, ends_b, assume_unique=True, kind="table")] if len(ends_a) else ends_a
        cuts = np.sort(np.concatenate([ends_a, ends_b[~np.isin(ends_b, shared, assume_unique=True, kind="table")]])) if len(ends_a) else ends_a
        link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        group_of = of_a[np.searchsorted(ends_a, shared)]
        per = lambda of: np.bincount(of, minlength=n)
        links = per(of_a[link_a])
        facts = np.stack([per(of_a), per(of_b), per(group_of), links, good], axis=1).astype(np.int64)
        # tokens in the order of the text of the groups
        tokens, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        tokens[at_a], tokens[at_b] = a, b
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        marks[at_a], marks[at_b] = np.where(last(group_a), ord("|"), ord(",")), np.where(last(group_b), ord(";"), ord(","))
        text = self.digits.joined(tokens).copy()
        sizes = self.digits.size[tokens]
        text[np.cumsum(sizes) - 1] = marks
        of = np.empty(len(tokens), np.int64)
        of[at_a], of[at_b] = of_a, of_b
        text_size = np.bincount(of, weights=sizes, minlength=n).astype(np.int64)
        return facts, text, text_size, b[link_b] << 32 | a[link_a], links


def units_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts (not empty), and where each text's begin (one more entry ends the last)."""
    data = np.frombuffer(b" ".join([b"", *texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    # a character before a space: no white space of A's splitter, whose list is White_Space of Unicode
    b1, b2, b3 = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) for k in (1, 2, 3))
    wide = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
    wide |= (b3 == 0xE2) & ((b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)) | (b2 == 0x81) & (b1 == 0x9F))
    begin = (data == 32) & (b1 > 32) & (b1 != 127) & ~wide
    begin[ends - 1] = False  # a space that ends its text stays with the unit before
    begin[ends - sizes] = True
    starts = np.flatnonzero(begin)
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.append(np.searchsorted(starts, ends - sizes), len(starts))


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Body:
    """Where the pairs of a chunk's texts are: ``units`` (places in the chunk) of text t are those
    from ``first[t]`` on; the pairs of unit u are ``pairs`` from ``pair_first[u]`` on."""

    def __init__(self, first, units, pair_first, pairs):
        self.parts = [np.diff(first), units, np.diff(pair_first), pairs]

    def packed(self) -> bytes:
        return struct.pack("<4Q", *map(len, self.parts)) + zstandard.ZstdCompressor(level=3).compress(b"".join(map(_planes, self.parts)))

    @staticmethod
    def sums(body: bytes, counts: np.ndarray) -> np.ndarray:
        """For each text the sum of ``counts`` (by pair) over its links."""
        sizes = struct.unpack_from("<4Q", body)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[32:]), np.uint8)
        edges = 4 * np.cumsum([0, *sizes])
        size, units, pair_size, pairs = (_unplaned(raw[a:b], n) for a, b, n in zip(edges, edges[1:], sizes))
        total = lambda of, values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(of)])])
        return total(size, total(pair_size, counts[pairs])[units])


def align_texts(distinct: DataFrame, byte_path: str, piece_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of all chunks (``ROWS``) from distinct texts (text compressed, copies)."""

    def chunk(table: Units, number: int, texts: list[bytes], copies: np.ndarray):
        values, first = units_of(texts)
        coded = values.dictionary_encode()
        known, local = table.of(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(table.facts[known][local], axis=0)])
        facts = np.diff(sums[first], axis=0)
        good = facts[:, 4] == np.diff(first)
        facts[~good] = 0
        shas = []
        size = (table.text_at[known + 1] - table.text_at[known])[local]
        at = table.text_at[known][local]
        t = 0
        while t < len(texts):
            to = max(t + 1, int(np.searchsorted(first, first[t] + SLICE_UNITS, side="right")) - 1)
            part = slice(first[t], first[to])
            data = memoryview(table.text[flat(at[part], size[part])])
            ends = np.concatenate([[0], np.cumsum(size[part])])[first[t:to + 1] - first[t]].tolist()
            shas += [hashlib.sha256(data[a:b - 1]).hexdigest() if ok else "" for a, b, ok in zip(ends, ends[1:], good[t:to].tolist())]
            t = to
        weight = np.zeros(len(known), np.int64)
        np.add.at(weight, local, np.repeat(np.where(good, copies, 0), np.diff(first)))
        n_pairs = table.pair_at[known + 1] - table.pair_at[known]
        pairs, place = np.unique(table.pairs[flat(table.pair_at[known], n_pairs)], return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, place, np.repeat(weight, n_pairs))
        body = Body(first, local, np.concatenate([[0], np.cumsum(n_pairs)]), place)
        keys = [hashlib.sha256(x).hexdigest() for x in texts]
        yield rows(TEXT, number, place=np.arange(len(texts)), key=keys, groups_sha256=shas, **dict(zip(MEASURES, facts.T)))
        yield rows(BODY, number, body=[body.packed()])
        yield rows(PAIR, number, place=np.arange(len(pairs)), pair=pairs, n=n)

    def rows(kind: int, number: int, **columns):
        n = len(next(iter(columns.values())))
        columns |= {"kind": [kind] * n, "chunk": [number] * n}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ROWS], schema=ROWS)

    def run(batches):
        from pyspark import TaskContext

        if (byte_path, piece_path) not in _TABLES:
            _TABLES[byte_path, piece_path] = Units(byte_path, piece_path)
        table, number = _TABLES[byte_path, piece_path], TaskContext.get().partitionId() << 32
        texts, copies, held = [], [], 0
        for batch in batches:
            for blob, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts += unsqueezed([blob])
                copies.append(n)
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield from chunk(table, number, texts, np.array(copies, np.int64))
                    number, texts, copies, held = number + 1, [], [], 0
        if texts:
            yield from chunk(table, number, texts, np.array(copies, np.int64))

    return distinct.mapInArrow(run, ROWS_DDL)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): all links of each id pair, and whether no pair of the same B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("_b", F.shiftright("pair", 32))
    top = counts.groupBy("_b").agg(F.max("n").alias("_top"))
    return counts.join(top, "_b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``byte_path`` is a byte-level vocabulary (A, given a space and the text),
    ``piece_path`` a piece vocabulary that puts the space itself (B). A text
    that is null, empty, or not given back byte by byte by either has no tokens:
    zeros and an empty string. Repeated rows get a row each and count each; a
    null doc_id stays null; an empty table gives no rows; columns other than doc_id and
    text are not read.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text") != "")
    distinct = squeezed(texts).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    made = cut(align_texts(distinct, byte_path, piece_path, chunk_bytes), "aligned")
    pairs = made.where(F.col("kind") == PAIR).select("chunk", "place", "pair", "n")
    asked = pairs.select("chunk", "place", "pair").join(pair_counts(pairs), "pair").select(F.col("chunk").alias("asked_by"), F.col("place").alias("asked_place"), "n", "best")
    own = made.where(F.col("kind") != PAIR).select("kind", "chunk", "place", "key", *MEASURES[:4], "groups_sha256", "body")
    schema = pa.schema([("key", pa.string()), *[(m, pa.int64()) for m in MEASURES], ("groups_sha256", pa.string())])

    def summed(mine: pa.Table, found: pa.Table) -> pa.Table:
        kind = mine["kind"].to_numpy()
        body = mine["body"][int(np.flatnonzero(kind == BODY)[0])].as_py()
        rows = mine.filter(pa.array(kind == TEXT))
        place = found["asked_place"].to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = found["n"].to_numpy(), found["best"].to_numpy().astype(np.int64)
        at, has = rows["place"].to_numpy(), rows["n_links"].to_numpy() > 0
        more = [np.where(has, Body.sums(body, v)[at], 0) for v in (n * best > 0, n)]
        return pa.table([rows["key"], *[rows[m] for m in MEASURES[:4]], *map(pa.array, more), rows["groups_sha256"]], schema=schema)

    ddl = "key string, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string"
    measures = own.groupBy("chunk").cogroup(asked.groupBy("asked_by")).applyInArrow(summed, ddl)
    out = docs.select("doc_id", F.sha2(F.col("text").cast("string"), 256).alias("key")).join(measures, "key", "left")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
