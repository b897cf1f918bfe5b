"""Best-fit packing of token sequences by hierarchical residual packing.

``token_pieces`` turns documents into pieces of at most ``capacity`` token
ids; ``pack`` places items of any table with a length into sequences:

1. Every partition packs its own items, longest first, into the fullest
   sequence that still has room (best fit), and emits nearly full sequences.
2. What is left over -- underfull sequences -- become items themselves. They
   are merged in fewer, larger groups (a tree of ``fan_in``) and packed best-fit
   again, until one group is left or a round no longer closes sequences.

Only (sequence, used tokens) rows travel between the rounds, never tokens; a
piece's place is its place in the first sequence plus the shift of that
sequence. A group holds at most ``group_items`` sequences: where more are
underfull (as when all items are longer than half the capacity, which no
packing can join), a level has more groups, so no task grows with the input.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, cut, ints, text_of

CAPACITY = 4096
END_ID = 1
#: A sequence with at most this many free tokens is emitted at once.
NEARLY_FULL = 8
_CACHE_WORDS = 1 << 20
_SLICE_BYTES = 1 << 20
_BREAK = "\x00"
_TOKENIZERS: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids by white-space word, kept for words seen before.

    The vocabulary's normaliser and splitter never join characters across
    ASCII white space (where ``Words`` cuts), so a text's ids are its words'
    ids one after another. Words are known by two 64-bit hashes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # by key
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each word has; many words go in one text:
        ``_BREAK`` between spaces is always one id of its own. A word that holds it goes alone."""
        encode = lambda text: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        (mark,) = encode(_BREAK)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for alone, group in itertools.groupby(words, lambda w: _BREAK in w):
            part = list(group)
            for i in range(0, len(part), n := 1 if alone else 512):
                found = encode(f" {_BREAK} ".join(part[i:i + n]))
                marks = np.flatnonzero(found == mark) if not alone else np.zeros(0, np.int64)
                if not alone and len(marks) != len(part[i:i + n]) - 1:
                    raise ValueError("the tokenizer's break id is not its own")
                ids.append(np.delete(found, marks))
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        ids, size = self.ids_of(words)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.keys = np.concatenate([self.keys, keys])
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.checks = self.keys[by], np.concatenate([self.checks, checks])[by]
        self.at, self.size = np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more entry ends the last)."""
        words = Words(data, offsets)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.keys) > _CACHE_WORDS:
            self.clear()
        one, two = self.hashes(words)
        keys, first, back = np.unique(one, return_index=True, return_inverse=True)
        checks = two[first]
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if (checks[back] != two).any() or (self.checks[place[known]] != checks[known]).any():
            return self._encode_plainly(data, words)  # two words share the first hash
        if not known.all():
            fresh = np.flatnonzero(~known)
            spans = zip(words.start[first[fresh]].tolist(), words.end[first[fresh]].tolist())
            self.learn(keys[fresh], checks[fresh], [data[a:b].tobytes().decode() for a, b in spans])
            place = np.searchsorted(self.keys, keys)
        size = self.size[place][back]
        ends = np.cumsum(size)
        at = self.at[place][back] - (ends - size)
        return self.ids[np.repeat(at, size) + np.arange(ends[-1])], np.append(0, ends)[words.first]

    @staticmethod
    def hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
        return words.hashes(), words.hashes(1)

    def _encode_plainly(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with the words themselves as keys and nothing kept."""
        spans = [data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist())]
        place = {w: i for i, w in enumerate(dict.fromkeys(spans))}
        ids, size = self.ids_of([w.decode() for w in place])
        which = np.fromiter(map(place.__getitem__, spans), np.int64, len(spans))
        at, ends = (np.cumsum(size) - size)[which], np.cumsum(size[which])
        return ids[np.repeat(at - (ends - size[which]), size[which]) + np.arange(ends[-1])], np.append(0, ends)[words.first]


def tokenizer_of(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document's ids are its text's ids and ``end_id``; a null or empty text
    is ``end_id`` alone. Longer documents are cut every ``capacity`` ids.
    ``ids`` (little-endian unsigned 32-bit) is given if ``with_ids``; a null
    doc_id stays null; repeated rows give repeated pieces.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        words = tokenizer_of(tokenizer)
        for batch, data, offsets in chunks(batches, size=_SLICE_BYTES):
            rows: list[tuple] = []
            ids, at = words.encode(data, offsets)
            at = at.tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    raw = own[start:start + capacity].tobytes()
                    rows.append((doc, k, start, len(raw) // 4, zlib.crc32(raw), raw))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, ddl)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' used lengths. Longest first;
    each goes to the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rooms: list[int] = []  # free lengths that some bin has, ascending
    by_room: dict[int, list[int]] = {}
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        j = bisect.bisect_left(rooms, n)
        if j < len(rooms):
            room = rooms[j]
            have = by_room[room]
            b = have.pop()
            if not have:
                del by_room[room], rooms[j]
        else:
            b, room = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if (left := room - n) > 0:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets, np.array(used, np.int64)


def _level(items: DataFrame, capacity: int, level: int, nearly_full: int) -> DataFrame:
    """Best fit inside each partition of ``items`` (item, length): (item, bin, shift, used, full)."""
    schema = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("shift", pa.int64()), ("used", pa.int64()), ("full", pa.bool_())])

    def run(batches):
        from pyspark import TaskContext

        parts = [(ints(b, "_item"), ints(b, "_length")) for b in batches]
        if not parts:
            return
        item, length = (np.concatenate(x) for x in zip(*parts))
        bins, offsets, used = best_fit(length, capacity)
        base = (level << 58) | (TaskContext.get().partitionId() << 34)
        full = used >= capacity - nearly_full
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, bins + base, offsets, used[bins], full[bins])], schema=schema)

    return items.mapInArrow(run, "item long, bin long, shift long, used long, full boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, item: str = "item", length: str = "length", group_items: int = 1_000_000, fan_in: int = 16, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Place items in sequences: (item, sequence_id, offset).

    ``item`` must be a unique long. Each partition of ``items`` is a first
    group; each level's groups hold at most ``group_items``. Items of length 0
    or over ``capacity`` and nulls are an error of the caller and fail.
    """
    fits = F.col(length).between(1, capacity)
    given = items.select(F.col(item).cast("long").alias("_item"), F.when(fits, F.col(length).cast("long")).otherwise(F.raise_error(F.lit("an item's length must be 1 to the capacity"))).alias("_length"))
    placed = cut(_level(given, capacity, 0, nearly_full), "pack0")
    where = placed.select("item", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
    groups = placed.select(F.spark_partition_id().alias("p")).distinct().count()
    level, bins, moved = 0, placed, None
    while True:
        level += 1
        open_bins = cut(bins.where(~F.col("full")).select(F.col("bin").alias("_item"), F.col("used").alias("_length")).distinct(), f"pack-open{level}")
        n = open_bins.count()
        if n < 2:
            break
        groups = max(-(-n // group_items), groups // fan_in, 1)
        # a hash deals long and short ones evenly over the groups
        bins = cut(_level(open_bins.repartition(groups, F.xxhash64("_item", F.lit(level))), capacity, level, nearly_full), f"pack{level}")
        step = bins.select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("shift").alias("_shift"))
        moved = step if moved is None else cut(_compose(moved, step), f"pack-moved{level}")
        # a round that joins nothing may only have dealt unluckily, as long as there were more groups than needed
        if groups == 1 or groups == -(-n // group_items) and bins.select("bin").distinct().count() == n:
            break
    if moved is None:
        return where
    out = where.join(moved, where.sequence_id == moved["_from"], "left")
    return out.select("item", F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """Moves of ``first`` followed by those of ``then``; both (_from, _to, _shift)."""
    a, b = first.alias("a"), then.alias("b")
    return a.join(b, F.col("a._to") == F.col("b._from"), "left").select(
        F.col("a._from").alias("_from"), F.coalesce("b._to", "a._to").alias("_to"), (F.col("a._shift") + F.coalesce("b._shift", F.lit(0))).alias("_shift"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all documents with their sequence and place:
    (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Nulls: a null text counts as empty, a null doc_id stays null. An empty
    table gives no rows; repeated rows are packed each.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("_piece_key", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces, capacity, "_piece_key", "length", **options)
    return pieces.join(places, pieces["_piece_key"] == places["item"]).drop("item", "_piece_key")
