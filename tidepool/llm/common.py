"""Helpers shared by the operators of this subpackage: table reads, lineage
cuts, and vectorised word and n-gram hashing over Arrow string buffers.

A *word* everywhere is a run of bytes other than space and TAB..CR, which on
UTF-8 text is ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomial (mod 2**64, odd
base) prefix sums, so that the hash of any run of words costs two lookups;
the result is passed through a finaliser. Work is done in chunks of whole
documents of about ``CHUNK_BYTES`` (a longer document is a chunk of its own),
so memory follows the chunk, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import materialize

CHUNK_BYTES = 1 << 18
#: Rows of one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 500
#: Stands for a null document id inside an operator: it sorts before all others.
NULL_ID = -(1 << 63)

_BYTE_BASES, _WORD_BASES = (0x9E3779B97F4A7C15, 0x8CB92BA72F3D8DD7), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SLICE = 1 << 18
_KEPT_POWERS = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session options the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back."""
    return materialize(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def squeezed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with each text (not null) compressed on its own, which halves what it takes in a shuffle."""
    at = rows.columns.index(text)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            cuts = offsets.tolist()
            blobs = pa.array([pack.compress(data[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield batch.set_column(at, pa.field(text, pa.binary()), blobs)

    ddl = ", ".join(f"`{name}` {'binary' if name == text else kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, ddl)


def unsqueezed(blobs: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b) for b in blobs]


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` mod 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= _KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of runs of a sequence: ``of(i, j)`` covers elements ``i .. j - 1``."""

    def __init__(self, values: np.ndarray, base: int):
        self.inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.sums[j] - self.sums[i]) * self.inverse[i] + (j - i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def each(self, k: int) -> np.ndarray:
        """All runs of ``k`` elements."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n] + np.uint64(k * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)


class Words:
    """The words of some documents: byte positions in ``data`` and document index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        solid = np.ones(n + 2, bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = ~_SPACE[data]
        before, after = solid[:-2].copy(), solid[2:].copy()
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(solid[1:-1] & ~before)
        self.end = np.flatnonzero(solid[1:-1] & ~after) + 1
        #: words of document d are first[d] .. first[d + 1] - 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word (one of two), worked out over about ``_SLICE`` bytes at a time."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _SLICE, side="right")))
            at = self.start[i]
            runs = Runs(self.data[at: self.end[j - 1]].astype(np.uint64) + np.uint64(1), _BYTE_BASES[which])
            out[i:j] = mix(runs.of(self.start[i:j] - at, self.end[i:j] - at))
            i = j
        return out

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space behind each, and where each word begins (one more entry ends the last)."""
        lens = self.end - self.start + 1
        at = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=at[1:])
        if not len(lens):
            return np.zeros(0, np.uint8), at
        src = np.repeat(self.start - at[:-1], lens) + np.arange(at[-1])
        np.minimum(src, len(self.data) - 1, out=src)
        out = self.data[src]
        out[at[1:] - 1] = 32
        return out, at


def word_runs(hashes: np.ndarray, which: int = 0) -> Runs:
    return Runs(hashes, _WORD_BASES[which])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most ``size`` bytes of text (or one row), each with its bytes and offsets."""
    for batch in batches:
        at = 0
        col = batch.column(batch.schema.get_field_index(text))
        lens = np.concatenate([[0], np.cumsum(col_lengths(col))])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(lens, lens[at] + size, side="right")) - 1)
            part = batch.slice(at, to - at)
            yield (part, *buffers(part.column(batch.schema.get_field_index(text))))
            at = to


def col_lengths(col: pa.Array) -> np.ndarray:
    _, offsets = buffers(col)
    return np.diff(offsets)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string or binary array without nulls."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
