"""Keys seen before, across runs (DED-5, DED-6).

A membership filter for an expected number of keys ``n`` and a false-positive
rate ``fpp`` is a table of bit sets, one per block of 32,768 bits: a key's hash picks
the block, and ``k`` positions inside it (double hashing). Spark builds and merges
the bit sets with ``bitmap_construct_agg`` and ``bitmap_or_agg``, so filters of any size are built
without a task that holds one whole. :class:`SeenKeys` keeps a filter and the exact
keys as tables between runs until a reset: rows the filter has not seen are new without
further work; only those it may have seen are checked against the keys. :class:`UniqueCount` keeps
the number of distinct keys as one mergeable sketch per batch.

Null keys are keys like others and equal each other.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import key_texts
from ..session import fs_delete, fs_list, write_once
from .dedup import dedup_by_key

BLOCK_BITS = 32_768  # of one bitmap of Spark's bitmap functions
# Expected keys and false-positive rate where none is given.
DEFAULT_N, DEFAULT_FPP = 1000, 0.01
#: Filters up to this size are sent to all tasks, larger ones are joined by block.
BROADCAST_BYTES = 64 << 20


class FilterSize(NamedTuple):
    blocks: int
    hashes: int

    @property
    def bytes(self) -> int:
        return self.blocks * BLOCK_BITS // 8


def filter_size(n: int = DEFAULT_N, fpp: float = DEFAULT_FPP) -> FilterSize:
    """``-n ln p / ln(2)^2`` bits and ``bits / n ln 2`` hashes, in whole blocks. Blocks differ in
    how many keys they get, which costs a little of the rate: three percent more bits make up for it."""
    n = n if n > 0 else DEFAULT_N
    fpp = fpp if 0 < fpp < 1 else DEFAULT_FPP
    bits = math.ceil(-n * math.log(fpp) / math.log(2) ** 2)
    return FilterSize(max(1, math.ceil(bits * 1.03 / BLOCK_BITS)), max(1, math.ceil(bits / n * math.log(2))))


def _block(key: Column, size: FilterSize) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(size.blocks))


def _positions(key: Column, size: FilterSize) -> Column:
    """Places of a key's bits in its block: an odd step reaches all of them."""
    first, step = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return F.transform(F.sequence(F.lit(0), F.lit(size.hashes - 1)), lambda i: F.pmod(first + i * step, F.lit(BLOCK_BITS)))


def build_filter(df: DataFrame, keys: list[str], size: FilterSize) -> DataFrame:
    """DED-5: the filter of the keys in ``df``: (block, bits). Repeated keys cost nothing in the
    shuffle: bit sets are combined where the rows lie."""
    key = F.col("_key")
    at = df.select(key_texts(*keys).alias("_key")).select(_block(key, size).alias("block"), F.explode(_positions(key, size)).alias("_at"))
    return at.groupBy("block").agg(F.bitmap_construct_agg("_at").alias("bits"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """The filter of the keys of all ``filters`` (of one size)."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def mark_seen(df: DataFrame, keys: list[str], held: DataFrame, size: FilterSize, name: str = "maybe") -> DataFrame:
    """DED-5: ``df`` with a column that is false for rows whose key is surely not in the filter."""
    key = F.col("_key")
    rows = df.withColumn("_key", key_texts(*keys)).withColumn("_block", _block(key, size))
    bits = held.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    joined = rows.join(F.broadcast(bits) if size.bytes <= BROADCAST_BYTES else bits, "_block", "left")
    # byte p / 8 of the bit set holds bit p % 8
    is_set = lambda p: F.conv(F.hex(F.substring(F.col("_bits"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), F.pmod(p, F.lit(8))).cast("int")) != 0
    maybe = F.col("_bits").isNotNull() & F.forall(_positions(key, size), is_set)
    return joined.withColumn(name, maybe).select(*[F.col(f"`{c}`") for c in df.columns], name)


class SeenKeys:
    """DED-5: the keys seen since the last reset, kept in ``home`` (a folder on any file system).

    ``n`` and ``fpp`` size the filter; more keys than ``n`` make it less sharp, never
    wrong. State is a list of commits, each created in one step: a reset begins a new epoch; a
    batch adds its new keys and the filter that includes them. A batch id that is
    committed already adds nothing, so a replay is harmless.
    """

    def __init__(self, spark: SparkSession, home: str, keys: list[str], n: int = DEFAULT_N, fpp: float = DEFAULT_FPP):
        self.spark, self.home, self.keys, self.size = spark, home.rstrip("/"), keys, filter_size(n, fpp)

    def _commits(self) -> list[dict]:
        """Commits of the current epoch, in order."""
        names = sorted((f for f, is_dir in fs_list(self.spark, f"{self.home}/commits") if not is_dir and f.endswith(".json") and not f.startswith(".")), key=lambda f: int(f[:-5]))
        rows = self.spark.read.schema("number long, batch string, folder string").json([f"{self.home}/commits/{f}" for f in names]).collect() if names else []
        found = sorted((r.asDict() for r in rows), key=lambda r: r["number"])
        last = max((i for i, r in enumerate(found) if r["batch"] is None), default=-1)
        return found[last + 1:]

    def _next(self) -> int:
        return max((int(f[:-5]) for f, is_dir in fs_list(self.spark, f"{self.home}/commits") if not is_dir and f.endswith(".json") and not f.startswith(".")), default=0) + 1

    def held(self) -> DataFrame | None:
        """The filter of all keys seen, or None."""
        commits = self._commits()
        return self.spark.read.parquet(f"{self.home}/{commits[-1]['folder']}/filter") if commits else None

    def seen(self) -> DataFrame | None:
        """The keys seen, exactly."""
        commits = self._commits()
        return self.spark.read.parquet(*[f"{self.home}/{c['folder']}/keys" for c in commits]) if commits else None

    def new_rows(self, df: DataFrame, order_by: list[str] | None = None, recheck: bool = True) -> DataFrame:
        """The first row (by ``order_by``) of each key of ``df`` that was not seen before.

        Without ``recheck`` rows that the filter takes for seen are dropped as they are: at most about
        ``fpp`` of the new keys are lost then, and the keys are not read.
        """
        first = dedup_by_key(df, self.keys, order_by)
        held = self.held()
        if held is None:
            return first
        marked = mark_seen(first, self.keys, held, self.size, "_maybe")
        sure = marked.where(~F.col("_maybe")).drop("_maybe")
        if not recheck:
            return sure
        tagged = marked.where("_maybe").drop("_maybe").withColumn("_key", key_texts(*self.keys))
        return sure.unionByName(tagged.join(self.seen().select("_key"), "_key", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns]))

    def add(self, df: DataFrame, batch: str) -> bool:
        """Add the keys of ``df``, rows that :meth:`new_rows` gave; False if ``batch`` was added before."""
        if any(c["batch"] == batch for c in self._commits()):
            return False
        number, folder = self._next(), f"batches/{uuid.uuid4().hex}"
        df.select(key_texts(*self.keys).alias("_key")).distinct().write.parquet(f"{self.home}/{folder}/keys")
        mine = self.spark.read.parquet(f"{self.home}/{folder}/keys").withColumnRenamed("_key", "k")
        built = mine.select(_block(F.col("k"), self.size).alias("block"), F.explode(_positions(F.col("k"), self.size)).alias("_at")).groupBy("block").agg(F.bitmap_construct_agg("_at").alias("bits"))
        held = self.held()
        (built if held is None else merge_filters(held, built)).write.parquet(f"{self.home}/{folder}/filter")
        if not write_once(self.spark, f"{self.home}/commits/{number}.json", json.dumps({"number": number, "batch": batch, "folder": folder})):
            raise RuntimeError(f"another writer changed {self.home}")
        return True

    def count(self) -> int:
        """Number of keys seen."""
        seen = self.seen()
        return 0 if seen is None else seen.distinct().count()

    def reset(self) -> None:
        """Forget all keys."""
        number = self._next()
        old = [c["folder"] for c in self._commits()]
        if not write_once(self.spark, f"{self.home}/commits/{number}.json", json.dumps({"number": number, "batch": None, "folder": None})):
            raise RuntimeError(f"another writer changed {self.home}")
        for folder in old:
            fs_delete(self.spark, f"{self.home}/{folder}")


class UniqueCount:
    """DED-6: how many distinct keys were seen since the last reset, over batches.

    Each batch is kept as one HyperLogLog sketch (``hll_sketch_agg``, a few KB whatever the
    batch's size) in a folder named by the batch, so a replay writes over itself; the count is
    the estimate of their union. Standard error: ``1.04 / sqrt(2 ** lg_k)`` at most.
    """

    def __init__(self, spark: SparkSession, home: str, keys: list[str], lg_k: int = 12):
        self.spark, self.home, self.keys, self.lg_k = spark, home.rstrip("/"), keys, lg_k

    def _epoch(self) -> int:
        return max((int(f[:-5]) for f, is_dir in fs_list(self.spark, f"{self.home}/epochs") if not is_dir and f.endswith(".json") and not f.startswith(".")), default=0)

    def _folder(self, epoch: int) -> str:
        return f"{self.home}/sketches/{epoch}"

    def add(self, df: DataFrame, batch: str) -> None:
        sketch = df.agg(F.hll_sketch_agg(key_texts(*self.keys), self.lg_k).alias("sketch"), F.count(F.lit(1)).alias("rows"))
        sketch.write.mode("overwrite").parquet(f"{self._folder(self._epoch())}/batch={batch}")

    def sketches(self) -> DataFrame:
        """(batch, sketch, rows) since the last reset; batches that were not written whole are left out."""
        path = self._folder(self._epoch())
        whole = [f for f, is_dir in fs_list(self.spark, path) if is_dir and any(n == "_SUCCESS" for n, _ in fs_list(self.spark, f"{path}/{f}"))]
        schema = "sketch binary, rows long, batch string"
        return self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{f}" for f in whole]) if whole else self.spark.createDataFrame([], schema)

    def count(self) -> DataFrame:
        """One row: (unique_keys, rows, batches)."""
        union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
        return self.sketches().agg(F.coalesce(union, F.lit(0)).cast("long").alias("unique_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("batches"))

    def reset(self) -> None:
        epoch = self._epoch()
        if write_once(self.spark, f"{self.home}/epochs/{epoch + 1}.json", "{}"):
            fs_delete(self.spark, self._folder(epoch))
