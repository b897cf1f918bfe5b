"""Load batches of a size or a time inside a micro-batch (STR-1).

The loader of the source system sends a batch when it holds ``max_rows`` records, or when
its clock ticks, whichever comes first. Here the rows of a micro-batch are cut the
same way by their order: contiguous load batches, each loaded and confirmed by a
mark of its own. The cut is written once before the first load, so that a micro-batch that comes
again after a stop is the same, and goes on at the first load batch without a mark. With many load batches
a load takes several at once, one job and one mark for all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.partitions import global_rank
from ..session import fs_delete, fs_exists, fs_list, write_once
from .stream import DEFAULT_MAX_ROWS

# Fixed value: seconds after which the loader sends what it holds.
DEFAULT_SECONDS = 5.0


def assign_load_batches(df: DataFrame, order_by: list[str], max_rows: int = DEFAULT_MAX_ROWS, arrival: str | None = None, seconds: float = DEFAULT_SECONDS, name: str = "load_batch") -> DataFrame:
    """STR-1: ``df`` with the number of each row's load batch, from 0, contiguous in ``order_by``
    (which should end in a unique column). With ``arrival`` (a time), a batch also ends at
    every tick of ``seconds`` after the first arrival; rows without a time come
    first, in batches of their own."""
    if arrival is None:
        return global_rank(df, order_by, "_r").withColumn(name, F.floor((F.col("_r") - 1) / max_rows).cast("long")).drop("_r")
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    ranked = global_rank(df.withColumn("_at", at), ["_at", *order_by], "_r")
    first = ranked.agg(F.min("_at").alias("_t0"))
    start = first.first()["_t0"]
    tick = F.when(F.col("_at").isNull(), F.lit(-1)).otherwise(F.floor((F.col("_at") - F.lit(start or 0)) / int(seconds * 1_000_000)))
    ranked = ranked.withColumn("_tick", tick.cast("long"))
    ticks = ranked.groupBy("_tick").agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per tick of a micro-batch
    before = F.coalesce(F.sum(F.ceil(F.col("_n") / max_rows)).over(Window.orderBy("_tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ticks = ticks.select("_tick", "_first", before.alias("_before"))
    numbered = ranked.join(ticks, "_tick").withColumn(name, (F.col("_before") + F.floor((F.col("_r") - F.col("_first")) / max_rows)).cast("long"))
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], name)


def _marks(spark: SparkSession, folder: str) -> set[int]:
    """Load batches with a mark: ``n.json`` is that of one, ``a-b.json`` that of a to b."""
    found = set()
    for f, is_dir in fs_list(spark, folder):
        ends = f[:-5].split("-")
        if not is_dir and f.endswith(".json") and len(ends) <= 2 and all(e.isdigit() for e in ends):
            found.update(range(int(ends[0]), int(ends[-1]) + 1))
    return found


def _wave(number: Column, most: int) -> Column:
    """The load that a load batch is part of: loads take 1, 2, 4, ... load batches until they take ``most`` (a power of two)."""
    doubling = F.length(F.bin(number + 1)) - 1
    return F.when(number < most - 1, doubling).otherwise(F.lit(most.bit_length() - 1) + F.floor((number - (most - 1)) / most)).cast("long")


def _wave_range(wave: int, most: int) -> tuple[int, int]:
    """First load batch of a load, and the one after its last."""
    grown = most.bit_length() - 1
    first = (1 << wave) - 1 if wave <= grown else most - 1 + (wave - grown) * most
    return first, first + min(1 << min(wave, grown), most)


def load_batches_sink(state: str, load: Callable, order_by: list[str], max_rows: int = DEFAULT_MAX_ROWS, arrival: str | None = None, seconds: float = DEFAULT_SECONDS, most: int = 1):
    """STR-1: a ``foreachBatch`` sink that calls ``load(rows, batch_id, load_batch)`` for one load batch after another.

    ``state`` holds the cut of the micro-batch at work (``pending``) and a mark per confirmed
    load. If ``load`` fails, or the job stops, the micro-batch comes again with the same id: its cut
    is read, not made anew, and marked load batches are passed over. A load that had been made but not
    marked is made again, so ``load`` should write over what it wrote under the same two numbers.

    With ``most`` (a power of two) over 1 one load takes several load batches, 1, 2, 4, ... up to
    ``most``: ``load(rows, batch_id, load_batches)`` gets a range of numbers and rows with their
    ``load_batch``, and its load batches are confirmed together.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most has to be a power of two")
    state = state.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pending, marks = f"{state}/pending/{batch_id}", f"{state}/marks/{batch_id}"
        if fs_exists(spark, f"{marks}/whole.json"):
            return
        if not fs_exists(spark, f"{pending}/_SUCCESS"):
            cut = assign_load_batches(batch, order_by, max_rows, arrival, seconds, "load_batch").withColumn("_wave", _wave(F.col("load_batch"), most))
            cut.write.mode("overwrite").partitionBy("_wave").parquet(pending)
        # a folder per load
        waves = sorted(int(f.split("=")[1]) for f, is_dir in fs_list(spark, pending) if is_dir and f.startswith("_wave="))
        rows = spark.read.parquet(pending)
        done, total = _marks(spark, marks), 0
        for wave in waves:
            mine = rows.where(F.col("_wave") == wave).drop("_wave")
            first, end = _wave_range(wave, most)
            if wave == waves[-1] and most > 1:
                end = mine.agg(F.max("load_batch")).first()[0] + 1
            total = end
            if first not in done:
                # its folder alone, also where the source's schema has no rows
                load(mine.drop("load_batch") if most == 1 else mine, batch_id, first if most == 1 else range(first, end))
                name = str(first) if end == first + 1 else f"{first}-{end - 1}"
                write_once(spark, f"{marks}/{name}.json", json.dumps({"batch_id": batch_id, "load_batch": first, "load_batches": end - first}))
        write_once(spark, f"{marks}/whole.json", json.dumps({"batch_id": batch_id, "load_batches": total}))
        fs_delete(spark, pending)

    return sink


def confirmed(spark: SparkSession, state: str) -> list[tuple[int, int]]:
    """(batch_id, load_batch) of all marks."""
    state = state.rstrip("/")
    return sorted((int(f), n) for f, is_dir in fs_list(spark, f"{state}/marks") if is_dir for n in _marks(spark, f"{state}/marks/{f}"))


def parquet_loader(target: str) -> Callable[[DataFrame, int, int], None]:
    """Loads into ``target/batch_id=<n>/load_batch=<m>``; a repeated load writes over the first."""
    def load(rows: DataFrame, batch_id: int, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch_id}/load_batch={number}")

    return load


#: Load batches of one load that Spark writes as one job.
MOST_AT_ONCE = 1024


def parquet_loader_of_many(target: str) -> Callable[[DataFrame, int, range], None]:
    """Loads several load batches at once into the folders of :func:`parquet_loader`; a repeated load writes
    over the first."""
    def load(rows: DataFrame, batch_id: int, numbers: range) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_batch").parquet(f"{target.rstrip('/')}/batch_id={batch_id}")

    return load
