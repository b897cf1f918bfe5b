"""Files that are one JSON array, read by many tasks (SRC-1).

The text source cuts a file at commas, wherever they stand, so a file of any size
is split like a text of lines. Runs of these fragments are kept as blocks of
text. What a block does to the state (inside a string or not, bracket depth) is worked out for
both ways it can begin; a prefix scan over one small row per block then gives
every block the state it begins in, and each is cut into the array's elements on its
own. Elements that reach over blocks are put together from their pieces.

An array file counts only as a whole: where a bracket is left open, text stands
outside the array or an element is no JSON value, all of its elements are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_BYTES = 1 << 18

_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[[ord("["), ord("{")]] = 1
_CLOSE[[ord("]"), ord("}")]] = 1
_BLOCKS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("modified", pa.int64()), ("seq", pa.int64()), ("body", pa.binary()), ("flips", pa.int32()), ("depth_out", pa.int64()), ("depth_in", pa.int64())])
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("place", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("piece", pa.string())])
#: Places of rows that are no pieces: the array begins, or something stands outside it.
_BEGINS, _OUTSIDE = -2, -1


def _quotes(data: np.ndarray) -> np.ndarray:
    """Quotes without an odd number of backslashes before them."""
    at = np.arange(len(data))
    solid = np.maximum.accumulate(np.where(data != ord("\\"), at, -1)) if len(data) else at
    before = np.concatenate([[-1], solid[:-1]])[:len(data)]  # last byte before that is no backslash
    return (data == ord('"')) & ((at - before) % 2 == 1)


def _in_string(data: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each byte stands in a string (its quotes too), given whether the text begins in one."""
    quote = _quotes(data)
    return ((np.cumsum(quote) + inside) % 2 == 1) | quote


def _depths(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Bracket depth behind each byte, from 0."""
    return np.cumsum(np.where(inside, 0, _OPEN[data] - _CLOSE[data]), dtype=np.int64)


def _blocks(fragments: DataFrame, size: int) -> DataFrame:
    """Blocks of (file, start, value) rows in file order, with their effect on the state."""

    def run(batches):
        where, seq, held, n = None, 0, [], 0

        def block():
            body = "".join(held).encode()
            data = np.frombuffer(body, np.uint8)
            ends = [int(_depths(data, _in_string(data, inside))[-1]) if len(data) else 0 for inside in (False, True)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*where, seq, body, int(_quotes(data).sum() % 2), *ends), _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for value, *source in zip(*(c.to_pylist() for c in batch.columns)):
                if source != where:
                    if held:
                        yield block()
                    where, seq, held, n = source, 0, [], 0
                    first = source[1] == 0
                else:
                    first = False
                if n >= size:
                    yield block()
                    seq, held, n = seq + 1, [], 0
                # the comma before a fragment; the first one of a file has none
                held.append(value if first else "," + value)
                n += len(value) + 1
        if held:
            yield block()

    return fragments.mapInArrow(run, "file string, start long, modified long, seq long, body binary, flips int, depth_out long, depth_in long")


def _entered(blocks: DataFrame) -> DataFrame:
    """(file, start, seq, inside, depth, _own) of each block: the state it begins in, and what it adds to
    the depth. By running sums over the blocks of a file, rows without text."""
    order = Window.partitionBy("file").orderBy("start", "seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2 == 1
    own = blocks.select("file", "start", "seq", "flips", "depth_out", "depth_in", inside.alias("inside")).withColumn("_own", F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out")))
    return own.select("file", "start", "seq", "flips", "inside", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("depth"), "_own")


def _pieces(blocks: DataFrame) -> DataFrame:
    """Pieces of elements: ``opens`` / ``closes`` tell whether the piece begins / ends its element."""

    def cut(body: bytes, inside: bool, depth: int):
        data = np.frombuffer(body, np.uint8)
        free = ~_in_string(data, inside)
        behind = depth + _depths(data, ~free)
        ahead = np.concatenate([[depth], behind[:-1]])[:len(data)]
        begins = free & (ahead == 0) & (behind == 1) & (data == ord("["))
        ends = free & (ahead == 1) & (behind == 0)
        commas = free & (ahead == 1) & (data == ord(","))
        # below the array, another bracket than the array's at its level
        outside = bool(((behind < 0) | free & (ahead == 0) & (behind == 1) & ~begins | ends & (data != ord("]"))).any())
        pieces = []
        left, opened, in_array = -1, False, depth >= 1
        for at in [*np.flatnonzero(begins | ends | commas).tolist(), len(data)]:
            closed = at < len(data) and not begins[at]
            if in_array:
                pieces.append((opened, closed, body[left + 1:at].decode()))
            elif body[left + 1:at].strip(b" \t\r\n"):
                outside = True
            left, opened = at, at < len(data) and not ends[at]
            in_array = opened
        return pieces, int(begins.sum()), outside

    def run(batches):
        for batch in batches:
            for file, start, seq, body, inside, depth in zip(*(c.to_pylist() for c in batch.columns)):
                pieces, begun, outside = cut(body, inside, depth)
                rows = [(file, start, seq, i, *p) for i, p in enumerate(pieces)]
                rows += [(file, start, seq, _BEGINS, False, False, None)] * begun + [(file, start, seq, _OUTSIDE, False, False, None)] * outside
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(_PIECES), _PIECES)], schema=_PIECES)

    return blocks.mapInArrow(run, "file string, start long, seq long, place long, opens boolean, closes boolean, piece string")


def array_elements(texts, block_bytes: int = BLOCK_BYTES, only: DataFrame | None = None) -> DataFrame:
    """Elements of array files as variants: (_source_file, _source_modified, _v).

    ``texts(**options)`` gives the text source's rows of the files for reader options, so that
    the caller's file options hold; ``only`` (a table of ``_source_file``) restricts them.
    """
    fragments = texts(lineSep=",").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.unix_micros(F.col("_metadata.file_modification_time")).alias("modified"))
    if only is not None:
        fragments = fragments.join(only.select(F.col("_source_file").alias("file")), "file", "left_semi").select("value", "file", "start", "modified")
    blocks = materialize(_blocks(fragments, block_bytes), "array-blocks")
    entered = materialize(_entered(blocks.drop("body")), "array-states")
    # files that end inside a string or a bracket are none; they are left before anything is put together
    closed = entered.groupBy("file").agg((F.sum("flips") % 2 == 0).alias("_even"), F.sum("_own").alias("_depth")).where("_even AND _depth = 0").select("file")
    states = entered.join(closed, "file", "left_semi").select("file", "start", "seq", "inside", "depth")
    pieces = materialize(_pieces(blocks.join(states, ["file", "start", "seq"]).select("file", "start", "seq", "body", "inside", "depth")), "array-pieces")
    text = pieces.where("place >= 0")
    whole = text.where("opens AND closes").select("file", "piece")
    chain = Window.partitionBy("file").orderBy("start", "seq", "place")  # at most two pieces per block
    parts = text.where("NOT (opens AND closes)").withColumn("_chain", F.sum(F.col("opens").cast("int")).over(chain))
    joined = parts.groupBy("file", "_chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "place", "piece"))), lambda p: p["piece"]), "").alias("piece"))
    elements = whole.unionByName(joined.select("file", "piece"))
    one = F.from_json(F.concat(F.lit("["), "piece", F.lit("]")), "array<variant>")
    blank = ~F.col("piece").rlike(r"[^ \t\r\n]")
    parsed = materialize(elements.withColumn("_one", one).select("file", F.when(F.size("_one") == 1, F.col("_one")[0]).alias("_v"), blank.alias("_blank")), "array-elements")
    marks = pieces.where("place < 0").groupBy("file").agg(F.count_if(F.col("place") == _BEGINS).alias("_begins"), F.count_if(F.col("place") == _OUTSIDE).alias("_outside"))
    state = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v").isNull() & ~F.col("_blank")).alias("_bad"), F.count_if("_blank").alias("_blanks"))
    # one array, nothing outside, every element a value; an array without elements is one blank piece
    good = state.join(marks, "file").where((F.col("_begins") == 1) & (F.col("_outside") == 0) & (F.col("_bad") == 0) & ((F.col("_blanks") == 0) | (F.col("_n") == 1)))
    files = blocks.groupBy("file").agg(F.timestamp_micros(F.max("modified")).alias("_source_modified")).join(good.select("file"), "file", "left_semi")
    return parsed.where(F.col("_v").isNotNull()).join(files, "file").select(F.col("file").alias("_source_file"), "_source_modified", "_v")
