"""Fixed-window admission per key (STR-5): a window opens at the first event of a
key, lasts a given time and admits the first ``limit`` events; the next event
after it opens a new one.

A window's start depends on the window before, so a key's events form a chain. The
batch form (:func:`admit`) sorts all events once by range over (key, time) and
walks every range on its own. Only a range's first key can depend on what came
before: on the start of the window that is open when the range begins. For that
key the range gives a step function from entry start to exit start. The functions are
composed over the ranges, which gives each range its entry start by one small
join; no key is handed to one task. The streaming form (:func:`admit_stream`)
keeps events in state until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..arrow import key_changes
from ..session import materialize

#: Ranges whose step functions one task composes.
RANGES_PER_BLOCK = 32


def admission_rejects(df: DataFrame, ts: str) -> DataFrame:
    """STR-5: events without a time; they belong to no window and are not admitted."""
    return df.where(F.col(ts).isNull()).withColumn("error", F.lit("event has no time"))


def _next_start(t: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """For each event the first one of its run at or after ``t + width`` (the place
    behind the run if none); ``run`` numbers the runs from 0, ``t`` ascends in each."""
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run))
    span = int(t.max()) - int(t.min()) + width + 1
    if span * (int(run[-1]) + 1) < 1 << 62:
        line = (t - t.min()) + run * span
        found = np.searchsorted(line, line + width, side="left")
    else:  # times too far apart to lay the runs on one line
        found = np.empty(len(t), np.int64)
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            found[a:b] = a + np.searchsorted(t[a:b], t[a:b] + width, side="left")
    return np.minimum(found, ends[run])


@dataclass
class Walk:
    """Windows of a sorted stream of events, batch by batch."""

    width: int
    key: object = None
    start: int | None = None  # of the open window
    used: int = 0
    #: events before the open window's start, counted from where ``seen`` began
    at: int = 0
    seen: int = 0

    def enter(self, key, start: int | None, used: int) -> None:
        self.key, self.start, self.used = key, start, used

    def step(self, keys: pa.Array, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window start and place (from 1) in the window of each event."""
        n = len(t)
        starts, places = np.empty(n, np.int64), np.empty(n, np.int64)
        change = key_changes(keys)
        run = np.cumsum(change) - 1
        same = self.start is not None and keys[0].as_py() == self.key
        nexts = _next_start(t, run, self.width)
        i = 0
        if same:  # the open window takes what it reaches of the first run
            first_run = int(np.searchsorted(run, 0, side="right"))
            i = min(int(np.searchsorted(t[:first_run], self.start + self.width, side="left")), first_run)
            starts[:i] = self.start
            places[:i] = self.used + np.arange(1, i + 1)
            self.used += i
        jump, opened = nexts.tolist(), []
        while i < n:
            opened.append(i)
            i = jump[i]
        if opened:
            at = np.array(opened, np.int64)
            sizes = np.diff(np.append(at, n))
            starts[at[0]:] = np.repeat(t[at], sizes)
            places[at[0]:] = np.arange(at[0], n) - np.repeat(at, sizes) + 1
            self.start, self.used, self.at = int(t[at[-1]]), int(sizes[-1]), self.seen + opened[-1]
        self.key = keys[n - 1].as_py()
        self.seen += n
        return starts, places


@dataclass
class Steps:
    """What a stretch of the sorted events does to the window that is open when it begins.

    ``first`` and ``last`` are its first and last key. If all its events have one key
    (``single``), an open window that started at or before ``bounds[j]`` (and after the
    bound before) leaves the one started at ``exits[j]``, event number ``places[j]`` of the stretch, open; one
    that started after all bounds stays open. Else ``exits[0]``, ``places[0]`` is
    the window open at its end, whatever came before.
    """

    n: int
    first: str | None
    last: str | None
    single: bool
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    exits: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @staticmethod
    def of_events(key, t: np.ndarray, width: int) -> "Steps":
        """The step function of events of one key."""
        n = len(t)
        nexts = _next_start(t, np.zeros(n, np.int64), width)
        last = np.where(nexts < n, nexts, np.arange(n))
        while True:  # pointer doubling: the last start of the chain from each event
            further = last[last]
            if (further == last).all():
                break
            last = further
        entries = last[:min(int(nexts[0]), n - 1) + 1]  # a window open before the first event ends before nexts[0]
        keep = np.append(entries[1:] != entries[:-1], True)
        ends = entries[keep]
        return Steps(n, key, key, True, t[:len(entries)][keep] - width, t[ends], ends)

    def entered(self, key, start: int | None) -> tuple[int, int] | None:
        """Start and place of the window open at the end, given the one open before
        (``start`` of ``key``, or None); None: that one is still open."""
        if not self.single:
            return int(self.exits[0]), int(self.places[0])
        j = 0 if start is None or key != self.first else int(np.searchsorted(self.bounds, start, side="left"))
        return None if j >= len(self.exits) else (int(self.exits[j]), int(self.places[j]))

    def then(self, other: "Steps") -> "Steps":
        """This stretch followed by ``other``."""
        n = self.n + other.n
        if not (self.single and other.single and self.first == other.first):
            # what is open at the end does not depend on the entry, unless self is
            # single, other too, and they have one key
            start, place = self.entered(None, None)
            found = other.entered(self.last, start)
            start, place = (start, place) if found is None else (found[0], self.n + found[1])
            return Steps(n, self.first, other.last, False, exits=np.array([start]), places=np.array([place]))
        j = np.searchsorted(other.bounds, self.exits, side="left")
        stays, j = j >= len(other.exits), np.minimum(j, len(other.exits) - 1)
        late = other.bounds > (self.bounds[-1] if len(self.bounds) else np.iinfo(np.int64).min)
        bounds = np.concatenate([self.bounds, other.bounds[late]])
        exits = np.concatenate([np.where(stays, self.exits, other.exits[j]), other.exits[late]])
        places = np.concatenate([np.where(stays, self.places, self.n + other.places[j]), self.n + other.places[late]])
        keep = np.append(places[1:] != places[:-1], True)
        return Steps(n, self.first, other.last, True, bounds[keep], exits[keep], places[keep])


_STEPS = [("_n", "long"), ("_first", "string"), ("_last", "string"), ("_single", "boolean"), ("_bounds", "array<long>"), ("_exits", "array<long>"), ("_places", "array<long>")]
_STEPS_DDL = ", ".join(f"{c} {t}" for c, t in _STEPS)


def _steps_of(batch: pa.RecordBatch) -> Iterator[Steps]:
    columns = [batch.column(batch.schema.get_field_index(c)) for c, _ in _STEPS]
    for n, first, last, single, *arrays in zip(*columns):
        yield Steps(n.as_py(), first.as_py(), last.as_py(), single.as_py(), *(a.values.to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays))


def _columns_of(s: Steps) -> list:
    return [s.n, s.first, s.last, s.single, s.bounds.tolist(), s.exits.tolist(), s.places.tolist()]


def _sort_ranges(d: DataFrame, key: str, ts: str, limit: int, width: int) -> DataFrame:
    """Events sorted by range, with their window where the range alone tells it.

    Adds ``_range``, ``_at`` (place in the range), ``_start`` and ``admitted`` (null for
    a range's first key, but for the first range) and, on one more row per range, its
    step function.
    """
    tie = [c for c in d.columns if c not in (key, ts)]
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # time as a number, key as text (both one to one) for the walk
    keyed = d.withColumns({"_t": F.unix_micros(F.col(ts)), "_key": F.col(key).cast("string")})
    ranged = keyed.repartitionByRange(n, key, "_t", *tie).sortWithinPartitions(key, "_t", *tie)
    added = [("_range", "int"), ("_at", "long"), ("_start", "long"), ("admitted", "boolean"), *_STEPS]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields], *[f"{c} {t}" for c, t in added]])

    def run(batches):
        from pyspark import TaskContext

        number, walk, at = TaskContext.get().partitionId(), Walk(width), 0
        head, head_key, in_head = [], None, number > 0
        first, single, types = None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index("_key"))
            t = batch.column(batch.schema.get_field_index("_t")).to_numpy().astype(np.int64)
            if types is None:
                types, first, head_key = batch.schema, keys[0].as_py(), keys[0].as_py()
            change = key_changes(keys)
            change[0] = keys[0].as_py() != (walk.key if at else first)
            moved = np.flatnonzero(change)
            single = single and not len(moved)
            cut = 0
            if in_head:
                cut = int(moved[0]) if len(moved) else batch.num_rows
                head.append(t[:cut])
                in_head = cut == batch.num_rows
            starts, places = walk.step(keys, t)
            unknown = np.arange(batch.num_rows) < cut
            more = [pa.array(np.full(batch.num_rows, number), pa.int32()), pa.array(np.arange(at, at + batch.num_rows)), pa.array(starts, mask=unknown), pa.array(places <= limit, mask=unknown)]
            empty = [pa.nulls(batch.num_rows, _ARROW[kind]) for _, kind in _STEPS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, *empty], names=[*batch.schema.names, *[c for c, _ in added]])
            at += batch.num_rows
        if types is None:
            return
        if single and number > 0:
            steps = Steps.of_events(head_key, np.concatenate(head), width)
        else:
            steps = Steps(at, first, walk.key, False, exits=np.array([walk.start]), places=np.array([walk.at]))
        last = [pa.nulls(1, f.type) for f in types] + [pa.array([number], pa.int32()), *[pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.bool_())]]
        yield pa.RecordBatch.from_arrays([*last, *[pa.array([v], _ARROW[kind]) for v, (_, kind) in zip(_columns_of(steps), _STEPS)]], names=[*types.names, *[c for c, _ in added]])

    return ranged.mapInArrow(run, ddl)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _blocks(steps: DataFrame) -> DataFrame:
    """Step functions of blocks of ranges, each composed in one task."""
    def run(batches):
        block, whole = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([v], _ARROW[kind]) for v, (_, kind) in zip(_columns_of(whole), _STEPS)]], names=["_range", *[c for c, _ in _STEPS]])

        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), _steps_of(batch)):
                if b != block and whole is not None:
                    yield row()
                    whole = None
                block, whole = b, s if whole is None else whole.then(s)
        if whole is not None:
            yield row()

    dealt = steps.withColumn("_block", F.floor(F.col("_range") / RANGES_PER_BLOCK).cast("int"))
    return dealt.repartition("_block").sortWithinPartitions("_block", "_range").select("_block", *[c for c, _ in _STEPS]).mapInArrow(run, f"_range int, {_STEPS_DDL}")


def _entries(steps: DataFrame, given: DataFrame | None) -> DataFrame:
    """(_range, _key, _start, _used): the window open when each stretch begins.

    ``given`` has it for each block of stretches; without it all stretches follow one another.
    """
    schema = pa.schema([("_range", pa.int32()), ("_key", pa.string()), ("_start", pa.int64()), ("_used", pa.int64())])

    def run(batches):
        block, key, start, at, seen = None, None, None, 0, 0
        for batch in batches:
            names = batch.schema.names
            found = []
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in ("_block", "_range", "_in_key", "_in_start", "_in_used")), _steps_of(batch))
            for b, number, in_key, in_start, in_used, s in rows:
                if b != block:
                    block, key, start, at, seen = b, in_key, in_start, -(in_used or 0), 0
                # the window belongs to another key: none is open here
                found.append((number, key, start, seen - at) if start is not None and key == s.first else (number, s.first, None, 0))
                left = s.entered(key, start)
                if left is not None:
                    start, at = left[0], seen + left[1]
                key, seen = s.last, seen + s.n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    block = F.lit(0) if given is None else F.floor(F.col("_range") / RANGES_PER_BLOCK).cast("int")
    dealt = steps.withColumn("_block", block)
    if given is None:
        dealt = dealt.withColumns({"_in_key": F.lit(None).cast("string"), "_in_start": F.lit(None).cast("long"), "_in_used": F.lit(None).cast("long")})
    else:
        dealt = dealt.join(given.select(F.col("_range").alias("_block"), F.col("_key").alias("_in_key"), F.col("_start").alias("_in_start"), F.col("_used").alias("_in_used")), "_block")
    ordered = dealt.repartition("_block").sortWithinPartitions("_block", "_range").select("_block", "_range", "_in_key", "_in_start", "_in_used", *[c for c, _ in _STEPS])
    return ordered.mapInArrow(run, "_range int, _key string, _start long, _used long")


def admit(df: DataFrame, key: str, ts: str, limit: int, window_seconds: float) -> DataFrame:
    """STR-5 (batch): all columns, ``admitted`` and ``window_start``. Ties in time are
    broken by the remaining columns. Null keys are one key; events without a
    time are left to :func:`admission_rejects`.

    1. One range sort over (key, time, other columns), written as a table. Each
       range walks its events in one pass; the windows of its first key, which may have
       begun before, stay open, and the range's step function is kept.
    2. Step functions (one row per range) are composed: per block of ranges, over
       the blocks, and inside each block again, which gives the window that is open
       at the start of each range.
    3. The open rows, now with that window, are walked once more, range by range.

    What a task holds is one batch of events, and for a range's first key its times.
    """
    width = int(window_seconds * 1_000_000)
    d = df.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    rows = materialize(_sort_ranges(d, key, ts, limit, width), "admit-ranges")
    steps = materialize(rows.where(F.col("_n").isNotNull()).select("_range", *[c for c, _ in _STEPS]), "admit-steps")
    entries = materialize(_entries(steps, _entries(_blocks(steps), None)), "admit-entries")
    columns = [F.col(f"`{c}`") for c in d.columns]
    events = rows.where(F.col("_n").isNull())
    done = events.where(F.col("_start").isNotNull()).select(*columns, "admitted", F.timestamp_micros("_start").alias("window_start"))
    entered = entries.select("_range", F.col("_start").alias("_in_start"), F.col("_used").alias("_in_used"))
    left = events.where(F.col("_start").isNull()).drop("_start", "admitted", *[c for c, _ in _STEPS]).join(F.broadcast(entered), "_range")  # a row per range
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartition(n, "_range").sortWithinPartitions("_range", "_at").select(*columns, "_key", "_t", "_range", "_in_start", "_in_used")
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields], "admitted boolean", "window_start long"])

    def run(batches):
        walk, where = Walk(width), None
        for batch in batches:
            names = batch.schema.names
            number = batch.column(names.index("_range")).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                keys = part.column(names.index("_key"))
                if where != number[a]:
                    where = number[a]
                    start = part.column(names.index("_in_start"))[0].as_py()
                    walk = Walk(width)
                    if start is not None:
                        walk.enter(keys[0].as_py(), start, part.column(names.index("_in_used"))[0].as_py())
                starts, places = walk.step(keys, part.column(names.index("_t")).to_numpy().astype(np.int64))
                own = [part.column(i) for i in range(len(d_names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(places <= limit), pa.array(starts)], names=[*d_names, "admitted", "window_start"])

    d_names = d.columns
    walked = left.mapInArrow(run, ddl)
    return done.unionByName(walked.withColumn("window_start", F.timestamp_micros("window_start")))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that the keys of a stream are dealt to. Fixed: a stream that goes on finds its state by them.
GROUPS = 256
#: Stretches of time that the lateness of a stream is cut in.
STRETCHES = 32


class _Admission(StatefulProcessor):
    """Events of a group of keys wait as Arrow batches, one for each input batch and stretch of time. A timer
    at the earliest one's time releases, stretch by stretch and in order, what the watermark has
    passed. Open windows are kept until the watermark ends them.

    A task holds the events of one group and stretch, and the group's open windows.
    """

    def __init__(self, schema: pa.Schema, limit: int, width: int, stretch: int):
        self.schema, self.limit, self.width, self.stretch = schema, limit, width, stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "place long, number int", "batch binary")
        #: the timer, and of each stretch its place, number of batches and first time
        self.index = handle.getValueState("index", "stretch long, wake long, places array<long>, numbers array<int>, firsts array<long>")
        self.windows = handle.getValueState("windows", "batch binary")

    def _read_index(self) -> tuple[int, int | None, dict[int, tuple[int, int]]]:
        if not self.index.exists():
            return self.stretch, None, {}
        stretch, wake, places, numbers, firsts = self.index.get()  # the stretch that the state was begun with
        return stretch, wake, dict(zip(places, zip(numbers, firsts)))

    def _write_index(self, stretch: int, wake: int, before: int | None, held: dict) -> None:
        """``wake``: the time of the only timer, which is at the first millisecond not before it."""
        wake = -(-wake // 1000)
        if wake != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(wake)
        numbers, firsts = zip(*held.values()) if held else ((), ())
        self.index.update((stretch, wake, list(held), list(numbers), list(firsts)))

    def _hold(self, held: dict, place: int, events: pa.RecordBatch) -> None:
        number, first = held.get(place, (0, np.iinfo(np.int64).max))
        self.events.updateValue((place, number), (events.serialize().to_pybytes(),))
        held[place] = number + 1, min(first, int(events.column("t").to_numpy().min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stretch, wake, held = self._read_index()
        for some in rows:
            columns = [pa.array(some[f.name], f.type, mask=some[f"no_{f.name}"].to_numpy(), from_pandas=False) for f in (self.schema.field("key"), self.schema.field("id"))]
            events = pa.RecordBatch.from_arrays([columns[0], pa.array(some["t"].to_numpy()), columns[1]], schema=self.schema)
            place = some["t"].to_numpy() // stretch
            order = np.argsort(place, kind="stable")
            events, place = events.take(pa.array(order)), place[order]
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    self._hold(held, int(place[a]), events.slice(a, b - a))
        if held:
            first = min(first for _, first in held.values())
            self._write_index(stretch, first if wake is None else min(first, wake * 1000), wake, held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        stretch, wake, held = self._read_index()
        opened = _Windows(self.schema.field("key").type)
        if self.windows.exists():
            opened = opened.read(self.windows.get()[0])
        for place in sorted(p for p, (_, first) in held.items() if first <= passed):
            number, _ = held.pop(place)
            batches = [pa.ipc.read_record_batch(pa.py_buffer(self.events.getValue((place, i))[0]), self.schema) for i in range(number)]
            for i in range(number):
                self.events.removeKey((place, i))
            events = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
            now = events.column("t").to_numpy() <= passed
            if not now.all():
                self._hold(held, place, events.filter(pa.array(~now)))
                events = events.filter(pa.array(now))
            events, starts, places = opened.admit(events, self.width)
            opened = opened.without(min((place + 1) * stretch, passed) - self.width)  # no later event falls into these
            keys, _, ids = (c.to_pandas(integer_object_nulls=True) for c in events.columns)
            yield pd.DataFrame({"key": keys, "id": ids, "admitted": places <= self.limit, "window_start": starts})
        opened = opened.without(passed - self.width)
        if len(opened.keys):
            self.windows.update((opened.bytes(),))
        else:
            self.windows.clear()
        if held:
            self._write_index(stretch, min(first for _, first in held.values()), None, held)
        elif len(opened.keys):  # to clear them
            self._write_index(stretch, int(opened.starts.max()) + self.width, None, held)
        else:
            self.index.clear()

    def close(self) -> None:
        pass


class _Windows:
    """The open windows of many keys, with the number of events in each."""

    def __init__(self, key_type: pa.DataType, keys: pa.Array | None = None, starts=None, used=None):
        self.type = key_type
        self.keys = pa.array([], key_type) if keys is None else keys
        self.starts, self.used = (np.zeros(0, np.int64) if c is None else c for c in (starts, used))

    def read(self, data: bytes) -> "_Windows":
        schema = pa.schema([("key", self.type), ("start", pa.int64()), ("used", pa.int64())])
        keys, starts, used = pa.ipc.read_record_batch(pa.py_buffer(data), schema).columns
        return _Windows(self.type, keys, starts.to_numpy(), used.to_numpy())

    def bytes(self) -> bytes:
        return pa.RecordBatch.from_arrays([self.keys, pa.array(self.starts), pa.array(self.used)], names=["key", "start", "used"]).serialize().to_pybytes()

    def without(self, until: int) -> "_Windows":
        """The windows that began after ``until``."""
        keep = self.starts > until
        return _Windows(self.type, self.keys.filter(pa.array(keep)), self.starts[keep], self.used[keep])

    def admit(self, events: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The events (key, t, id), sorted, with the window start and the place (from 1) in the window of
        each; the windows are then those after the last event of each key."""
        m = len(self.keys)
        coded = pa.concat_arrays([self.keys, events.column("key")]).dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, used = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(coded.dictionary), np.int64)
        start[code[:m]], used[code[:m]] = self.starts, self.used
        order = pc.sort_indices(pa.table({"code": code[m:], "t": events.column("t"), "id": events.column("id")}), sort_keys=[(c, "ascending") for c in ("code", "t", "id")])
        events, code = events.take(order), code[m:][order.to_numpy()]
        t = events.column("t").to_numpy()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        starts, places = start[code], used[code] + np.arange(1, len(code) + 1) - first[run]
        new = (used[code] == 0) | (t >= starts + width)  # else it falls into the window that is open
        if new.any():
            starts[new], places[new] = Walk(width).step(pa.array(code[new]), t[new])
        last = np.append(first[1:], len(code)) - 1
        start[code[last]], used[code[last]] = starts[last], places[last]
        self.keys, self.starts, self.used = coded.dictionary, start, used
        return events, starts, places


def admit_ordered(df: DataFrame, key: str, ts: str, limit: int, window_seconds: float, id_col: str, lateness: str) -> DataFrame:
    """STR-5 (streaming, any order): the rule of :func:`admit` on a stream whose events
    come at most ``lateness`` late: (key, id, admitted, window_start).

    Events wait until the watermark (latest time seen less ``lateness``) has passed them, so
    their order inside and between micro-batches does not matter; ties in time go by
    ``id_col``. Rows later than the watermark are dropped by Spark, as the windows they belong
    to have been given out; rows without a time go to :func:`admission_rejects`
    of the same stream. Needs the RocksDB state store, which is set on the session.

    State is kept for ``GROUPS`` groups of keys, so calls to it grow with the input batches,
    not with keys or events. A checkpoint of the form that kept it by key can't be continued.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    width = int(window_seconds * 1_000_000)
    late = spark.sql("SELECT unix_micros(timestamp_seconds(0) + CAST(:late AS INTERVAL)) AS late", args={"late": lateness}).first()["late"]
    fields = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("t", T.LongType()), T.StructField("id", df.schema[id_col].dataType)])
    # pandas has times without a zone
    schema = pa.schema([(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for f in spark.createDataFrame([], fields).toArrow().schema])

    def filled(c: str):
        # whole numbers and booleans with nulls would become floats and objects in pandas
        kind = df.schema[c].dataType
        return F.coalesce(F.col(c), F.lit(0).cast(kind)) if isinstance(kind, (T.IntegralType, T.BooleanType)) else F.col(c)

    timed = df.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    dealt = timed.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group"), F.col(ts).alias("at"), F.unix_micros(F.col(ts)).alias("t"),
                         filled(key).alias("key"), F.col(key).isNull().alias("no_key"), filled(id_col).alias("id"), F.col(id_col).isNull().alias("no_id"))
    types = dict(df.dtypes)
    found = dealt.groupBy("group").transformWithStateInPandas(
        _Admission(schema, limit, width, max(width, late // STRETCHES, 1)),
        f"key {types[key]}, id {types[id_col]}, admitted boolean, window_start long", "append", "eventtime")
    return found.select(F.col("key").alias(key), F.col("id").alias(id_col), "admitted", F.timestamp_micros("window_start").alias("window_start"))
