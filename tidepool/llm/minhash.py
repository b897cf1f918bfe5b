"""Near-duplicate documents by bottom-k sketches of one hash function.

1. *Sketch.* Every text becomes the set of its distinct word shingles (one
   64-bit hash each, one hash function); its sketch is the ``SKETCH`` smallest
   ones. Texts with equal sets (by two set sums and the size) are one class
   with one representative; copies go no further.
2. *Inverted lists.* A retained value's list holds the representatives that
   retain it. Two sets with similarity t share, among the least ``SKETCH``
   values of their union, about ``t * SKETCH``; fewer than ``overlap`` (30 at
   t = 0.8) are as good as impossible, so any link shows among the
   ``SKETCH - overlap + 1`` rarest retained values of both, and only these are
   listed. Text that very many documents share stays out that way.
3. *Candidates without all pairs.* Each list compares its members with one
   pivot, the member whose values are the most common, so the centre of a
   group of copies. Members linked with it are together; what is left to
   compare is ruled out by bounds. Beside the pivot's shingles, of which it lacks m, a
   member has q that no other listed text holds and s more; so two members x, y
   differ in at least q(x) + q(y) + |s(x) - s(y)| + |m(x) - m(y)| shingles,
   while a link allows (1 - t) / (1 + t) of the sizes' sum. These whole numbers have few values
   however large the list, and it is their distinct combinations that are held against
   one another. Members without a possible partner go; the others get another
   pivot. After some rounds the rest are compared in blocks against blocks, on
   these bounds, the sketches and the full sets, each member of a list with each other one, each
   pair in one of its lists.
4. *Estimate and verify.* The union sketch's estimate drops hopeless pairs; the others
   are confirmed on their full sets.
5. *Groups.* Links are contracted to stars (large-star, small-star) by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, cut, ints, mix, partitions, record, squeezed, text_of, unsqueezed, word_runs

SKETCH = 64
#: Rounds of pivots before lists are compared block by block.
PIVOT_ROUNDS = 6
BLOCK = 2048
#: Shingles of a block's members, in all.
BLOCK_SHINGLES = 1 << 21
#: A null doc_id: after all others, so that no component is called after it.
LAST_ID = (1 << 63) - 1


def least_shared(similarity: float, chance: float) -> int:
    """The most values that two sets of this similarity share, but for ``chance``, among the
    ``SKETCH`` least of their union (each of which both hold with the similarity's chance)."""
    total = 0.0
    for c in range(SKETCH + 1):
        total += math.comb(SKETCH, c) * similarity**c * (1 - similarity) ** (SKETCH - c)
        if total > chance:
            return c
    return SKETCH


def overlap(percent: int) -> int:
    """Shared values that a link has (but for a chance of 1e-9)."""
    return least_shared(percent / 100, 1e-9)


def far(percent: int) -> int:
    """Shared values below which even a common neighbour is ruled out (but for 1e-8)."""
    return least_shared(2 * percent / 100 - 1, 1e-8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (non-negative int64) of each text, A-Z lowered."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    runs = word_runs(hashes)
    each = (mix(runs.each(shingle)) >> np.uint64(1)).view(np.int64) if len(words) >= shingle else np.zeros(0, np.int64)
    first = words.first.tolist()
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= shingle:
            s = np.sort(each[a:b - shingle + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append((mix(runs.of(np.array([a]), np.array([b]))) >> np.uint64(1)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(doc, tag, n, s1, s2, sketch) of every row; n = 0 without words, tag is a hash of the text."""
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, shingle)
            wide = [s.view(np.uint64) for s in sets]
            yield record(
                schema, batch.column("doc"), batch.column("tag"), [len(s) for s in sets], [int(mix(s).sum().view(np.int64)) for s in wide],
                [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) for s in wide], [s[:SKETCH] for s in sets])

    rows = _documents(docs, key, text).select("doc", F.xxhash64("text").alias("tag"), "text")
    return rows.mapInArrow(run, "doc long, tag long, n long, s1 long, s2 long, sketch array<long>")


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc"), text_of(text).alias("text"))


def inverted_lists(reps: DataFrame, percent: int) -> DataFrame:
    """(value, doc, n, weight): for each representative its rarest retained
    values that others retain too. weight: how common its values are."""
    values = reps.select("doc", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    held = values.join(common, "value").groupBy("doc", "n", "k").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("held"), F.sum(F.log("freq")).alias("weight"))
    # of k retained values the first are those that no other document retains
    need = F.least(F.lit(overlap(percent)), F.ceil(F.col("n") * percent / 100)).cast("int")
    places = F.col("k") - need + 1 - (F.col("k") - F.size("held"))
    return held.where(places > 0).select("doc", "n", "weight", F.explode(F.slice("held", F.lit(1), F.greatest(places, F.lit(0)))).alias("h")).select("h.value", "doc", "n", "weight")


def estimate_filter(pairs: DataFrame, reps: DataFrame, least: int, percent: int | None = None) -> DataFrame:
    """Pairs (a, b) that share ``least`` of their union sketch (half of a
    smaller one), and with ``percent`` also have sizes that allow a link."""
    one = reps.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    if percent is not None:
        both = both.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            one, two = ((c.flatten().to_numpy(), c.offsets.to_numpy()) for c in (batch.column("sa"), batch.column("sb")))
            base, other = one[1][0], two[1][0]
            keep = [possible(one[0][i - base:j - base], two[0][k - other:m - other], least) for i, j, k, m in zip(one[1], one[1][1:], two[1], two[1][1:])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def possible(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether ``least`` of the k least values of the union of two sorted sketches, or half of fewer values, are shared."""
    union = np.sort(np.concatenate([x, y]))
    again = union[1:] == union[:-1]
    rank = 1 + np.cumsum(~again)  # of the second of two neighbours
    size = min(int(rank[-1]) if len(rank) else len(union), SKETCH)
    return int((again & (rank <= SKETCH)).sum()) >= min(least, size // 2)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, inter, union) of pairs on the full sets of their packed texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("inter", pa.int64()), ("union", pa.int64())])

    def sets(blobs: list[bytes]) -> list[np.ndarray]:
        raw = unsqueezed(blobs)
        return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), shingle)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                two_blobs = part.column("tb").to_pylist()
                distinct = list(dict.fromkeys(two_blobs))
                two = dict(zip(distinct, sets(distinct)))
                one = sets(part.column("ta").to_pylist())
                inter = [len(np.intersect1d(x, two[y], assume_unique=True)) for x, y in zip(one, two_blobs)]
                yield record(schema, part.column("a"), part.column("b"), inter, [len(x) + len(two[y]) - i for x, y, i in zip(one, two_blobs, inter)])

    a = texts.select(F.col("doc").alias("a"), F.col("blob").alias("ta"))
    b = texts.select(F.col("doc").alias("b"), F.col("blob").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, inter long, union long")


def packed_texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(doc, blob): compressed texts of the wanted documents, one row for each text of an id."""
    rows = squeezed(_documents(docs, key, text)).withColumnRenamed("text", "blob")
    return rows.join(wanted, "doc", "left_semi").distinct()


def _pivot_round(lists: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Links found, and the members of lists with more to compare, each with the
    shingles ``inter`` it shares with the list's pivot (null where the estimate has ruled
    out even a common neighbour), those ``m`` of the pivot that it lacks, and whether it is linked."""
    lists = lists.select([c for c in lists.columns if c in ("value", "doc", "n", "weight", "q", "path")])
    best = lists.groupBy("value").agg(F.max(F.struct("weight", -F.col("doc"), "doc", "n")).alias("top"), F.count("*").alias("c")).where("c > 1").select("value", F.col("top.doc").alias("p"), F.col("top.n").alias("pn"))
    placed = lists.join(best, "value").where("doc <> p")
    pairs = cut(placed.select(F.col("doc").alias("a"), F.col("p").alias("b")).distinct(), f"pairs-{name}")
    likely = cut(estimate_filter(pairs, reps, far(percent)), f"likely-{name}")
    checked = verify(likely, texts, shingle).groupBy("a", "b").agg(F.max("inter").alias("inter"), F.max(100 * F.col("inter") >= percent * F.col("union")).alias("linked"))
    checked = cut(checked, f"checked-{name}")
    reach = placed.join(checked.withColumnsRenamed({"a": "doc", "b": "p"}), ["doc", "p"], "left")
    seen = reach.select(*lists.columns, "inter", (F.col("pn") - F.col("inter")).alias("m"), F.coalesce("linked", F.lit(False)).alias("linked"))
    unlinked = seen.where("not linked").select("value").distinct()  # a list of linked members only is done
    return checked.where("linked").select("a", "b"), cut(seen.join(unlinked, "value", "left_semi"), f"seen-{name}")


def unshared(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc, q): how many shingles no other wanted document has."""
    schema = pa.schema([("doc", pa.int64()), ("s", pa.int64())])

    def run(batches):
        for batch in batches:
            raw = unsqueezed(batch.column("blob").to_pylist())
            doc = ints(batch, "doc")
            for i in range(0, len(raw), 200):
                part = raw[i:i + 200]
                sets = shingle_sets(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64), shingle)
                yield record(schema, np.repeat(doc[i:i + 200], [len(x) for x in sets]), np.concatenate(sets))

    each = texts.join(wanted, "doc", "left_semi").select("doc", "blob").mapInArrow(run, "doc long, s long")
    return each.groupBy("s").agg(F.count("*").alias("c"), F.min("doc").alias("doc")).where("c = 1").groupBy("doc").agg(F.count("*").alias("q"))


_PLACE = ("linked", "q", "s", "m", "n")


def _fits(percent: int) -> F.Column:
    """Whether the bounds let a member be linked with one whose place is in the columns
    with an underscore (m < 0: too far from the pivot for its share to be known)."""
    x, y = (lambda c: F.col(c)), (lambda c: F.col(f"_{c}"))
    known = (x("m") >= 0) & (y("m") >= 0)
    least = x("q") + y("q") + F.when(known, F.abs(x("s") - y("s")) + F.abs(x("m") - y("m"))).otherwise(0)
    together = x("linked") & y("linked")  # both linked with the pivot: nothing left to find
    apart = (x("linked") & (y("m") < 0)) | (y("linked") & (x("m") < 0))
    sizes = (100 * x("n") >= percent * y("n")) & (100 * y("n") >= percent * x("n"))
    return ~together & ~apart & sizes & ((100 + percent) * least <= (100 - percent) * (x("n") + y("n")))


def _possible(seen: DataFrame, percent: int, name: str) -> DataFrame:
    """Members of lists that may have a link which no pivot has shown; ``path``
    keeps their places (linked, s, m) with regard to each round's pivot."""
    rows = seen.withColumn("s", F.when(F.col("m").isNull(), -1).otherwise(F.greatest(F.col("n") - F.col("inter") - F.col("q"), F.lit(0)))).withColumn("m", F.coalesce("m", F.lit(-1)))
    path = F.array(F.struct("linked", F.col("s").cast("long").alias("s"), F.col("m").cast("long").alias("m")))
    rows = rows.select("value", "doc", "weight", *_PLACE, (F.concat("path", path) if "path" in rows.columns else path).alias("path"))
    places = cut(rows.groupBy("value", *_PLACE).agg(F.count("*").alias("c")), f"places-{name}")
    other = places.select(*[F.col(c).alias(f"_{c}") for c in ("value", *_PLACE)])
    same = F.lit(True)
    for c in _PLACE:
        same = same & (F.col(c) == F.col(f"_{c}"))
    found = places.join(other, (F.col("value") == F.col("_value")) & _fits(percent) & (~same | (F.col("c") > 1)), "left_semi").drop("c")
    return cut(rows.join(found, ["value", *_PLACE], "left_semi"), f"left-{name}")


class _Overlaps:
    """Sets of numbers; how many numbers one of them shares with some others. Numbers that many sets hold are kept as bits."""

    def __init__(self, sets: list[np.ndarray]):
        numbers, ids, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        common = 16 * held >= len(sets)
        dense, rare = common[ids], ~common[ids] & (held[ids] > 1)
        bits = np.zeros((len(sets), -(-int(common.sum()) // 64) * 64), bool)
        bits[row[dense], (np.cumsum(common) - 1)[ids[dense]]] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.columns = np.ascontiguousarray(self.bits.T)
        self.ids, self.at = ids[rare], np.searchsorted(row[rare], np.arange(len(sets) + 1))
        self.mark = np.zeros(len(numbers), bool)

    def apart(self, k: int, start: int, stop: int) -> np.ndarray:
        """Which sets of a range share nothing with the k-th."""
        met = np.zeros(stop - start, np.uint64)
        for column in self.columns:
            met |= column[start:stop] & column[k]
        others = np.flatnonzero(met == 0) + start
        return others[self._rare(k, others) == 0]

    def shared(self, k: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[others] & self.bits[k]).sum(axis=1, dtype=np.int64) + self._rare(k, others)

    def _rare(self, k: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.at[k]:self.at[k + 1]]
        lens = self.at[others + 1] - self.at[others]
        ends = np.cumsum(lens)
        if not len(own) or not len(others) or not ends[-1]:
            return np.zeros(len(others), np.int64)
        self.mark[own] = True
        which = np.repeat(self.at[others] - (ends - lens), lens) + np.arange(ends[-1])
        hits = np.concatenate([[0], np.cumsum(self.mark[self.ids[which]])])
        self.mark[own] = False
        return hits[ends] - hits[ends - lens]


def block_links(lists: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among members of one list. Every two members of a list meet,
    in blocks of ``BLOCK`` (or ``BLOCK_SHINGLES`` in all) against blocks, in the least of the lists they
    share; the bounds of all rounds and the sketches choose pairs, which are confirmed on the full
    sets there and then, many at once. Only links leave the task."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = lists.groupBy("value").agg(blocks.cast("int").alias("blocks"))
    mine = lists.groupBy("doc").agg(F.sort_array(F.collect_set("value")).alias("values"))
    members = mine.join(reps.select("doc", "n", "sketch"), "doc").join(texts, "doc")
    dealt = lists.join(sizes, "value").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).join(members, ["doc", "n"])
    # a member of a block meets all blocks: cells (lesser, greater)
    cells = dealt.select("value", "doc", "n", "q", "path", "values", "sketch", "blob", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sized = cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = overlap(percent)

    def links(cell: pa.Table, value: int, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = cell.sort_by("n").combine_chunks()
        column = lambda c: cell.column(c).combine_chunks()
        doc, q, n, block = (column(c).to_numpy() for c in ("doc", "q", "n", "block"))
        rounds = column("path").flatten()
        linked, s, m = (rounds.field(c).to_numpy(zero_copy_only=False).reshape(len(doc), -1).T for c in ("linked", "s", "m"))  # one row per round
        arrays = lambda c: np.split(column(c).flatten().to_numpy(), np.cumsum(column(c).value_lengths().to_numpy())[:-1])
        before, sketch = _Overlaps([v[v < value] for v in arrays("values")]), arrays("sketch")
        full, sketch = np.array([len(x) == SKETCH for x in sketch]), _Overlaps(sketch)
        likely = {}
        for k in range(len(doc)):
            # sizes ascend; what shares a value before this one meets in another list
            rest = before.apart(k, k + 1, int(np.searchsorted(n, 100 * n[k] // percent, side="right")))
            fits = doc[rest] != doc[k]
            if i != j:
                fits &= block[rest] != block[k]
            room = (100 - percent) * (n[rest] + n[k]) / (100 + percent) + 1e-9 - q[rest] - q[k]
            for one, two, three in zip(linked, s, m):
                apart = np.where((three[rest] >= 0) & (three[k] >= 0), np.abs(two[rest] - two[k]) + np.abs(three[rest] - three[k]), 0)
                fits &= ~(one[rest] & one[k]) & (apart <= room)
            others = rest[fits]
            others = others[(sketch.shared(k, others) >= least) | ~(full[k] & full[others])]
            if len(others):
                likely[k] = others
        if not likely:
            return
        used = np.unique(np.concatenate([[*likely], *likely.values()]))
        raw = unsqueezed(column("blob").take(pa.array(used)).to_pylist())
        sets = []
        for at in range(0, len(raw), 200):
            part = raw[at:at + 200]
            sets += shingle_sets(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64), shingle)
        whole, size = _Overlaps(sets), np.array([len(x) for x in sets])
        for k, others in likely.items():
            x, ys = int(np.searchsorted(used, k)), np.searchsorted(used, others)
            shared = whole.shared(x, ys)
            found = doc[others[100 * shared >= percent * (size[x] + size[ys] - shared)]]
            yield np.maximum(found, doc[k]), np.minimum(found, doc[k])

    def run(batches):
        held, key = [], None

        def found():
            pairs = [(np.zeros(0, np.int64),) * 2, *links(pa.Table.from_batches(held), *key)]
            return record(schema, np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs]))

        for batch in batches:
            keys = list(zip(*[ints(batch, c).tolist() for c in ("value", "i", "j")]))
            starts = [x for x in range(len(keys)) if x == 0 or keys[x] != keys[x - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != key and held:
                    yield found()
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield found()

    n = partitions(lists.sparkSession)
    return sized.repartition(n, "value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) of the nodes of undirected edges (a, b) that are not their
    component's smallest, by alternating large-star and small-star rounds."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct(), name)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of ``docs``;
    ``text_hash`` (xxhash64, of the empty text for null) tells apart rows that share an id.

    Texts are linked whose shingle sets have an intersection of at least
    ``percent`` of their union. ``component_id`` is the smallest doc_id that links lead
    to, ``kept`` whether it is the row's own. A text without words (null,
    empty or white space) is linked with nothing; one of fewer words than a shingle
    is one shingle. A null doc_id is linked as any other but gives no
    component its name unless all ids of the component are null. Rows that
    share a doc_id are one document with the links of them all. An empty table
    gives no rows.
    """
    all_sketches = cut(sketches(docs, key, text, shingle), "sketches")
    own = ["n", "s1", "s2"]
    classes = cut(all_sketches.where("n > 0").groupBy(*own).agg(F.min("doc").alias("rep"), F.any_value("sketch").alias("sketch")), "classes")
    reps = classes.select(F.col("rep").alias("doc"), "n", "sketch")
    lists = cut(inverted_lists(reps, percent), "lists")
    several = lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    lists = cut(lists.join(several, "value", "left_semi"), "lists")
    texts = cut(packed_texts(docs, key, text, lists.select("doc").distinct()), "candidates")
    links, alone, before = [], None, None
    for k in range(max(PIVOT_ROUNDS, 1)):
        if lists.isEmpty():
            break
        found, seen = _pivot_round(lists, reps, texts, shingle, percent, f"round{k}")
        links.append(found)
        if alone is None:
            open_docs = lists.join(seen.select("value").distinct(), "value", "left_semi").select("doc").distinct()  # pivots too
            alone = cut(unshared(texts, open_docs, shingle), "unshared")
            seen = seen.join(alone, "doc", "left").withColumn("q", F.coalesce("q", F.lit(0)))
        lists = _possible(seen, percent, f"round{k}")
        left = lists.count()
        if before is not None and 10 * left > 8 * before:  # another round would not pay
            break
        before = left
    if not lists.isEmpty():
        links.append(cut(block_links(lists, reps, texts, shingle, percent), "links-blocks"))
    joined = all_sketches.select("doc", "tag", *own).join(classes.select(*own, "rep"), own, "left").withColumn("rep", F.coalesce("rep", "doc"))
    # rows of one id with different sets belong together
    edges = joined.where("doc <> rep and n > 0").join(joined.groupBy("doc").agg(F.min("rep").alias("_low"), F.max("rep").alias("_high")).where("_low < _high").select("doc"), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    for found in links:
        edges = edges.unionByName(found)
    root = components(edges)
    out = joined.join(root, F.col("rep") == F.col("node"), "left").select("doc", "tag", "n", F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc")).alias("component"))
    shown = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return out.select(shown("doc").alias(key), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"), F.col("tag").alias("text_hash"))
