"""Field matching between source and destination schemas (FUZ-4, 5, 7, 8, 9).

Inputs are field tables ``(stream, path, name, type)``. Candidate pairs are
formed only inside one stream pair -- an equi-join on the stream key -- so
the pair count is schema width squared per stream, never by the number of
streams or records.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import key_changes, key_texts
from ..session import discard, materialize
from .conflict import null_safe_join
from .keys import KEY_HASH, key_join
from ..functions.names import (
    normalize_field_name,
    normalize_name,
    similarity_of_normalized,
    suggested_transform,
    type_compat,
)


def score_pairs(src: DataFrame, dst: DataFrame, key: str = "stream", w_name: float = 0.7, w_type: float = 0.3,
                min_score: float = 0.3) -> DataFrame:
    """FUZ-4: ``w_name * name_similarity + w_type * type_compat`` for field pairs
    of the same stream, kept when >= ``min_score``.

    Names are normalised once per field (not once per pair).
    Output: ``key, src_path, dst_path, src_type, dst_type, score``.
    """
    def side(df, p):
        out = df.select(key, F.col("path").alias(f"{p}_path"), F.col("type").alias(f"{p}_type"),
                        normalize_name(F.col("name")).alias(f"_{p}n"))
        return out.withColumn(f"_{p}l", F.octet_length(f"_{p}n"))

    j = key_join(side(src, "src"), side(dst, "dst"), [key])
    score = F.lit(w_name) * similarity_of_normalized("_srcn", "_dstn", "_srcl", "_dstl") + \
        F.lit(w_type) * type_compat("src_type", "dst_type")
    return j.select(key, "src_path", "dst_path", "src_type", "dst_type", score.alias("score")) \
        .filter(F.col("score") >= F.lit(min_score))


PREFIX_PAIRS = 20_000  # pairs of a stream that one round solves in order


def assign_greedy(pairs: DataFrame, key: str = "stream", prefix: int = PREFIX_PAIRS) -> DataFrame:
    """FUZ-5: greedy one-to-one assignment per stream by descending score
    (ties by source then destination path). Null streams and paths are values
    like others; pairs without a score come last.

    A round takes the first ``prefix`` pairs of each stream and walks them in
    order, which is what the greedy pass does with them; only the taken ends
    are held. Every pair of the prefix touches a taken end then, so dropping the
    pairs that touch one leaves what the next round starts with. Streams of at most
    ``prefix`` pairs, as nearly all are, end in the first round. The prefix is picked
    where the pairs lie, from each run of one stream's pairs (a join on the stream gives one run), before
    it is shuffled, so no task sorts a whole large stream and nothing is sorted twice.
    """
    cols = [key, "src_path", "dst_path", "src_type", "dst_type", "score"]
    left = pairs.select(*cols[:-1], F.col("score").cast("double").alias("score"))
    picked, written, last = [], None, None
    while True:
        solved = materialize(_solve_prefix(left, key, prefix), "greedy-pick")
        picked.append(solved.where(~F.col("_more")).drop("_more"))
        more = solved.where("_more").select(key)
        if more.isEmpty():
            break
        taken = picked[-1].select(key, "src_path", "dst_path")
        rest = null_safe_join(left, more, [key], "left_semi")
        rest = null_safe_join(rest, taken.select(key, "src_path"), [key, "src_path"], "left_anti")
        rest = null_safe_join(rest, taken.select(key, "dst_path"), [key, "dst_path"], "left_anti")
        left = materialize(rest, "greedy-left")
        size = left.count()
        if size == last:
            raise RuntimeError("a round of the assignment took no pair")
        last = size
        if written is not None:
            discard(written)
        written = left
    out = reduce(DataFrame.unionByName, picked)
    return out.withColumn("confidence", F.round("score", 2)).withColumn("transform", suggested_transform("src_type", "dst_type"))


def _solve_prefix(left: DataFrame, key: str, prefix: int) -> DataFrame:
    """Pairs that the greedy pass takes among the first ``prefix`` of each stream, and for a
    stream with more pairs one row with ``_more``."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in left.dtypes)
    kind = dict(left.dtypes)[key]
    plain = kind in ("string", "int", "bigint")
    tagged = left.withColumn("_stream", F.col(f"`{key}`") if plain else key_texts(key))
    spread = F.xxhash64("_stream")
    order = [spread, F.col("_stream"), F.desc_nulls_last("score"), F.col("src_path"), F.col("dst_path")]
    ends = [left.columns.index(c) for c in ("src_path", "dst_path")]

    def walk(batches, take):
        """Batches with ``take(place, source, destination)`` as mask, by place in the stream."""
        stream, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            streams = batch.column(batch.num_columns - 1)
            change = key_changes(streams)
            change[0] = streams[0].as_py() != stream
            stream = streams[batch.num_rows - 1].as_py()
            starts = np.maximum.accumulate(np.where(change, np.arange(batch.num_rows), -1))
            places = np.where(starts < 0, place + np.arange(batch.num_rows), np.arange(batch.num_rows) - starts)
            place = int(places[-1]) + 1
            yield batch, places, take(places, *(batch.column(i) for i in ends))

    def best(run):
        """The first pairs of one stream's; one more than the prefix, to know of it."""
        rows = pa.Table.from_batches(run)
        if rows.num_rows <= prefix + 1:
            return rows
        score, src, dst = (rows.column(i).combine_chunks() for i in (left_names.index("score"), *ends))
        # descending, not-a-number first and null last, as Spark sorts them; paths ascending, null first
        kinds = pc.fill_null(pc.if_else(pc.is_nan(score), 0, 1), 2)
        down = pc.negate(pc.fill_null(pc.if_else(pc.is_nan(score), 0.0, score), 0.0))
        by = pa.table({"a": kinds, "b": down, "c": pc.is_valid(src), "d": src, "e": pc.is_valid(dst), "f": dst})
        return rows.take(pc.sort_indices(by, sort_keys=[(c, "ascending") for c in by.column_names]).slice(0, prefix + 1))

    def first(batches):
        run, held, stream = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            streams = batch.column(batch.num_columns - 1)
            change = key_changes(streams)
            change[0] = bool(run) and streams[0].as_py() != stream
            stream, at = streams[batch.num_rows - 1].as_py(), np.flatnonzero(change)
            if len(at):
                run.append(batch.slice(0, int(at[0])))
                yield from best(run).to_batches()
                yield batch.slice(int(at[0]), int(at[-1] - at[0]))  # whole runs, no longer than a batch
                run, held, batch = [], 0, batch.slice(int(at[-1]))
            run.append(batch)
            held += batch.num_rows
            if held > 2 * prefix + len(batch):
                run = best(run).combine_chunks().to_batches()
                held = prefix + 1
        if run:
            yield from best(run).to_batches()

    left_names = left.columns
    def solve(batches):
        sources, targets = set(), set()

        def take(places, src, dst):
            mask = np.zeros(len(places), bool)
            for i, (p, a, b) in enumerate(zip(places.tolist(), src.to_pylist(), dst.to_pylist())):
                if p == 0:
                    sources.clear()
                    targets.clear()
                if p < prefix and a not in sources and b not in targets:
                    sources.add(a)
                    targets.add(b)
                    mask[i] = True
            return mask

        for batch, places, mask in walk(batches, take):
            more = places == prefix
            keep = mask | more
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(more[keep])], names=[*kept.schema.names[:-1], "_more"])

    some = tagged.mapInArrow(first, f"{ddl}, _stream {kind if plain else 'string'}")
    # all partitions are kept, so that what a task sorts stays small
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return some.repartition(parts, spread).sortWithinPartitions(*order).mapInArrow(solve, f"{ddl}, _more boolean")


def overall_confidence(assigned: DataFrame, key: str | None = None) -> DataFrame:
    """FUZ-8: mean pair confidence (per stream or overall)."""
    agg = F.avg("confidence").alias("overall_confidence")
    return assigned.groupBy(key).agg(agg, F.count(F.lit(1)).cast("bigint").alias("mappings")) if key else \
        assigned.agg(agg, F.count(F.lit(1)).cast("bigint").alias("mappings"))


CATALOG_BLOCK = 1000  # destination names that one unresolved name is scored against at a time
SEED_GRAMS, SEED_NAMES = 8, 1024  # rarest grams of a name and names per gram that give its first bound


def _names(df: DataFrame, col: str) -> DataFrame:
    """Distinct normalised names (null left out): (name, chars, bytes)."""
    out = df.select(normalize_name(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    return out.withColumns({"chars": F.length("name"), "bytes": F.octet_length("name")})


def _grams(names: DataFrame) -> DataFrame:
    """(name, chars, bytes, gram): pairs of neighbouring characters of each name with a
    mark at both ends; a pair that stands there k times is k grams."""
    pad = F.concat(F.lit("\u0002"), F.col("name"), F.lit("\u0003"))
    at = names.withColumn("_gram", F.explode(F.transform(F.sequence(F.lit(1), F.col("chars") + 1), lambda i: F.substring(pad, i, F.lit(2)))))
    counted = at.groupBy("name", "chars", "bytes", "_gram").agg(F.count(F.lit(1)).alias("_k"))
    return counted.select("name", "chars", "bytes", F.explode(F.transform(F.sequence(F.lit(1), F.col("_k").cast("int")), lambda k: F.concat(F.col("_gram"), k.cast("string")))).alias("gram"))


def name_candidates(src_names: DataFrame, dst_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FUZ-7's pairs to score: (name, other) and the names that the index can't help, both
    from tables of distinct names (name, chars, bytes).

    An edit changes at most two grams of a name, so names at similarity s share at least
    ``max(chars) + 1 - 2 (1 - s) max(bytes)`` of them. Every name first gets a
    similarity that some destination reaches: the one met most often in short samples of
    the lists of its rarest grams. What reaches that too must share a gram out of the name's rarest
    ``grams - least + 1`` ones, and have a length within the edits allowed: only these
    lists are read. Where the bound asks for no shared gram the name is
    returned in the second table. Samples change the bound only, never the result.
    """
    index = materialize(_grams(dst_names), "match-index")
    lists = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    ranked = _grams(src_names).join(lists, "gram", "left")
    rare = Window.partitionBy("name").orderBy(F.coalesce("_n", F.lit(0)), "gram")  # the grams of one name
    mine = materialize(ranked.withColumn("_place", F.row_number().over(rare)).withColumn("_seed", F.row_number().over(Window.partitionBy("name").orderBy(F.asc_nulls_last("_n"), "gram"))), "match-grams")
    # an array of a few names per gram; partial aggregates keep it short
    samples = index.groupBy("gram", F.pmod(F.xxhash64("name"), F.lit(SEED_NAMES)).alias("_slot")).agg(F.min_by("name", F.xxhash64("name", "gram")).alias("other"))
    seeds = mine.where((F.col("_seed") <= SEED_GRAMS) & F.col("_n").isNotNull()).select("name", "gram").join(samples, "gram").groupBy("name", "other").agg(F.count(F.lit(1)).alias("_n"))
    closest = seeds.groupBy("name").agg(F.max_by("other", F.struct("_n", "other")).alias("other"))
    bound = closest.select("name", similarity_of_normalized("name", "other").alias("_s"))
    widest = dst_names.agg(F.max(F.col("bytes") / F.greatest("chars", F.lit(1))).alias("_wide")).first()["_wide"] or 1.0
    bounded = src_names.join(bound, "name", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    off = F.lit(2.0) * (F.lit(1.0) - F.col("_s")) + F.lit(1e-9)
    # the bound's least value over all lengths: the longer name is this one, or another as wide as any
    longer_self = F.col("chars") + 1 - off * F.col("bytes")
    longer_other = F.when(off * F.lit(widest) < 1, F.col("chars") * (1 - off * F.lit(widest)) + 1).otherwise(F.lit(0.0))
    bounded = bounded.withColumn("_least", F.ceil(F.least(longer_self, longer_other) - F.lit(1e-6)).cast("int"))
    bounded = materialize(bounded, "match-bounds")
    helped = bounded.where("_least >= 1").select("name", "_s", "_least")
    probes = mine.join(helped, "name").where((F.col("_place") <= F.col("chars") + 1 - F.col("_least") + 1) & F.col("_n").isNotNull())
    there = index.select("gram", F.col("name").alias("other"), F.col("chars").alias("_chars"), F.col("bytes").alias("_bytes"))
    near = F.abs(F.col("chars") - F.col("_chars")) <= (F.lit(1.0) - F.col("_s")) * F.greatest("bytes", "_bytes") + F.lit(1e-6)
    pairs = probes.join(there, "gram").where(near).select("name", "other").distinct()
    return pairs, bounded.where("_least < 1").select("name")


def best_dest_stream(src: DataFrame, src_name: str, dst: DataFrame, dst_name: str, dst_order: str, block: int = CATALOG_BLOCK) -> DataFrame:
    """FUZ-7: best destination stream per source by name similarity; the first
    destination by ``dst_order`` (unique) wins ties; a source with no positive
    similarity gets none.

    Work is done once per distinct normalised name on both sides. Candidates come from
    an inverted index of q-grams (:func:`name_candidates`). Names it can't
    help, as nothing like them is there (similarity below about a half), are
    scored against all destination names, dealt into blocks of about ``block`` (an
    array per block), by an equi-join on the block number; one best name per block
    is kept. No task holds more than a block; the catalog may have any length.
    """
    firsts = dst.select(normalize_name(dst_name).alias("name"), F.col(dst_order).alias("_o"), F.col(dst_name).alias("_label")).where(F.col("name").isNotNull())
    firsts = materialize(firsts.groupBy("name").agg(F.min(F.struct("_o", "_label")).alias("_first")).select("name", "_first.*"), "match-names")
    sized = firsts.select("name", F.length("name").alias("chars"), F.octet_length("name").alias("bytes"))
    names = materialize(_names(src, src_name), "match-sources")
    pairs, unhelped = name_candidates(names, sized)
    rank = F.struct("sim", (-F.col("_o")).alias("neg"), "_label")
    by_index = pairs.join(firsts.withColumnRenamed("name", "other"), "other").withColumn("sim", similarity_of_normalized("name", "other")).select("name", rank.alias("_best"))
    blocks = max(-(-firsts.count() // block), 1)
    dealt = firsts.groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("name", "_o", "_label")).alias("_names"))
    spread = unhelped.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_block", F.col("_block").cast("bigint"))
    scored = F.transform("_names", lambda d: F.struct(similarity_of_normalized(F.col("name"), d["name"]).alias("sim"), (-d["_o"]).alias("neg"), d["_label"].alias("_label")))
    by_block = spread.join(dealt, "_block").select("name", F.array_max(scored).alias("_best"))
    best = by_index.unionByName(by_block).groupBy("name").agg(F.max("_best").alias("_best"))
    found = best.where("_best.sim > 0").select(F.col("name").alias("_name"), F.col("_best._label").alias("best_stream"), F.col("_best.sim").alias("best_score"))
    return src.withColumn("_name", normalize_name(src_name)).join(found, "_name", "left").select(*[F.col(f"`{c}`") for c in src.columns], "best_stream", "best_score")


def match_three_pass(src: DataFrame, dst: DataFrame, key: str = "stream") -> DataFrame:
    """FUZ-9: exact name (1.0 / 0.9 when types differ), then normalised name
    (0.8 / 0.7), then type only (0.3); each destination used once.

    Sources are visited in name order and each takes the first free
    destination (name order) of its group, which is the same as pairing the
    i-th source with the i-th destination inside a group. A group is one
    stream's fields with one name or type, so it is small by nature. What a pass
    leaves is written once and is all that the next one reads.
    """
    # fixed values: the reasons
    s0 = src.select(key, F.col("name").alias("s_name"), F.col("type").alias("s_type"), F.col("name").alias("_n"), F.lit(True).alias("_s"))
    d0 = dst.select(key, F.col("name").alias("d_name"), F.col("type").alias("d_type"), F.col("name").alias("_n"), F.lit(True).alias("_d"))
    both, same = F.col("_s") & F.col("_d"), F.col("s_type") == F.col("d_type")

    def pairs(rows, confidence, reason):
        return rows.where(both).select(key, F.col("s_name").alias("source_field"), F.col("d_name").alias("dest_field"), confidence.alias("confidence"), reason.alias("reason"))

    # pass 1: exact names (unique per schema, so a plain equi-join)
    named = materialize(key_join(s0, d0, [key, "_n"], "full_outer").drop("_n"), "match-named")
    p1 = pairs(named, F.when(same, 1.0).otherwise(0.9), F.when(same, "exact name and type match").otherwise("exact name match"))
    # pass 2: normalised names
    name = F.coalesce("s_name", "d_name")
    zipped = materialize(_zip_groups(_alone(named), key, normalize_field_name(name), name), "match-zipped")
    p2 = pairs(zipped, F.when(same, 0.8).otherwise(0.7), F.when(same, "normalized name and type match").otherwise("normalized name match"))
    # pass 3: same non-empty type
    kind = F.coalesce("s_type", "d_type")
    p3 = pairs(_zip_groups(_alone(zipped), key, F.when(kind != "", kind), name), F.lit(0.3), F.lit("type match only"))
    return p1.unionByName(p2).unionByName(p3)


def _alone(rows: DataFrame) -> DataFrame:
    """Fields that no pass has paired."""
    return rows.where(F.col("_s").isNull() | F.col("_d").isNull())


def _zip_groups(rows: DataFrame, key: str, group, order) -> DataFrame:
    """Rows of sources (``_s``) and destinations (``_d``) with the i-th source and the i-th destination of each
    (``key``, ``group``) as one row; null keys and groups are left alone. One shuffle: the places of each side and the
    pairs of equal places are windows over the same group."""
    grouped = rows.withColumns({"_g": group, "_o": order})
    hashed = grouped.withColumn(KEY_HASH, F.xxhash64(key, "_g"))
    # fields that are in no group differ in their hash, so that they don't come together
    hashed = hashed.withColumn(KEY_HASH, F.when(F.col(key).isNull() | F.col("_g").isNull(), F.xxhash64(key, "_o")).otherwise(F.col(KEY_HASH)))
    group_by = [KEY_HASH, key, "_g"]
    sources_first = Window.partitionBy(*group_by).orderBy(F.col("_s").asc_nulls_last(), "_o")
    place, sources = F.row_number().over(sources_first), F.count("_s").over(sources_first.rowsBetween(Window.unboundedPreceding, 0))
    placed = hashed.withColumn("_r", F.when(F.col("_s"), place).otherwise(place - sources))
    at = Window.partitionBy(*group_by).orderBy("_r", F.col("_s").asc_nulls_last())  # a source, then the destination of its place
    other = F.struct("d_name", "d_type", "_d", "_r")
    after = F.when(F.col("_s"), F.lead(other).over(at))
    before = F.lag(F.struct("_s", "_r")).over(at)
    in_group = F.col(key).isNotNull() & F.col("_g").isNotNull()
    paired = placed.withColumns({"_after": after, "_before": before})
    takes = F.coalesce(in_group & F.col("_s") & F.col("_after._d") & (F.col("_after._r") == F.col("_r")), F.lit(False))
    taken = F.coalesce(in_group & F.col("_d") & F.col("_before._s") & (F.col("_before._r") == F.col("_r")), F.lit(False))
    mine = lambda c: F.when(takes, F.col(f"_after.{c}")).otherwise(F.col(c)).alias(c)
    return paired.where(~taken).select(key, "s_name", "s_type", "_s", *[mine(c) for c in ("d_name", "d_type", "_d")])
