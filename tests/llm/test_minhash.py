import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import minhash
from tidepool.llm.minhash import components, near_duplicates

from .conftest import corpus, prose


def shingles(t, k):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = (t or "").encode().translate(table).split()
    return frozenset([tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []))


def brute(rows, k, percent, ordered=False):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if a and b and (same_id or 100 * len(a & b) >= percent * len(a | b)):
                group[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [d]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out if ordered else sorted(out, key=str)


def edited(rng, text, rate):
    return " ".join(prose(rng, 1) if rng.random() < rate else w for w in text.split())


def family(seed, families=6, size=9):
    rng, rows = random.Random(seed), []
    common = prose(rng, 25)
    for f in range(families):
        base = prose(rng, rng.choice([4, 30, 120, 300])) + " " + common
        rows += [(len(rows) * 3 + k, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))) for k in range(size)]
    return rows


@pytest.mark.parametrize("seed,shingle,percent,rounds", [(1, 3, 85, 3), (2, 5, 80, 3), (3, 3, 85, 1), (4, 3, 85, 2)])
def test_against_brute_force(spark, odd_rows, monkeypatch, seed, shingle, percent, rounds):
    # with one round of pivots the blocks have to do the work; small blocks make many cells
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = family(seed) + [(None if i is None else i + 5000, t) for i, t in odd_rows]
    got = near_duplicates(corpus(spark, rows).repartition(4), shingle=shingle, percent=percent).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows, shingle, percent)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200), (200, 250)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 300: 200, 250: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_rows_without_words(spark):
    assert near_duplicates(corpus(spark, [(1, "a")]).limit(0)).count() == 0
    got = near_duplicates(corpus(spark, [(5, None), (4, ""), (3, "  ")])).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_one_row_for_one_id_with_other_texts(spark):
    rng = random.Random(11)
    a, b = prose(rng, 60), prose(rng, 60)
    got = near_duplicates(corpus(spark, [(9, a), (9, b), (3, a), (4, b)])).agg(F.collect_set("component_id")).first()[0]
    assert got == [3]


@pytest.mark.parametrize("common", [0, 3, 40])
def test_overlaps_of_many_sets_at_once(common):
    """The blocks count what one set shares with many others in one step, whether many or few sets hold a number."""
    rng = random.Random(common)
    sets = [frozenset(rng.sample(range(100), rng.randint(0, common))) | frozenset(rng.sample(range(1000, 3000), rng.randint(0, 60))) for _ in range(50)]
    over = minhash._Overlaps([np.array(sorted(s), np.int64) for s in sets])
    for k in range(50):
        others = np.array(sorted({*rng.sample(range(50), rng.randint(0, 20))} - {k}), np.int64)
        assert over.shared(k, others).tolist() == [len(sets[k] & sets[x]) for x in others]
        assert over.apart(k, k + 1, 50).tolist() == [x for x in range(k + 1, 50) if not sets[k] & sets[x]]
