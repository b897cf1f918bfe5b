import hashlib
import random

import pytest

from tidepool.llm.superkmer import heavy_grams, remove_repeats

from .conftest import corpus, prose


def brute(rows, k):
    """By definition; a null id is the smallest, twins are judged alike."""
    first, out = {}, []
    order = lambda i: (i is not None, i or 0)
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            first[key] = min(first.get(key, ((True, 1 << 62), 0)), (order(i), s))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] < (order(i), s):
                gone[s:s + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [1e-5, 0.01])
def test_against_brute_force(spark, odd_rows, share):
    rng = random.Random(7)
    passage = prose(rng, 70)
    rows = list(odd_rows)
    for i in range(120):
        t = prose(rng, rng.randint(0, 90))
        if rng.random() < 0.6:
            a = rng.randint(0, 40)
            t += "\n" + " ".join(passage.split()[a:a + rng.randint(10, 60)]) + "  " + prose(rng, 9)
        rows.append((1000 + i, t))
    rng.shuffle(rows)
    got = remove_repeats(corpus(spark, rows).repartition(6), heavy_share=share).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 20)


def test_small_windows_and_periodic_text(spark):
    rows = [(1, "a b a b a b a b a b a b"), (2, "x a b a b a b y"), (3, "b a " * 2000)]
    got = remove_repeats(corpus(spark, rows), k=5, m=2, with_text=False).collect()
    assert sorted([tuple(r) for r in got], key=str) == [r[:4] for r in brute(rows, 5)]


def test_hot_grams_are_found(spark):
    rng = random.Random(9)
    hot = prose(rng, 30)
    rows = [(i, hot if i % 3 == 0 else prose(rng, 30)) for i in range(90)]
    assert heavy_grams(corpus(spark, rows).repartition(3), share=0.005).count() == 27
    assert heavy_grams(corpus(spark, rows).limit(0)).count() == 0


def test_empty_table(spark):
    assert remove_repeats(corpus(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("share", [1e-5, 0.01])
def test_texts_that_share_an_id_and_a_place(spark, share):
    rng = random.Random(11)
    passage = prose(rng, 60)
    near = [(5, f"{passage} {prose(rng, 30)}") for _ in range(3)]
    near += [near[1], (6, f"{passage} {prose(rng, 5)}")]
    far = [(1, f"{prose(rng, 25)} {passage} {prose(rng, 25)}"), (7, prose(rng, 30))]
    parts = corpus(spark, near).coalesce(1).union(corpus(spark, far).repartition(2))  # near rows in one chunk, far ones in others
    got = remove_repeats(parts, heavy_share=share).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(near + far, 20)
    spread = remove_repeats(corpus(spark, near + far).repartition(7), heavy_share=share).collect()
    assert sorted(spread, key=str) == sorted(got, key=str)
