import random

from tidepool.llm.decontam import Q, edit_budget, find_leaks, without_leaks

from .conftest import corpus, prose


def least_edits(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def normal(t):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return b" ".join((t or "").encode().translate(table).split())


def case(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(2, 35))) for i in range(8)] + [(50, None), (51, ""), (52, "tiny"), (None, prose(rng, 20)), (0, None)]
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 50))
        if rng.random() < 0.8:
            p = list(rng.choice([x for _, x in items if x]))
            for _ in range(rng.randint(0, int(0.07 * len(p)) + 1)):
                k = rng.randrange(len(p))
                p[k:k + 1] = rng.choice([["x"], [p[k], "y"], []]) or []
                if not p:
                    break
            t = f"{t} {''.join(p).replace(' ', rng.choice([' ', chr(10), '  ']), 1).upper() if rng.random() < 0.5 else ''.join(p)} {prose(rng, 3)}"
        rows.append((i, t))
    return rows, items


def brute(rows, items):
    out = {}
    for d, t in rows:
        for i, p in items:
            p = normal(p)
            if len(p) >= Q and (e := least_edits(p, normal(t))) <= edit_budget(len(p)):
                out[d, i] = min(e, out.get((d, i), e))
    return out


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows, items = case(seed)
        bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
        for size in (1 << 20, 300):  # one block, several blocks
            got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(corpus(spark, rows).repartition(3), bench, block_bytes=size).collect()}
            assert got == brute(rows, items) and len(got) > 10
        docs = corpus(spark, rows)
        left = without_leaks(docs, bench, block_bytes=300)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in rows} - {d for d, _ in brute(rows, items)})


def test_odd_rows_and_empty_tables(spark, odd_rows):
    passage = prose(random.Random(12), 40)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = odd_rows + [(70, prose(random.Random(13), 20_000) + " " + passage), (71, passage), (71, passage), (None, passage.replace(" ", "\t"))]
    docs = corpus(spark, rows)
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in find_leaks(docs, bench).collect()), key=str) == [(70, 1, 0), (71, 1, 0), (None, 1, 0)]
    assert without_leaks(docs, bench).count() == len(odd_rows)
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == len(rows)


def brute_passages(rows, items):
    """Documents and items of which the document holds the whole or a passage, by the description."""
    out = set()
    for d, t in rows:
        t = normal(t)
        for i, p in items:
            p = normal(p)
            size = max(80, min(len(p) // 2, 200))
            starts = {*range(0, len(p) - size, size // 4), len(p) - size} if len(p) > size else set()
            parts = [p[a:a + size] for a in starts] + ([p] if len(p) <= 2000 else [])
            if any(len(x) >= Q and least_edits(x, t) <= edit_budget(len(x)) for x in parts):
                out.add((d, i))
    return out


def test_parts_of_items(spark):
    from tidepool.llm.decontam import PASSAGE

    rng = random.Random(21)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 20, 30, 60, 90))]
    rows = []
    for i, p in items:
        n = len(p)
        for k, (a, b) in enumerate(((0, 0.9), (0.1, 1), (0.3, 0.75), (0.45, 0.6), (0, 1))):
            part = list(p[int(a * n):int(b * n)])
            if k % 2:
                part[len(part) // 2] = "#"
            rows.append((10 * i + k, f"{prose(rng, 6)} {''.join(part)} {prose(rng, 6)}"))
    rows.append((900, prose(rng, 100)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_passages(rows, items)
    for size in (1 << 20, 100):
        assert {(r.doc_id, r.item_id) for r in find_leaks(corpus(spark, rows), bench, passage=PASSAGE, block_bytes=size).collect()} == want
    assert {(10 * i, i) for i in (1, 2, 3, 4)} <= want and len(want) < len(rows)  # nine tenths of an item, word for word
    left = {r.doc_id for r in without_leaks(corpus(spark, rows), bench, passage=PASSAGE).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want}


def test_a_long_item_is_bounded(spark):
    from tidepool.llm.decontam import PASSAGE

    rng = random.Random(22)
    item = prose(rng, 60_000)  # some hundred KB
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, prose(rng, 50) + item[100_000:101_000] + prose(rng, 50)), (2, item), (3, prose(rng, 200))]
    got = {(r.doc_id, r.edits, r.n_bytes) for r in find_leaks(corpus(spark, rows), bench, passage=PASSAGE).collect()}
    assert got == {(1, 0, 200), (2, 0, 200)}
