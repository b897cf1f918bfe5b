import random
from collections import Counter

from pyspark.sql import functions as F

from tidepool.llm.lines import judge, without_boilerplate

from .conftest import corpus, prose


def base(text):
    t = text or ""
    raw = t.encode()
    words = [w.decode() for w in raw.split()]
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i:i + 8]), []).append(i)
    rep = {j for v in spots.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = Counter(x for x in raw.split(b"\n") if x.split())
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(n - 1 for n in lines.values()), len(rep)]


def normal(line):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return b" ".join(line.encode().translate(table).split())


def brute(rows, share, texts):
    hosts = {}
    for i, t, h in rows:
        hosts.setdefault(h, set()).add((i, t or ""))
    common = {h: {x for x, n in Counter(x for _, t in ts for x in {normal(y) for y in t.split("\n")}).items() if x and n > texts and n > share * min(len(ts), 10_000)} for h, ts in hosts.items()}
    out = []
    for i, t, h in rows:
        b = base(t)
        gone = sum(len(x.encode().split()) for x in (t or "").split("\n") if normal(x) in common[h])
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        out.append((i, *b, failed, not failed and gone < 0.8 * b[0], gone))
    return sorted(out, key=str)


def docs(odd):
    rng = random.Random(8)
    rows = [(i, t) for i, t in odd]
    for i in range(150):
        lines = [prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.7:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["All rights reserved to the site, and more.", "ALL rights\treserved  to the site, and more. "]))
        rows.append((100 + i, rng.choice(["\n", "\n\n", "\r\n"]).join(lines + lines[:rng.randint(0, 2)])))
    rows += [(500 + k, "All rights reserved to the site, and more.\n" + "the line of many words that comes back in each of the texts of this host and no more " * 1 + f"{k}") for k in range(3)]
    return rows


def test_against_brute_force(spark, odd_rows):
    rows = docs(odd_rows)
    with_host = [(i, t, f"host{(i or 0) % 2}") for i, t in rows]
    got = judge(corpus(spark, rows).repartition(5), share=0.05, texts=5).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(with_host, 0.05, 5)


def test_depleted_documents_and_copies(spark):
    shared = "\n".join(prose(random.Random(k), 12) for k in range(3))
    rows = [(i, shared + f"\nword{i}") for i in range(0, 40, 2)] + [(i, prose(random.Random(i), 40)) for i in range(1, 41, 2)] + [(1, prose(random.Random(1), 40))] * 30
    got = {r.doc_id: r.kept for r in judge(corpus(spark, rows), texts=10).collect()}
    assert not any(got[i] for i in range(0, 40, 2)) and all(got[i] for i in range(1, 41, 2))


def test_boilerplate_is_taken_out(spark, odd_rows):
    rows = docs(odd_rows)
    df = corpus(spark, rows)
    out = without_boilerplate(df, share=0.05, texts=5)
    assert out.columns == df.columns and out.count() == len(rows)
    assert not any("rights" in (r.text or "").lower() for r in out.collect())


def test_null_host_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a " * 30, None), (2, None, None), (None, "b", "h")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, r.kept) for r in judge(df).collect()) == [(0, False), (1, False), (2, False)]
    assert judge(df.limit(0)).count() == 0


def test_copies_and_large_hosts(spark):
    """Copies under other ids are documents; the limit stops at a hundredth of 10,000 documents."""
    text = "\n".join(prose(random.Random(k), 12) for k in range(4))
    copies = spark.range(60).selectExpr("id AS doc_id").crossJoin(spark.createDataFrame([(text, "a")], "text string, source string"))
    assert judge(copies).where("kept").isEmpty()
    line = "this line stands in many documents of one very large host and in no others at all, which is a pity"
    large = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line), F.when(F.col("id") < 101, "\n").otherwise(" "), F.lit("plus "), "id").alias("text"), F.lit("b").alias("source"))
    got = judge(large.repartition(6))
    assert got.where("doc_id < 101 AND kept").isEmpty() and got.where("doc_id >= 101 AND NOT kept").isEmpty()
    assert judge(large.where("doc_id >= 1")).where("NOT kept").isEmpty()


def test_cleaned_texts_against_brute_force(spark, odd_rows):
    rows = docs(odd_rows)
    hosts = {}
    for i, t in rows:
        hosts.setdefault(f"host{(i or 0) % 2}", set()).add((i, t or ""))
    common = {h: {x for x, n in Counter(x for _, t in ts for x in {normal(y) for y in t.split("\n")}).items() if x and n > 5 and n > 0.05 * len(ts)} for h, ts in hosts.items()}
    want = [(i, None if t is None else "\n".join(y for y in t.split("\n") if normal(y) not in common[f"host{(i or 0) % 2}"])) for i, t in rows]
    got = without_boilerplate(corpus(spark, rows).repartition(3), share=0.05, texts=5).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want != rows
