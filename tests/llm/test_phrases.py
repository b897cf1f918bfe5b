import random
import re
from collections import Counter

from tidepool.llm.phrases import Sizes, count_phrases, mine_phrases

TINY = Sizes(run_chars=3000, part=400, block=64, section=200)


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows, longest=4):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    return n, f


def want(rows, top, least, longest=4, contained=80):
    n, f = counts(rows, longest)
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    scored = []
    for (lang, ws), a in cands.items():
        if any(100 * b >= contained * a for (g, vs), b in cands.items() if g == lang and len(vs) > len(ws) and any(vs[i:i + len(ws)] == ws for i in range(len(vs)))):
            continue
        score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        scored.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def texts(seed, docs=120):
    rng = random.Random(seed)
    vocab = ["a", "b", "É", "é", "the", "The", "x\x01", "x", "\x00", "ab", "z" * 3000, " ", "ba", "c|d", "%"]
    weights = [40, 20, 2, 3, 30, 5, 2, 6, 1, 4, 1, 1, 4, 2, 2]
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!?", "\r\n", "\x0b"]
    rows = []
    for i in range(docs):
        body = "".join(rng.choices(vocab, weights)[0] + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "", "x\ty"]), body))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " .\t"), ("en", "The a b. " * 400), ("en", "The a b. " * 400), ("de", "q"), ("one", "u v w x. " * 40)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "lang string, text string, phrase string, n string, words int")


def test_against_brute_force(spark):
    rows = texts(1)
    for sizes, parts in ((TINY, 3), (Sizes(), 2)):
        for top, least in ((1000, 5), (7, 12)):
            got = mine_phrases(frame(spark, rows).repartition(parts), top=top, least=least, sizes=sizes).collect()
            assert sorted(map(tuple, got)) == want(rows, top, least)


def test_counts_of_every_length(spark):
    rows = texts(2, 40)
    n, f = counts(rows, 3)
    got = {(r["lang"], r["phrase"], r["words"]): r["n"] for r in count_phrases(frame(spark, rows).repartition(4), longest=3, least=4, sizes=TINY).collect()}
    have = {(g, " ".join(ws), len(ws)): c for (g, ws), c in f.items() if c >= 4} | {(g, "", 0): c for g, c in n.items() if c}
    assert got == have


def test_nothing_to_count(spark):
    assert mine_phrases(frame(spark, texts(1)).limit(0)).count() == 0
    assert mine_phrases(frame(spark, [("en", None), (None, " . ")])).count() == 0


def test_counts_past_64_bits_are_exact(spark):
    from tidepool.llm.phrases import score_phrases

    big = 6_000_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 11), ("en", "", 0, big)]
    got = score_phrases(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).collect()
    assert [(r["phrase"], r["score"]) for r in got] == [("a b", 2_000_000 * (big - 11) // (2 * big + 7))]
