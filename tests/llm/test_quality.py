import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm.quality import FEATURES, classify, features, fit, moments, with_scores

from .conftest import corpus, prose


def labelled(rng, n=240):
    good = [prose(rng, rng.randint(30, 120)) + ".\n" + prose(rng, 20) for _ in range(n)]
    bad = [" ".join(w.upper() + rng.choice(["!!", "***"]) for w in prose(rng, 15).split()) * 3 for _ in range(n // 4)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    return rows, [(i, int(i < n), 0) for i, _ in rows]


def test_held_out_accuracy_and_odd_rows(spark, odd_rows):
    rows, labels = labelled(random.Random(1))
    docs = corpus(spark, rows + [(None if i is None else i + 9000, t) for i, t in odd_rows])
    marks = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0), (777777, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, marks).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    wrong = [i for i, q, _ in labels if got[i].held_out and got[i].predicted != q]
    assert len(wrong) <= 1
    assert classify(docs, marks).count() == docs.count()
    # scores beside all columns are alike
    model = fit(docs, marks)
    one = with_scores(docs, model, name="s").where("doc_id < 300").collect()
    assert with_scores(docs, model, name="s", least=0.3).count() == sum(r.predicted for r in classify(docs, marks).collect())
    assert all(abs(r.s - got[r.doc_id].score) < 1e-6 for r in one)


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = labelled(random.Random(2), 80)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    docs = corpus(spark, rows)
    a, b = ({r.doc_id: r.score for r in classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_no_or_one_class_of_labels(spark):
    docs = corpus(spark, [(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert all(r.score >= 0.5 for r in classify(docs, one).collect())
    assert classify(docs.limit(0), one).count() == 0


def test_moments_are_plain_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(FEATURES)))
    y = [int(v) for v in rng.integers(0, 2, 40)]
    got = moments(spark.createDataFrame([(r.tolist(), c) for r, c in zip(x, y)], "x array<double>, quality int").repartition(4))
    for c in (0, 1):
        own = x[np.array(y) == c]
        assert got[c][0] == len(own) and np.allclose(got[c][1], own.sum(0)) and np.allclose(got[c][2], own.T @ own)


def test_features_do_not_depend_on_the_neighbours():
    rng = random.Random(4)
    texts = ["", "a", "\n\n", "x y\nx y\n", prose(rng, 300), "ä ö", "1 2 3 | 4 ###"]
    raw = [t.encode() for t in texts]
    together = features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for t, row in zip(raw, together):
        assert np.allclose(features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], row)
    assert np.isfinite(together).all()


def plain_statistics(text):
    """The statistics of one text, by their names, from the text itself."""
    import re
    from collections import Counter
    from math import log1p, sqrt

    raw = text.encode()
    chars = max(len(text), 1)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    some = max(len(words), 1)
    share = lambda marks: sqrt(sum(c in marks for c in text) / chars)
    known = set(" \t\x0b\x0c\r\n#*$%&<>!?.,;:|0123456789") | set(map(chr, range(65, 91))) | set(map(chr, range(97, 123)))
    solid = chars - sum(c in " \t\x0b\x0c\r\n" for c in text)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return [
        log1p(len(words)), log1p(solid / some), share(set(map(chr, range(65, 91)))), share("0123456789"), share("#*$%&<>"), share("!?"), share(".,;:"), share("|"), sqrt(sum(c not in known and c.isascii() for c in text) / chars),
        log1p(len(words) / max(len(lines), 1)), sqrt(len(set(words)) / some), sqrt(max(Counter(words).values(), default=0) / some), sqrt(1 - len(set(grams)) / len(grams)) if grams else 0.0,
        sqrt(1 - len(set(lines)) / max(len(lines), 1)), sqrt(sum(len(w) <= 2 for w in words) / some), sqrt(sum(len(w) >= 14 for w in words) / some), sqrt(sum(w[-1:] in (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"!", b"?") for w in words) / some),
    ]


def test_scores_against_the_density_formula(spark, odd_rows):
    """Shrunk covariances, log densities and the logistic, by numpy's determinant and inverse."""
    rows, labels = labelled(random.Random(7), 60)
    rows += [(None if i is None else i + 9000, t) for i, t in odd_rows] + [(8000 + k, t) for k, t in enumerate(("A|b!\n\nA|b!\n\n", "é è 12 #tag", "\r\n\x01", "the the the the"))]
    marks = {i: q for i, q, _ in labels}
    x = {n: np.array(plain_statistics(t or "")) for n, (_, t) in enumerate(rows)}
    learnt = [(x[n], marks[i]) for n, (i, _) in enumerate(rows) if i in marks and zlib.crc32(str(i).encode()) % 5]
    by = [np.array([v for v, q in learnt if q == c]) for c in (0, 1)]
    pooled = sum((b - b.mean(0)).T @ (b - b.mean(0)) for b in by) / len(learnt)
    log_density = []
    for b in by:
        own = (b - b.mean(0)).T @ (b - b.mean(0)) / len(b)
        cov = 0.95 * (0.9 * own + 0.1 * pooled) + 0.05 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(FEATURES))
        away = lambda v, b=b, cov=cov: (v - b.mean(0)) @ np.linalg.inv(cov) @ (v - b.mean(0))
        log_density.append(lambda v, b=b, cov=cov, away=away: np.log((len(b) + 1) / (len(learnt) + 2)) - 0.5 * away(v) - 0.5 * np.linalg.slogdet(cov)[1])
    want = [(i, 1 / (1 + np.exp(-np.clip((log_density[1](x[n]) - log_density[0](x[n])) / 4, -40, 40)))) for n, (i, _) in enumerate(rows)]
    got = classify(corpus(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("doc_id", "score").collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-6
