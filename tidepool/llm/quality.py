"""Document quality by a regularised quadratic discriminant.

Each text becomes ``FEATURES``: document statistics after a transform (logs of
counts, square roots of shares) that makes them nearer to normal. For
each class Spark sums counts, first and second moments over all labelled
training rows; the driver turns these ``2 (1 + d + d d)`` numbers into means
and covariances, shrinks each covariance towards the pooled one and its
diagonal, and keeps the Cholesky factors. A score is the logistic of the
difference of log densities (Mahalanobis distances and log determinants by
the cached factors) and log priors, divided by ``temperature``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Runs, Words, chunks, cut, mix, record, spare, text_of, word_runs

FEATURES = (
    "log_words", "log_word_length", "upper", "digit", "symbol", "shout", "sentence_marks", "bars", "other_marks",
    "log_line_words", "distinct_words", "top_word", "repeat_trigrams", "repeat_lines", "short_words", "long_words", "marked_words",
)
THRESHOLD = 0.3
#: Weight of the pooled covariance, and then of the diagonal, in each class's covariance.
POOL, DIAGONAL, RIDGE = 0.1, 0.05, 1e-3
#: Features are far from independent normals; log odds are damped by this.
TEMPERATURE = 4.0

# byte classes of the shares
_KINDS = ("space", "lower", "upper", "digit", "symbol", "shout", "sentence", "bar", "mark", "more", "lead", "line")
_KIND = np.full(256, _KINDS.index("mark"), np.int64)
for _name, _bytes in (("space", b" \t\x0b\x0c\r"), ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("symbol", b"#*$%&<>"), ("shout", b"!?"), ("sentence", b".,;:"), ("bar", b"|"), ("line", b"\n")):
    _KIND[list(_bytes)] = _KINDS.index(_name)
_KIND[128:192] = _KINDS.index("more")  # continuation bytes
_KIND[192:] = _KINDS.index("lead")


def _repeated(doc: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct values, and the count of the most frequent one."""
    key = mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key)
    new = np.append(True, key[by][1:] != key[by][:-1]) if len(by) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(by)))
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, doc[by[heads]], counts)
    return np.bincount(doc[by[heads]], minlength=docs), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per document; an empty text has the values of no words."""
    n = len(offsets) - 1
    where = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(where * len(_KINDS) + _KIND[data], minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    kind = dict(zip(_KINDS, kinds.T))
    chars = np.maximum(kinds.sum(1) - kind["more"], 1)
    words = Words(data, offsets)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    lens = words.end - words.start
    hashes = words.hashes()
    distinct, top = _repeated(words.doc, hashes, n)
    grams = mix(word_runs(hashes).each(3)) if len(words) > 2 else np.zeros(0, np.uint64)
    inside = words.doc[: len(grams)] == words.doc[len(words) - len(grams):] if len(grams) else np.zeros(0, bool)
    gram_doc = words.doc[: len(grams)][inside]
    gram_distinct, _ = _repeated(gram_doc, grams[inside], n)
    gram_count = np.bincount(gram_doc, minlength=n)
    # lines
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], (ends + 1)[ends + 1 < len(data)]]))
    stops = np.minimum(np.append(starts[1:], len(data)), len(data))
    line_doc = where[starts] if len(starts) else np.zeros(0, np.int64)
    line_hash = Runs(data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15).of(starts, stops)
    line_distinct, _ = _repeated(line_doc, mix(line_hash), n)
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    share = lambda mask: np.bincount(words.doc[mask], minlength=n) / some
    root = np.sqrt
    return np.column_stack([
        np.log1p(count), np.log1p((chars - kind["space"] - kind["line"]) / some), root(kind["upper"] / chars), root(kind["digit"] / chars), root(kind["symbol"] / chars), root(kind["shout"] / chars), root(kind["sentence"] / chars),
        root(kind["bar"] / chars), root(kind["mark"] / chars), np.log1p(count / lines), root(distinct / some), root(top / some), root(1 - gram_distinct / np.maximum(gram_count, 1)) * (gram_count > 0),
        root(1 - line_distinct / lines), root(share(lens <= 2)), root(share(lens >= 14)), root(share((_KIND[last] == _KINDS.index("symbol")) | (_KIND[last] == _KINDS.index("shout")))),
    ])


def featurise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) for every row; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch, data, offsets in chunks(batches):
            x = features(data, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield record(schema, batch.column("doc_id"), flat)

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: F.Column, folds: int = 5) -> F.Column:
    """True for rows that no model learns from; a null id is never held out (it has no label either)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """log priors, means, inverse Cholesky factors and log determinants of classes 0 and 1."""

    prior: tuple[float, float]
    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    temperature: float = TEMPERATURE
    threshold: float = THRESHOLD

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [self.prior[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) - 0.5 * self.logdet[c] for c in (0, 1)]
        odds = np.clip((density[1] - density[0]) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-odds))


def moments(rows: DataFrame, label: str = "quality") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of ``x`` per label 0 or 1, summed by Spark."""
    d = len(FEATURES)
    schema = pa.schema([("label", pa.int32()), ("k", pa.int32()), ("v", pa.float64())])

    def run(batches):
        total = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = np.column_stack([np.ones((y == c).sum()), x[y == c]])
                total[c] = total.get(c, 0) + part.T @ part
        for c, m in total.items():
            yield record(schema, np.full(m.size, c, np.int32), np.arange(m.size, dtype=np.int32), m.ravel())

    sums = rows.select(F.col(label).cast("int").alias("label"), "x").where("label in (0, 1)").mapInArrow(run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    out = {c: np.zeros((d + 1) ** 2) for c in (0, 1)}
    for r in sums.collect():  # 2 (d + 1) ** 2 numbers
        out[r["label"]][r["k"]] = r["v"]
    return {c: (m[0], m.reshape(d + 1, -1)[0, 1:], m.reshape(d + 1, -1)[1:, 1:]) for c, m in out.items()}


def train(rows: DataFrame, label: str = "quality") -> Model:
    """Model of rows (x, label). A class without rows takes the pooled mean
    and covariance, so that scores tend to the prior; without any rows all are 0.5."""
    d, m = len(FEATURES), moments(rows, label)
    n = sum(v[0] for v in m.values())
    pooled_mean = sum(v[1] for v in m.values()) / max(n, 1)
    mean = np.array([m[c][1] / m[c][0] if m[c][0] else pooled_mean for c in (0, 1)])
    scatter = [m[c][2] - m[c][0] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = sum(scatter) / max(n, 1)
    whiten, logdet = [], []
    for c in (0, 1):
        own = scatter[c] / m[c][0] if m[c][0] > 1 else pooled
        s = (1 - POOL) * own + POOL * pooled
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    prior = tuple(float(np.log((m[c][0] + 1) / (n + 2))) for c in (0, 1))
    return Model(prior, mean, np.array(whiten), np.array(logdet))


def training_rows(x: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels of rows that may be learnt from; labels that are null are passed over."""
    known = labels.select(F.col("doc_id").alias("_id"), "quality").where("quality is not null")
    return x.join(known, F.col("doc_id") == F.col("_id")).where(~held_out(F.col("doc_id"))).select("x", "quality")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from all labelled rows outside the held-out fold."""
    return train(training_rows(featurise(docs), labels))


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score", least: float | None = None) -> DataFrame:
    """``docs``, all columns, with each row's score as ``name`` (a new column); with
    ``least`` only rows that reach it. Decided where a row is read, without a shuffle."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name}")
    names, plain = docs.columns, spare(docs, "_plain")

    def run(batches):
        for batch, data, offsets in chunks(batches, plain):
            score = model.score(features(data, offsets))
            out = batch.select(names).append_column(name, pa.array(score, pa.float64()))
            yield out if least is None else out.filter(pa.array(score >= least))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.withColumn(plain, text_of(text)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels, languages, sources and ids are no inputs of a score. A null or
    empty text scores as a text of no words; repeated rows score alike; an
    empty table gives no rows."""
    x = cut(featurise(docs), "features")
    model = train(training_rows(x, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield record(schema, batch.column("doc_id"), model.score(values))

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))
