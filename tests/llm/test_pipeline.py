import os
import random
import sys

import pytest

import corpus_pipeline
from tidepool.llm.pii import base_spans, redact
from tidepool.llm.quality import classify
from tidepool.llm.stages import decontaminate, default_tokenizer, keep_quality, near_dedup, pack

from .conftest import prose
from .test_decontam import brute as leaks
from .test_minhash import brute as groups
from .test_packing import check_layout, expected

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, odd_rows):
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(3)]
    rows, labels = [], []
    for i in range(160):
        t = prose(rng, rng.randint(25, 120)) + ".\n" + prose(rng, 15)
        if i % 8 == 0:
            t = " ".join(w.upper() + "!!" for w in prose(rng, 15).split()) * 3
        if i % 11 == 1:
            t += f" {items[i % 3][1]} " + prose(rng, 5)
        if i % 9 == 2:
            t += " call +1 (555) 010-4477 or mail x.y@mail.example.com"
        rows.append((i, t))
        labels.append((i, int(i % 8 != 0), 0))
    rows += [(500 + i, rows[i * 3 + 1][1] + " more") for i in range(20)]  # near copies
    rows += [(600, rows[1][1]), (600, rows[1][1])] + [(None if i is None else i + 900, t) for i, t in odd_rows]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    labels = spark.read.parquet(sf_dir + "/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(sf_dir + "/benchmark.parquet").collect()]
    names = docs.columns

    scored = sorted(((r.doc_id, r.predicted) for r in classify(docs, labels).collect()), key=str)
    first = keep_quality(spark, docs, sf_dir)
    assert first.columns == names and sorted((r[0] for r in rows_of(first)), key=str) == [i for i, p in scored if p]

    have = rows_of(first)
    kept = {row for row, g in zip(have, groups(have, 5, 80, ordered=True)) if g[3]}
    second = near_dedup(spark, first, sf_dir)
    assert second.columns == names and rows_of(second) == sorted(kept, key=str)

    have = rows_of(second)
    third = decontaminate(spark, second, sf_dir)
    dirty = {i for i, _ in leaks(have, items)}
    assert third.columns == names and dirty and rows_of(third) == [(i, t) for i, t in have if i not in dirty]

    have = rows_of(third)
    fourth = corpus_pipeline.STAGES[3][1](spark, third, sf_dir)
    assert fourth.columns == names
    assert rows_of(fourth) == sorted(((i, None if t is None else redact(t, [(k, a, b) for k, a, b in base_spans(t)])) for i, t in have), key=str)
    assert all(r.n_chars == len(r.text or "") for r in fourth.collect())

    packed = pack(spark, fourth, sf_dir).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed], key=str) == expected(rows_of(fourth), 4096)
    check_layout([(r.length, r.sequence_id, r.offset) for r in packed], 4096)


def test_run_is_the_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    pieces = lambda df: sorted([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect()], key=str)
    assert pieces(corpus_pipeline.run(spark, sf_dir)) == pieces(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "pack"] and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_queries_are_registered():
    sys.path.insert(0, os.path.dirname(os.path.abspath(corpus_pipeline.__file__)))
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names and default_tokenizer()
