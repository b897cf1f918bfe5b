import random
import zlib

import numpy as np
import pytest

from tidepool.llm.packing import best_fit, pack, pack_documents
from tidepool.llm.stages import default_tokenizer

from .conftest import corpus, prose


def expected(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    out = []
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out += [(i, k, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def check_layout(rows, capacity):
    sequences = {}
    for length, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_match_the_tokenizer(spark, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, prose(rng, rng.randint(0, 400))) for i in range(60)] + [(200, "it's a<|endoftext|>b \x00 nul \x1c fs  nbsp é ΑΣ ١٢")]
    got = pack_documents(corpus(spark, rows).repartition(5), default_tokenizer(), capacity=256, with_ids=True).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == expected(rows, 256)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    n = check_layout([(r.length, r.sequence_id, r.offset) for r in got], 256)
    assert n <= -(-sum(r.length for r in got) // 256) + 2


def test_residual_rounds_join_what_partitions_leave(spark):
    rng = random.Random(2)
    lengths = [rng.randint(1, 60) for _ in range(800)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long").repartition(20)
    rows = pack(items, 100, fan_in=4, nearly_full=0).join(items, "item").collect()
    assert len(rows) == 800
    assert check_layout([(r.length, r.sequence_id, r.offset) for r in rows], 100) <= 1.02 * -(-sum(lengths) // 100) + 1


def test_items_that_never_fit_together_and_small_groups(spark):
    items = spark.range(50).selectExpr("id AS item", "60L AS length").repartition(6)
    rows = pack(items, 100, group_items=10).join(items, "item").collect()
    assert check_layout([(r.length, r.sequence_id, r.offset) for r in rows], 100) == 50


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, used = best_fit(np.array([5, 7, 3, 5]), 10)
    assert used.tolist() == [10, 10] and offsets[1] == 0 and bins[1] == bins[2]


def test_empty_table_and_wrong_lengths(spark):
    assert pack_documents(corpus(spark, [(1, "a")]).limit(0), default_tokenizer()).count() == 0
    with pytest.raises(Exception, match="capacity"):
        pack(spark.createDataFrame([(1, 0)], "item long, length long"), 100).count()


def test_words_that_share_a_hash(monkeypatch):
    """Whatever the hashes, ids are the tokenizer's: with a few bits of the first one, words clash in a
    chunk, and with words kept from earlier ones."""
    from tidepool.llm.packing import WordIds

    words = WordIds(default_tokenizer())
    real = WordIds.hashes
    monkeypatch.setattr(WordIds, "hashes", staticmethod(lambda w: (real(w)[0] & np.uint64(0x3F), real(w)[1])))
    rng = random.Random(3)
    plainly = []
    monkeypatch.setattr(WordIds, "_encode_plainly", lambda self, *a, run=WordIds._encode_plainly: plainly.append(1) or run(self, *a))
    for n in (1, 3, 3, 40, 2, 400):
        texts = [prose(rng, n), "", prose(rng, 2)]
        raw = "".join(texts).encode()
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        ids, at = words.encode(np.frombuffer(raw, np.uint8), offsets)
        for t, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
    assert 0 < len(plainly) < 6


def test_pairs_are_found_in_a_later_round(spark):
    """Many groups of one sequence each join nothing in the first merged round; the tree goes on."""
    items = spark.createDataFrame([(i, 40) for i in range(64)], "item long, length long").repartition(64)
    placed = pack(items, capacity=100, group_items=1000, fan_in=2).collect()
    assert check_layout([(40, r.sequence_id, r.offset) for r in placed], 100) == 32
