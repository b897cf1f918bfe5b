import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest

from tests.llm.conftest import prose
from tidepool.llm.tokenmap import align_tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def gpt_bytes(entry):
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, extra = {}, 0
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return bytes(table[c] for c in entry)


def whole_text(text, a, b):
    """Tokens of the whole text at once: (A ids and byte ranges, B's), or none."""
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    out = []
    for ids, raw in ((ids_a, [gpt_bytes(a.id_to_token(i)) for i in ids_a]), (ids_b, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b])):
        if b"".join(raw) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, r in zip(ids, raw):
            spans.append((i, at, at + len(r)))
            at += len(r)
        out.append(spans)
    return out


def want(rows, a, b):
    spans = [whole_text(t, a, b) for _, t in rows]
    links = []
    for x, y in spans:
        ends = [e for _, _, e in y]
        links.append([(i, y[k][0]) for i, s, e in x for k in range(bisect_left(ends, s + 1), len(y)) if y[k][1] < e])
    count = Counter(p for ls in links for p in ls)
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for (doc, _), (x, y), ls in zip(rows, spans, links):
        shared = sorted({e for _, _, e in x} & {e for _, _, e in y})
        sides = [[[] for _ in shared] for _ in range(2)]
        for side, toks in zip(sides, (x, y)):
            for i, _, e in toks:
                side[bisect_left(shared, e)].append(str(i))
        text = ";".join(",".join(p) + "|" + ",".join(q) for p, q in zip(*sides))
        out.append((doc, len(x), len(y), len(shared), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(9)
    base = prose(rng, 200)
    alphabet = ["a", "the", "Éa", " ", "  ", "   ", "\n", "\n\n", "\t", "\xa0", "　", " ", "\u0085", "\x1c", "\x00", "▁", "1", "12345", "'s", "...", "€", "😀", "é", "́", "<|endoftext|>", "<s>", "<0x41>", "日本", "​", "\r\n", "٣", "x" * 50, " ", " ", "\x7f", "ﬁ"]
    texts = [None, "", " ", "  ", "x", " x", "x ", "x  ", "  x", base, base, base, base.upper(), "▁x", "a ▁ b", "a\xa0 b", "a \xa0 b", "\n", "a \n b", "x" * 3000, "word " * 4000, "a" + " " * 500 + "b", prose(rng, 3000)]
    return texts + ["".join(rng.choice(alphabet) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 30))) for _ in range(400)]


def test_against_whole_texts(spark, libraries):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "again"), (0, "again"), (None, texts[9])]
    docs = spark.createDataFrame([(*r, "x", 1, "x", 2) for r in rows], "doc_id long, text string, key string, n long, kind string, n_a int")
    expected = want(rows, *libraries)
    for parts, chunk in ((5, 4000), (2, 6 << 20)):
        got = align_tokenizers(docs.repartition(parts), A, B, chunk).collect()
        assert sorted(map(tuple, got), key=str) == expected


def test_nothing_to_align(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align_tokenizers(docs, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align_tokenizers(docs.limit(0), A, B).count() == 0
    bad = spark.createDataFrame([(1, "▁x"), (2, "▁x")], "doc_id long, text string")
    assert [r["n_links"] for r in align_tokenizers(bad, A, B).collect()] == [0, 0]
