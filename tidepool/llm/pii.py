"""Personal data by bootstrapped contextual extraction.

*Seeds* are what fixed patterns for emails, addresses, cards and phone numbers
find. Each identifier-like token -- a seed or any other token with an ``@`` or at
least three digits -- is an *instance* (its string), and the words around it are
lexical *patterns* (one word before, two before, one after, one on each side).
Spark scores the graph of patterns and instances in rounds: a pattern's
confidence for a kind is the share of its distinct instances that are of the
kind, once ``MIN_SUPPORT`` are; an instance's is that at least one of its
confident patterns is right. Instances over ``ACCEPT`` join the seeds of the next
round, and their places are added to the result, until a round adds none; what the fixed
patterns found always stays.

Each round groups distinct (pattern, instance) edges, so neither a frequent pattern
nor a copied text piles up rows, and no list of instances leaves the executors.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, cut, record, spare, text_of

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
TRUST = 0.8  # least confidence of a pattern that counts
ACCEPT = 0.9

# The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Where identifier-like tokens can be: runs without white space, quotes or brackets, with a digit or an @.
_TOKEN = re.compile(r"[^\s\"'<>{}\[\]|,;]+")
_TRIM = "().:!?#*$%&-_=~`"
_WORD = re.compile(r"[^\s]+")
_IDENTIFIER = re.compile(r"[0-9@]")
#: Instances and context words longer than this are known by their hash.
_KNOWN_CHARS = 100


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kinds by their place in ``KINDS``."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _short(text: str) -> str:
    return text if len(text) <= _KNOWN_CHARS else hashlib.sha256(text.encode()).hexdigest()


def _patterns(text: str, starts: list[int], ends: list[int], start: int, end: int) -> list[str]:
    """The lexical patterns of a place, from the whole words before and after it (a word that the
    place is part of counts with what is left of it); ``starts``, ``ends``: all words of the text."""
    word = lambda a, b: _short(text[a:b].lower())
    k = bisect_left(starts, start)  # words that begin before the place
    before = [word(starts[i], min(ends[i], start)) for i in range(max(0, k - 2), k)]
    j = bisect_right(ends, end)  # the first word that ends behind it
    after = word(max(starts[j], end), ends[j]) if j < len(ends) else ""
    last = before[-1] if before else ""
    out = [f"{last}_"] if last else []
    if len(before) == 2:
        out.append(f"{before[0]} {last}_")
    if after:
        out.append(f"_{after}")
        if last:
            out.append(f"{last}_{after}")
    return out


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens, whole, that touch no base span."""
    if not spans and not _DIGIT.search(text) and "@" not in text:
        return []
    out, taken, k = [], sorted((s, e) for _, s, e in spans), 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _IDENTIFIER.search(token):
            continue
        start, end = m.start() + len(token) - len(token.lstrip(_TRIM)), m.start() + len(token.rstrip(_TRIM))
        if end - start < 4 or ("@" not in text[start:end] and len(_NOT_DIGIT.sub("", text[start:end])) < 3):
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if any(s < end and e > start for s, e in taken[max(k - 1, 0):k + 8]):
            continue
        out.append((start, end))
    return out


_PLACE = "struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>"


def facts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, tag (hash of the text) and its places: base spans
    (kind 0 to 3) and other identifier-like tokens (kind null), with instance and patterns."""
    place = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("places", pa.list_(place))])

    def of(t: str):
        spans = base_spans(t)
        found = [(k, s, e) for k, s, e in spans] + [(None, s, e) for s, e in _candidates(t, spans)]
        if not found:
            return []
        starts, ends = zip(*(m.span() for m in _WORD.finditer(t)))
        return [{"kind": k, "start": s, "end": e, "instance": _short(t[s:e].lower()), "patterns": _patterns(t, starts, ends, s, e)} for k, s, e in found]

    def run(batches):
        for batch, _, _ in chunks(batches):
            texts = batch.column("text")
            yield record(schema, batch.column("doc_id"), batch.column("tag"), [of(t.as_py()) for t in texts])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("tag"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, tag long, places array<{_PLACE}>")


def discover(found: DataFrame, support: int = MIN_SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind, score) of instances beyond the seeds, from ``facts``.

    An accepted instance keeps its kind and score; rounds go on until one accepts no more, so
    there are at most as many as instances.
    """
    places = found.select(F.explode("places").alias("p")).select("p.*")
    edges = cut(places.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii-edges")
    seeds = places.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known = cut(seeds, "pii-seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    sizes = cut(sizes, "pii-patterns")
    rounds: list[DataFrame] = []
    while True:
        scored = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
        trusted = scored.where(F.col("c") >= support).join(sizes, "pattern").withColumn("trust", F.col("s") / F.col("n")).where(F.col("trust") >= trust)
        # at least one of the trusted patterns is right
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(0.01))))
        held = edges.join(trusted.select("pattern", "kind", "trust"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = held.where(F.col("score") >= accept).groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"), "kind")).alias("m")).select("instance", "m.kind", "m.score")
        fresh = cut(best.join(known.select("instance"), "instance", "left_anti"), f"pii-round{len(rounds)}")
        rounds.append(fresh)
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        known = cut(known.unionByName(fresh.select(*known.columns)), "pii-known")


def _added(found: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """Places of discovered instances: (*keys, added array<struct<kind, start, end>>)."""
    more = found.select(*keys, F.explode("places").alias("p")).where("p.kind is null").select(*keys, "p.start", "p.end", "p.instance").join(fresh, "instance")
    return more.groupBy(*keys).agg(F.collect_set(F.struct(F.col("kind"), F.col("start"), F.col("end"))).alias("added"))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)
    for every row; the counts and the digest are of the base spans, ``spans`` holds all as
    kind:start:end in code points, by kind and start.

    A null text counts as empty; empty texts have no spans; a null doc_id stays
    null; repeated rows give repeated results (and count once as context); an
    empty table gives no rows.
    """
    found = cut(facts(docs, key, text).withColumn("_row", F.monotonically_increasing_id()), "pii-facts")
    more = _added(found, discover(found, **options), "_row")
    plain = F.transform(F.filter("places", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    out = found.select("doc_id", "_row", plain.alias("base")).join(more, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda p: F.concat_ws(":", names[p["kind"]], p["start"], p["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(F.col("doc_id").alias(key), *[count(k) for k in range(4)], F.sha2(F.encode(shown(F.array_sort("base")), "UTF-8"), 256).alias("base_sha256"), shown(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with [KIND] for each span; overlapping spans are one, of the kind of the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """All rows and columns, the text redacted and its length brought up to
    date; a null text stays null. Base spans are found in the text at hand,
    discovered ones join by document and text hash."""
    found = cut(facts(docs, key, text), "pii-facts")
    more = _added(found, discover(found, **options), "doc_id", "tag").select(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)), "tag").alias(place := spare(docs, "_place")), F.col("added").alias(added := spare(docs, "_added")))
    joined = docs.withColumn(place, F.struct(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), F.xxhash64(text_of(text)))).join(more, place, "left")

    names, at, schema = docs.columns, docs.columns.index(text), docs.schema

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in a or ()]) for t, a in zip(batch.column(text).to_pylist(), batch.column(added).to_pylist())]
            yield batch.select(names).set_column(at, pa.field(text, pa.string()), pa.array(texts, pa.string()))

    out = joined.select(*[F.col(f"`{c}`") for c in names], F.col(added)).mapInArrow(run, schema)
    return out.withColumn(length, F.coalesce(F.length(text), F.lit(0)).cast("long")) if length in docs.columns else out
