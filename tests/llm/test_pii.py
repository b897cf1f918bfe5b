import hashlib
import random
import re

from tidepool.llm.pii import KINDS, base_spans, find_personal_data, luhn, redact_documents

from .conftest import corpus, prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[k]
            if good:
                out.append((KINDS.index(k), m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_by_definition():
    rng = random.Random(4)
    parts = ["a.b+c@mail.example.com", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "0255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "é", "\n", " ", "4111111111111111", "+44 20 7946 0958", "00000000000000000000", "10.0.0.1@h.io"]
    for _ in range(400):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", ",", "é"]) for _ in range(rng.randint(0, 9)))
        assert base_spans(t) == plain(t), t


def test_result_of_odd_rows(spark, odd_rows):
    rows = odd_rows + [(50, "mail é a@b.co and 10.0.0.7, call +1 (555) 010-9999"), (51, "4111 1111 1111 1111")]
    got = find_personal_data(corpus(spark, rows)).collect()
    want = []
    for i, t in rows:
        s = plain(t or "")
        want.append((i, *[sum(k == j for k, _, _ in s) for j in range(4)], digest(s)))
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    assert find_personal_data(corpus(spark, rows).limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(5)
    rows = [(i, f"{prose(rng, 5)} hotline number +1 (555) 010-{1000 + i} {prose(rng, 5)}") for i in range(12)]
    rows += [(100, "our hotline number 555-0199-22 is open"), (101, "in the year 2024 and room 5550 of many"), (102, "the order no 555-0199-99 of many")]
    got = {r.doc_id: r for r in find_personal_data(corpus(spark, rows)).collect()}
    assert got[100].spans == "phone:19:30" and got[100].n_added == 1 and got[100].n_phone == 0
    assert got[101].n_added == 0 and got[102].n_added == 0
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(12))
    # a few places of one copied text are no support
    few = [(i, "hotline number +1 (555) 010-1234 x") for i in range(9)] + [(100, "our hotline number 555-0199-22 is open")]
    assert {r.n_added for r in find_personal_data(corpus(spark, few)).collect()} == {0}


def test_redaction_keeps_rows_and_columns(spark, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(i + 60, f"{prose(rng, 4)} hotline number +1 (555) 010-{1000 + i} ok") for i in range(9)] + [(100, "our hotline number 555-0199-22 is open"), (None, "a@b.co 4111 1111 1111 1111")]
    docs = corpus(spark, rows)
    out = redact_documents(docs)
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert (100, "our hotline number [PHONE] is open", 34) in texts and (None, "[EMAIL] [CARD]", 14) in texts and (1, None, 0) in texts
    assert out.count() == len(rows)


def naive_discovery(rows, support=3, trust=0.8, accept=0.9):
    """The bootstrapping by its description, on (doc_id, text) rows: spans added per row."""
    import math

    low = lambda w: w.lower() if len(w) <= 100 else hashlib.sha256(w.lower().encode()).hexdigest()
    places = []
    for n, (_, t) in enumerate(rows):
        t = t or ""
        base = plain(t)
        found = list(base)
        for m in re.finditer(r"[^\s\"'<>{}\[\]|,;]+", t):
            a, b = m.span()
            while a < b and t[a] in "().:!?#*$%&-_=~`":
                a += 1
            while b > a and t[b - 1] in "().:!?#*$%&-_=~`":
                b -= 1
            if b - a >= 4 and ("@" in t[a:b] or sum(c in "0123456789" for c in t[a:b]) >= 3) and not any(s < b and e > a for _, s, e in base):
                found.append((None, a, b))
        for k, a, b in found:
            before, after = [low(w) for w in re.findall(r"\S+", t[:a])][-2:], [low(w) for w in re.findall(r"\S+", t[b:])][:1]
            pats = [f"{before[-1]}_"] if before else []
            pats += [f"{before[0]} {before[1]}_"] if len(before) == 2 else []
            pats += [f"_{after[0]}"] if after else []
            pats += [f"{before[-1]}_{after[0]}"] if before and after else []
            places.append((n, k, a, b, low(t[a:b]), pats))
    edges = {(p, i) for *_, i, ps in places for p in ps}
    known = {}
    for _, k, _, _, i, _ in places:
        if k is not None:
            known[i] = (min(k, known.get(i, (k, 1.0))[0]), 1.0)
    seeds, rounds = set(known), 0
    while True:
        rounds += 1
        of = {}
        for p, i in edges:
            of.setdefault(p, set()).add(i)
        trusted = {}
        for p, members in of.items():
            for k in range(4):
                mine = [known[i][1] for i in members if i in known and known[i][0] == k]
                if len(mine) >= support and len(members) >= support and sum(mine) / len(members) >= trust:
                    trusted[p, k] = sum(mine) / len(members)
        fresh = {}
        for i in {i for _, i in edges} - set(known):
            for k in range(4):
                doubts = [math.log(max(1 - trusted[p, k], 0.01)) for p, j in edges if j == i and (p, k) in trusted]
                if doubts and (score := 1 - math.exp(sum(doubts))) >= accept and score > fresh.get(i, (0, 0.0))[1]:
                    fresh[i] = (k, score)
        if not fresh:
            break
        known |= fresh
    return {n: sorted((known[i][0], a, b) for m, k, a, b, i, _ in places if m == n and k is None and i in known and i not in seeds) for n in range(len(rows))}, rounds


def test_discovery_against_its_description(spark):
    """A chain of contexts, each of which is learnt from what the one before found, longer than any fixed number of rounds."""
    rng = random.Random(11)
    rows = []
    for i in range(64):  # seeds in the first context, and as many codes
        rows.append((len(rows), f"{prose(rng, 3)} hotline number +1 (555) 010-{1000 + i} {prose(rng, 2)}"))
    for step in range(6):  # half as many new codes stand in each next context beside those of the one before
        for j in range(64 >> step):
            code, context = f"C{step}{j:03}-77", "hotline number" if step == 0 else f"alpha{step} beta{step}"
            rows.append((len(rows), f"{prose(rng, 3)} {context} {code} {prose(rng, 2)}"))
            rows.append((len(rows), f"{prose(rng, 3)} alpha{step + 1} beta{step + 1} {code} {prose(rng, 2)}"))
    rows += [(len(rows) + i, f"see {'w' * 300} 12345{i} {'v' * 500} in http://x.y/{'z' * 400}/99{i}") for i in range(5)]
    rows += [(len(rows), None), (len(rows) + 1, "a@b.co,c@d.co 1.2.3.4x")]
    want, rounds = naive_discovery(rows, trust=0.45, accept=0.7)
    got = find_personal_data(corpus(spark, rows), trust=0.45, accept=0.7).collect()
    added = {}
    for r in got:
        spans = [tuple(map(int, (KINDS.index(x.split(":")[0]), *x.split(":")[1:]))) for x in r.spans.split(",") if x]
        base = plain(dict(rows)[r.doc_id] or "")
        added[r.doc_id] = sorted(s for s in spans if s not in base)
        assert r.n_added == len(added[r.doc_id])
    assert added == want and rounds > 4 and sum(map(len, want.values())) > 100
