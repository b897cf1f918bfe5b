import random
import re

from tidepool.llm.licences import TEMPLATES, scan_licences

from .conftest import corpus, prose


def words(t):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().translate(table))


def pairs(w):
    return [(a, b) for a, b in zip(w, w[1:])]


def test_whole_templates_and_odd_cases(spark):
    rows = list(enumerate(TEMPLATES.values())) + [(None, "all RIGHTS\n\nreserved"), (0, TEMPLATES["MIT"]), (90, "reserved rights all"), (91, "all rights"), (92, None)]
    got = {(r.doc_id, r.licence) for r in scan_licences(corpus(spark, rows)).where("dice = 1").collect()}
    assert {(i, n) for i, n in enumerate(TEMPLATES)} <= got and (None, "all-rights-reserved") in got and not {d for d, _ in got} & {90, 91, 92}
    assert scan_licences(corpus(spark, rows).limit(0)).count() == 0
    assert scan_licences(corpus(spark, rows), {"none": "", "one": "word"}).count() == 0 and scan_licences(corpus(spark, rows), {}).count() == 0


def brute_any(t, text, threshold=0.8):
    """The best coefficient over windows of all lengths; of equal ones the shortest, then the first."""
    p, want, best = pairs(words(t)), set(pairs(words(text))), (0, 0, 0)
    for i in range(len(p)):
        got = set()
        for j in range(i, len(p)):
            got.add(p[j])
            if p[i] in want and p[j] in want:
                best = max(best, (2 * len(got & want) / (len(got) + len(want)), i - j, -i))
    return (round(best[0], 9), -best[2], 2 - best[1]) if best[0] >= threshold - 1e-12 else None


def test_windows_of_all_lengths_against_brute_force(spark):
    rng = random.Random(5)
    cases = [n for n in TEMPLATES if n in ("GPL-3.0-notice", "ISC", "MPL-2.0", "all-rights-reserved", "CC-BY-4.0")]
    for name in cases:
        whole, rows = [w.decode() for w in words(TEMPLATES[name])], []
        for i in range(24):
            w = list(whole)
            if i % 4 == 0:
                w = w[:int(len(w) * rng.uniform(0.6, 1))]  # amid prose, not at the text's end
            elif i % 4 == 1:
                w[len(w) // 2:len(w) // 2] = prose(rng, int(len(w) * rng.uniform(0.1, 0.5))).split()
            elif i % 4 == 2:
                w = w + prose(rng, 5).split() + w[:len(w) // 2] + w
            else:
                w[len(w) // 2:len(w) // 2] = w[len(w) // 3:len(w) // 2] * rng.randint(1, 4)
            rows.append((i, f"{prose(rng, rng.randint(0, 20))} {' '.join(w)} {prose(rng, rng.randint(0, 20))}"))
        got = {r.doc_id: (round(r.dice, 9), r.start, r.n_words) for r in scan_licences(corpus(spark, rows), {name: TEMPLATES[name]}).collect()}
        assert got == {i: b for i, t in rows if (b := brute_any(t, TEMPLATES[name]))} and len(got) > 8


def test_a_region_has_one_licence(spark):
    from tidepool.llm.licences import all_templates

    every = all_templates()
    assert {"GPL-2.0-full", "Apache-2.0-full", "MIT-full", "LGPL-3.0-notice", "CC-BY-SA-3.0"} <= set(every)
    rng = random.Random(7)
    gap = prose(rng, 400)
    whole = every["GPL-2.0-full"].split()
    del whole[500:600]
    rows = [(1, every["Apache-2.0-notice"]), (2, f"{gap} {every['GPL-2.0']} {gap}"), (3, f"{gap} {' '.join(whole)} {gap} {every['MIT-full']}"), (4, f"{TEMPLATES['ISC']} {gap} {TEMPLATES['MIT']}"), (5, "Licensed under CC BY-NC-SA 3.0.")]
    got = {}
    for r in scan_licences(corpus(spark, rows), every).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    assert got == {1: {"Apache-2.0-notice"}, 2: {"GPL-2.0"}, 3: {"GPL-2.0-full", "MIT-full"}, 4: {"ISC", "MIT"}, 5: {"CC-BY-NC-SA-3.0"}}
