"""Licence scans: document regions against licence templates by Dice coefficient.

Texts are normalised to words of letters and digits (A-Z lowered, all other
ASCII characters separate) and compared as sets of word bigrams:
``2 |A & T| / (|A| + |T|)``. For a template of n distinct bigrams a coefficient of t needs
regions of between t / (2 - t) and (2 - t) / t times n distinct bigrams, and at least
t / (2 - t) times n shared ones: these bounds leave few templates and places. There, the regions
are all windows that begin with a bigram of the template. Of all windows from a start, the best ends where
a bigram of the template comes for the first time, and before the start's own bigram comes again
(else the window from there is as good and shorter); all these are compared exactly.

One table of the templates' bigrams, whose size the template list bounds, goes to
the tasks; documents are read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Words, chunks, mix, record, text_of, word_runs

THRESHOLD = 0.8

# Licence statements and notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "all-rights-reserved": "All rights reserved.",
}

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivs", "BY-NC": "Attribution-NonCommercial",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivs"}
_GNU = {"GPL": ("GNU General Public License", ("1", "2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}


@cache
def all_templates() -> dict[str, str]:
    """TEMPLATES, the same statements for other versions, and the whole texts in ``licence_texts`` (``<name>-full``)."""
    more = {}
    for kind, (name, versions) in _GNU.items():
        for v in versions:
            v0 = v if "." in v else f"{v}.0"
            more[f"{kind}-{v0}"] = f"This {'library' if kind == 'LGPL' else 'work'} is licensed under the {name}, version {v}."
            notice = TEMPLATES["GPL-3.0-notice"].replace("GNU General Public License", name).replace("version 3", f"version {v}")
            more[f"{kind}-{v0}-notice"] = notice
            if kind == "LGPL":
                more[f"{kind}-{v0}-library-notice"] = notice.replace("This program", "This library")
    for v, where in {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}.items():
        for code, name in _CC.items():
            words = name.replace("NoDerivs", "NoDerivatives") if v == "4.0" else name
            more[f"CC-{code}-{v}-statement"] = f"This work is licensed under a Creative Commons {words} {v} {where} License."
            more[f"CC-{code}-{v}"] = f"Licensed under CC {code} {v}."
    for name, v in {"Apache-1.1": "Apache License, Version 1.1", "MPL-1.1": "Mozilla Public License, v. 1.1", "EPL-1.0": "Eclipse Public License, Version 1.0", "EPL-2.0": "Eclipse Public License, Version 2.0"}.items():
        more[name] = f"Licensed under the {v}."
    have = set(TEMPLATES.values())
    out = TEMPLATES | {name: text for name, text in more.items() if name not in TEMPLATES and text not in have}
    for f in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        out[f"{f.name.removesuffix('.txt')}-full"] = f.read_text(encoding="utf-8")
    return out


_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[[c for c in range(128) if not chr(c).isalnum()]] = 32


class _Table:
    """All templates' bigrams: which templates (by number) hold each."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.sets, self.length, keys, owner = list(templates), [], [], [], []
        for k, text in enumerate(templates.values()):
            grams = _bigrams(Words(_NORMAL[np.frombuffer(raw := text.encode(), np.uint8)], np.array([0, len(raw)])))[0]
            self.length.append(len(grams))
            grams = np.unique(grams)
            self.sets.append(grams)
            keys.append(grams)
            owner.append(np.full(len(grams), k))
        key, owner = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(owner) if owner else np.zeros(0, np.int64)
        by = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[by], return_index=True)
        self.first, self.owner = np.append(first, len(by)), owner[by]


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, with the document of each; pairs over two documents are left out."""
    if len(words) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = words.doc[:-1] == words.doc[1:]
    return mix(word_runs(words.hashes()).each(2))[inside], words.doc[:-1][inside]


def _windows(grams: np.ndarray, hits: np.ndarray, before: np.ndarray, after: np.ndarray, size: int, threshold: float) -> list[tuple[float, int, int, int]]:
    """(coefficient, first bigram, end, shared) of the best window from each hit of one template in one
    document; ``before`` and ``after`` are where each bigram stands next on either side."""
    need = max(1, int(np.ceil(threshold / (2 - threshold) * size - 1e-9)))
    most = int((2 - threshold) / threshold * size + 1e-9)
    out = []
    upto = np.searchsorted(hits, after[hits])
    for x in np.flatnonzero(upto - np.arange(len(hits)) >= need).tolist():
        i = int(hits[x])
        ends = hits[x:upto[x]]
        ends = ends[before[ends] < i]  # where a shared bigram comes for the first time
        if len(ends) < need:
            continue
        span = 2 * most + 2
        while True:  # distinct bigrams from i on, until there are too many
            distinct = np.cumsum(before[i:i + span] < i)
            if distinct[-1] > most or i + span > ends[-1]:
                break
            span *= 2
        shared = np.arange(need, len(ends) + 1)
        ends = ends[need - 1:]
        ends = ends[:np.searchsorted(ends, i + len(distinct))]
        if not len(ends):
            continue
        sizes = distinct[ends - i]
        dice = np.where(sizes <= most, 2 * shared[:len(ends)] / (sizes + size), 0.0)
        j = int(np.argmax(dice))
        if dice[j] >= threshold - 1e-12:
            out.append((float(dice[j]), i, int(ends[j]) + 1, int(shared[j])))
    return out


class _Apart:
    """Windows of which none covers another by half of the shorter one, by first bigram."""

    def __init__(self):
        self.kept, self.longest = [], 0

    def add(self, i: int, j: int) -> bool:
        """Keeps the window and says so, if that holds for it too."""
        near = self.kept[bisect_left(self.kept, (i - self.longest, 0)):bisect_left(self.kept, (j, 0))]
        if any(2 * (min(j, b) - max(i, a)) >= min(j - i, b - a) for a, b in near):
            return False
        insort(self.kept, (i, j))
        self.longest = max(self.longest, j - i)
        return True


def scan(table: _Table, words: Words, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(document, template, coefficient, first word, words) of the best region per document and
    template, over windows of all lengths. Where templates find the same region (windows that
    cover half of the shorter), it is that of the template that shares most bigrams with it, then of the
    best coefficient, then of the first template."""
    grams, doc = _bigrams(words)
    if not len(grams) or not len(table.keys):
        return []
    ends = np.searchsorted(doc, np.arange(doc[-1] + 2))
    place = np.minimum(np.searchsorted(table.keys, grams), len(table.keys) - 1)
    known = table.keys[place] == grams
    sizes = np.array([len(x) for x in table.sets])
    need = np.maximum(1, np.ceil(threshold / (2 - threshold) * sizes - 1e-9))
    out = []
    for d in range(len(ends) - 1):
        a, b = int(ends[d]), int(ends[d + 1])
        keys, counts = np.unique(place[a:b][known[a:b]], return_counts=True)
        if not len(keys):
            continue
        owners = np.concatenate([table.owner[table.first[k]:table.first[k + 1]] for k in keys.tolist()])
        able = np.flatnonzero((np.bincount(owners, minlength=len(sizes)) >= need) & (sizes > 0))
        if not len(able):
            continue
        local = grams[a:b]
        by = np.argsort(local, kind="stable")
        same = local[by][1:] == local[by][:-1]
        before, after = np.full(b - a, -1), np.full(b - a, b - a)
        before[by[1:][same]] = by[:-1][same]
        after[by[:-1][same]] = by[1:][same]
        regions = []
        for k in able.tolist():
            hits = np.flatnonzero(known[a:b] & np.isin(local, table.sets[k]))
            kept = _Apart()
            for dice, i, j, shared in sorted(_windows(local, hits, before, after, len(table.sets[k]), threshold), key=lambda w: (-w[0], w[2] - w[1], w[1])):
                if kept.add(i, j):
                    regions.append((-shared, -dice, k, i, j))
        kept, best = _Apart(), {}
        for _, dice, k, i, j in sorted(regions):
            if kept.add(i, j):
                best[k] = min(best.get(k, (1.0, 0, 0)), (dice, i, j))
        out += [(d, k, -dice, i, j - i + 1) for k, (dice, i, j) in sorted(best.items())]
    return out


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, start, n_words): the templates found in each
    document, with the best region (first word and words, in normalised words; the first
    of equally good ones).

    Regions have any length that the coefficient admits (of equally good ones the
    shortest, then the first), and where templates find the same region only the one that
    shares most with it is given.

    Null and empty texts, and templates of fewer than two words, match nothing; a null
    doc_id stays null; rows that repeat a doc_id count as one document with the best
    region of any; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_Table(TEMPLATES if templates is None else templates))
    schema = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        table = shared.value
        for batch, data, offsets in chunks(batches):
            found = scan(table, Words(_NORMAL[data], offsets), threshold)
            ids = batch.column("doc_id").to_pylist()
            yield record(schema, *(list(zip(*[(ids[d], table.names[k], *v) for d, k, *v in found])) or [[]] * 5))

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text).alias("text"))
    each = rows.mapInArrow(run, "doc_id long, licence string, dice double, start long, n_words long")
    best = each.groupBy("doc_id", "licence").agg(F.max(F.struct("dice", -F.col("start"), "start", "n_words")).alias("m"))
    return best.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "licence", "m.dice", "m.start", "m.n_words")
