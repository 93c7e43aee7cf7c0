"""License scans by patience alignment.

A template and a stretch of text are aligned on words that occur once in each: their longest increasing subsequence
anchors the alignment, the gaps between anchors are aligned in the same way, and equal words next to an anchor extend
it. The share of the template's words that are matched is its coverage.

Where to align: first the whole text, however far apart the parts of a license stand; of the text only the words that the
template has, as no other can be matched. Words that a text repeats are no anchors, so a repeated notice could hide itself:
stretches of the text are aligned too, and the best alignment counts. Coverage of MIN_COVERAGE leaves at most a certain
number of template words unmatched, so of one more than that number of its rarest words at least one must be in the text.
Every occurrence of such a word gives a stretch around the place where the template would lie. Texts and stretches that
hold too few of the template's words are left out, which loses none. Stretches for full license texts (`licenses/`) are
coarser and take in the finer ones. One pass, no shuffle.

Short notices and headers differ from each other, and from plain prose, in a word or two: their telling phrases must be
matched word by word without a gap.

Defined cases: null and empty texts have no license; ties go to the template listed first; rows of equal doc_id are
scanned each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_COVERAGE = 0.6
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: License notices.
TEMPLATES = {
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
#: Name to the phrases that must be matched without a gap.
TELLING = {
    "gpl-3.0-notice": ("gnu general public license", "version 3"),
    "cc-by-nc-4.0-notice": ("cc by-nc 4.0",),
    "mit-notice": ("mit license",),
    "apache-2.0-notice": ("apache license", "version 2.0"),
    "gpl-3.0-header": ("gnu general public license", "version 3"),
}
for _name in ("BSD", "ISC", "zlib", "Artistic", "Unlicense"):
    TEMPLATES[f"{_name.lower()}-notice"] = f"Released under the {_name} License."
    TELLING[f"{_name.lower()}-notice"] = (f"{_name.lower()} license",)
for _kind, _long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _area in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic")):
        TEMPLATES.setdefault(f"cc-{_kind}-{_v}-notice", f"Licensed under CC {_kind.upper()} {_v}.")
        TELLING[f"cc-{_kind}-{_v}-notice"] = (f"cc {_kind} {_v}",)
        TEMPLATES[f"cc-{_kind}-{_v}-long-notice"] = f"This work is licensed under a Creative Commons {_long} {_v} {_area} License."
        TELLING[f"cc-{_kind}-{_v}-long-notice"] = (f"creative commons {_long.lower()} {_v}",)
for _id, _family, _v in (("gpl", "GNU General", "2"), ("lgpl", "GNU Lesser General", "2.1"), ("lgpl", "GNU Lesser General", "3"), ("agpl", "GNU Affero General", "3"), ("mpl", "Mozilla", "1.1"), ("mpl", "Mozilla", "2.0"), ("epl", "Eclipse", "1.0"), ("epl", "Eclipse", "2.0")):
    _name = f"{_id}-{_v if '.' in _v else _v + '.0'}"
    TELLING[f"{_name}-notice"] = (f"{_family.lower()} public license", f"version {_v}")
    TEMPLATES[f"{_name}-notice"] = f"This work is licensed under the {_family} Public License, version {_v}."
    if _id.endswith("gpl"):
        TELLING[f"{_name}-header"] = TELLING[f"{_name}-notice"]
        TEMPLATES[f"{_name}-header"] = TEMPLATES["gpl-3.0-header"].replace("GNU General", _family).replace("version 3", f"version {_v}")


@cache
def bodies() -> dict[str, str]:
    """Full license texts by name."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in the order of their first part, whose second parts increase too."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tails, y)
        back.append(at[p - 1] if p else -1)
        tails[p : p + 1] = [y]
        at[p : p + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words' positions, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i == j or p == q:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[p:q])
        where = {w: k for k, w in enumerate(b[p:q], p) if cb[w] == 1}
        anchors = _increasing([(k, where[w]) for k, w in enumerate(a[i:j], i) if ca[w] == 1 and w in where])
        if anchors:
            out += anchors
            edges = [(i - 1, p - 1), *anchors, (j, q)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates prepared for scanning."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE, texts: dict[str, str] | None = None, telling: dict[str, tuple[str, ...]] | None = None):
        self.templates, self.bodies = self._prepared(templates, min_coverage), self._prepared(texts or {}, min_coverage)
        self.any = sorted({w for *_, marks in self.templates for w in marks})
        self.body_words = {w for _, ws, *_ in self.bodies for w in ws}
        self.least_body = min((need for *_, need, _ in self.bodies), default=0)
        self.telling: dict[str, list[tuple[int, int]]] = {}
        # a template can't be told in a text without all words of its telling phrases
        self.telling_words: dict[str, set[str]] = {}
        for name, phrases in (telling or {}).items():
            ws = words_of(templates.get(name, ""))
            spans = [(k, k + len(p)) for p in map(words_of, phrases) for k in range(len(ws)) if ws[k : k + len(p)] == p]
            self.telling[name] = spans
            self.telling_words[name] = {w for i, j in spans for w in ws[i:j]}
        self.all_telling = set().union(*self.telling_words.values())

    @staticmethod
    def _prepared(templates: dict[str, str], min_coverage: float) -> list[tuple]:
        out = []
        common = Counter(w for t in templates.values() for w in set(words_of(t)))
        for name, text in templates.items():
            ws = words_of(text)
            need = max(1, math.ceil(min_coverage * len(ws) - 1e-9))
            rare = sorted(range(len(ws)), key=lambda k, ws=ws: (common[ws[k]], -len(ws[k]), k))[: len(ws) - need + 1]
            seldom = {ws[r] for r in rare}
            marks: dict[str, list[int]] = {}
            for k, w in enumerate(ws):
                if w in seldom:
                    marks.setdefault(w, []).append(k)
            out.append((name, ws, Counter(ws), need, marks))
        return out

    def _told(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        at = {y: x for x, y in pairs}
        return all(all(at.get(k, -1) == at.get(i, -1) + k - i for k in range(i, j)) and i in at for i, j in self.telling.get(name, ()))

    def scan(self, text: str) -> tuple[str, float, int, int] | None:
        """(name, coverage, matched words, position of the first matched word) of the best template, if any is covered enough."""
        low = text.lower()
        if not self.bodies and not any(w in low for w in self.any):
            return None
        ws = WORD.findall(low)
        held = Counter(w for w in ws if w in self.body_words)
        tells = self.all_telling.intersection(ws)
        chosen = [(order, t) for order, t in enumerate(self.templates) if self.telling_words.get(t[0], set()) <= tells]
        if self.bodies and held.total() >= self.least_body:
            for order, t in enumerate(self.bodies, len(self.templates)):
                if sum(min(n, c) for x, n in t[2].items() if (c := held.get(x))) >= t[3]:
                    chosen.append((order, t))
        marked = {w for _, (*_, marks) in chosen for w in marks}
        at: dict[str, list[int]] = {}
        for k, w in enumerate(ws):
            if w in marked:
                at.setdefault(w, []).append(k)
        if not at:
            return None
        best = None
        for order, (name, t, count, need, marks) in chosen:
            own = [k for k, w in enumerate(ws) if w in count]
            if sum(min(n, count[x]) for x, n in Counter(ws[k] for k in own).items()) < need:
                continue
            pairs = [(own[x], y) for x, y in align([ws[k] for k in own], t)]
            if len(pairs) >= need and self._told(name, pairs):
                key = (len(pairs) / len(t), len(pairs), -order, -pairs[0][0])
                if best is None or key > best[0]:
                    best = (key, name)
            slack = len(t) // 4 + 4
            step = slack if order >= len(self.templates) else 1
            seen: set[int] = set()
            for w, offsets in marks.items():
                for k in at.get(w, ()):
                    for o in offsets:
                        lo = (k - o - slack) // step * step
                        if lo in seen:
                            continue
                        seen.add(lo)
                        part = ws[max(0, lo) : lo + 2 * slack + len(t) + step - 1]
                        if sum(min(n, c) for x, n in Counter(part).items() if (c := count.get(x))) < need:
                            continue
                        pairs = align(part, t)
                        if len(pairs) >= need and self._told(name, pairs):
                            key = (len(pairs) / len(t), len(pairs), -order, -(max(0, lo) + pairs[0][0]))
                            if best is None or key > best[0]:
                                best = (key, name)
        if best is None:
            return None
        (coverage, n, _, start), name = best
        return name, coverage, n, -start


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license (null if none), coverage (to 6 digits), n_matched and start_word of every document."""
    chosen, texts, telling = (TEMPLATES, bodies(), TELLING) if templates is None else (templates, {}, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, min_coverage, texts, telling)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = [scanner.scan(t) if t else None for t in part.column("text").to_pylist()]
                full = [(g[0], round(g[1], 6), g[2], g[3]) if g else (None, 0.0, 0, None) for g in got]
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([f[k] for f in full], kind) for k, kind in enumerate(kinds))], names=["doc_id", "license", "coverage", "n_matched", "start_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, start_word long")
