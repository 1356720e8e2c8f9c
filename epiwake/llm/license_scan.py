"""License texts in documents, found by patience alignment with templates.

Words that occur exactly once in both text and template are anchors; the longest run of anchors that
increase in both is kept, and the gaps between them are aligned again in the same way. A gap without
unique common words is matched from its two ends. The share of template words that are aligned is
the coverage.

A template is only tried on texts that hold one of its rare words, and long texts are aligned in
windows around these, so the work follows the text's length.

Defined results: a null or empty text holds no license. Each row is looked at on its own, so repeated
rows, null ids and other columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import LOWER_NO_PUNCTUATION, arrow_rows

# License texts and notices, as published.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}
#: Share of a template's words that must be aligned; a notice of a few words must be whole.
MIN_COVERAGE, SHORT, MIN_SHORT_COVERAGE = 0.8, 20, 1.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_NO_PUNCTUATION).split()


def _longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    last_at: list[int] = []
    before = [-1] * len(values)
    for k, value in enumerate(values):
        at = bisect.bisect_left(tails, value)
        before[k] = last_at[at - 1] if at else -1
        tails[at:at + 1] = [value]
        last_at[at:at + 1] = [k]
    out, k = [], last_at[-1] if last_at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned positions (text, template), increasing in both."""
    aligned: list[tuple[int, int]] = []
    pending = [(0, len(text), 0, len(template))]
    while pending:
        a, b, c, d = pending.pop()
        while a < b and c < d and text[a] == template[c]:
            aligned.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            aligned.append((b, d))
        if a >= b or c >= d:
            continue
        once, other = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(text[a:b], a) if once[w] == 1}
        anchors = [(place[w], k) for k, w in enumerate(template[c:d], c) if other[w] == 1 and w in place]
        if not anchors:
            continue
        chosen = [anchors[k] for k in _longest_increasing([p for p, _ in anchors])]
        aligned.extend(chosen)
        edges = [(a - 1, c - 1), *chosen, (b, d)]
        pending.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]))
    return sorted(aligned)


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    start: int
    end: int


class Scanner:
    """Templates with the rare words that call for a closer look."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.words = {name: words_of(text) for name, text in templates.items()}
        shared = Counter(w for words in self.words.values() for w in set(words))
        #: Word -> templates that it calls up, with its places there: the words that fewest templates have.
        self.calls: dict[bytes, list[tuple[str, list[int]]]] = {}
        for name, words in self.words.items():
            within = Counter(words)
            # With at most a fifth of the words missing, one of these is there.
            need = len(words) if len(words) < SHORT else max(1, len(words) // 5 + 1)
            for word in sorted(within, key=lambda w: (shared[w] * within[w], -len(w), w))[:max(1, need if len(words) >= SHORT else 1)]:
                self.calls.setdefault(word, []).append((name, [k for k, w in enumerate(words) if w == word]))

    def scan(self, text: str | None) -> list[Match]:
        """The best match of each license that reaches its coverage; positions count words."""
        words = words_of(text)
        called = self.calls.keys() & set(words)
        if not called:
            return []
        starts: dict[str, set[int]] = {}
        for k, word in enumerate(words):
            if word in called:
                for name, places in self.calls[word]:
                    starts.setdefault(name, set()).update(k - p for p in places)
        found = []
        for name, begins in sorted(starts.items()):
            template = self.words[name]
            best: Match | None = None
            for low, high in self._windows(begins, len(template), len(words)):
                pairs = patience(words[low:high], template)
                coverage = len(pairs) / len(template)
                least = MIN_SHORT_COVERAGE if len(template) < SHORT else MIN_COVERAGE
                if coverage >= least and (best is None or coverage > best.coverage):
                    best = Match(name, round(coverage, 4), low + pairs[0][0], low + pairs[-1][0] + 1)
            if best:
                found.append(best)
        return found

    @staticmethod
    def _windows(begins: set[int], size: int, end: int) -> Iterator[tuple[int, int]]:
        """Parts of the text in which the template may stand, with half its length of slack for a
        longer template; starts near each other share a window of at most four lengths."""
        slack = size // 2 if size >= SHORT else 0
        ordered = sorted(begins)
        k = 0
        while k < len(ordered):
            first = last = ordered[k]
            while k < len(ordered) and ordered[k] - first <= slack:
                last = ordered[k]
                k += 1
            yield max(0, first - slack // 2), min(end, last + size + slack)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses, licenses, best_coverage, matches) per document of (doc_id, text)."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        scanner = Scanner(templates)
        for doc_id, text in stream:
            found = scanner.scan(text)
            yield (doc_id, len(found), ",".join(m.license for m in found), max((m.coverage for m in found), default=0.0),
                   [dict(license=m.license, coverage=m.coverage, start=m.start, end=m.end) for m in found])

    return arrow_rows(docs, ["doc_id", "text"], run,
                      "doc_id long, n_licenses long, licenses string, best_coverage double, "
                      "matches array<struct<license:string,coverage:double,start:long,end:long>>")
