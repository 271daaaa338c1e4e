"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every token run of every template. Files stream through it token by token: each position's matching
statistic is the longest run that ends there and stands in some template; the suffix links from it lead to the templates
that hold a shorter run only. For each place of each template, the runs of at least ``MIN_RUN`` tokens (or of a whole
template, where that is shorter) that can be extended to neither side are chained in order; a chain that covers at least
``COVER`` of a template is a span.

Templates are full texts, headers (under their SPDX identifier), notices in running text, and SPDX lines for every
identifier. Templates of at most
``NOTICE`` tokens, in which one token can be another version, must be covered whole, and one of fewer than ``MIN_RUN``
tokens by a single run. ``GAP`` is the most tokens of the file
that may stand between two runs of a chain (a name, a year, a comment sign).

Defined cases: null and empty texts have no span; tokens are runs of letters and digits, in lower case, so punctuation
and line breaks do not matter; of spans that overlap the one with most matched tokens stays, ties going to the
greater coverage, then the earlier start, then the template's name; rows with a null doc_id are scanned like others;
repeated rows give repeated spans; further columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_slices

MIN_RUN, COVER, GAP, NOTICE = 4, 0.75, 12, 12
TOKEN = re.compile(r"[^\W_]+")
SCHEMA = "doc_id bigint, license string, start_token int, end_token int, matched int, coverage double"

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}


def _gnu(work: str, family: str, version: str) -> str:
    """The header that files under a GNU licence carry."""
    return TEMPLATES["GPL-3.0"].replace("This program", f"This {work}").replace("this program", f"this {work}").replace("General Public", f"{family}General Public").replace("version 3", f"version {version}")


#: Close relatives of the above, each under its own name, so that they compete for a span.
TEMPLATES |= {
    **{f"GPL-{v}.0": _gnu("program", "", v) for v in ("1", "2")},
    **{f"AGPL-{v}.0": _gnu("program", "Affero ", v) for v in ("1", "3")},
    **{f"LGPL-{v}": _gnu("library", "Lesser " if v != "2.0" else "Library ", v.removesuffix(".0")) for v in ("2.0", "2.1", "3.0")},
    **{f"LGPL-{v}-program": _gnu("program", "Lesser " if v != "2.0" else "Library ", v.removesuffix(".0")) for v in ("2.0", "2.1", "3.0")},
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-2-Clause": TEMPLATES["BSD-3-Clause"].split(" Neither the name")[0],
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    **{f"GPL-{v}.0-notice": f"This work is licensed under the GNU General Public License, version {v}." for v in ("1", "2")},
    **{f"LGPL-{v}-notice": f"This work is licensed under the GNU Lesser General Public License, version {v.removesuffix('.0')}." for v in ("2.1", "3.0")},
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    **{f"CC-{k}-4.0-notice": f"Licensed under CC {k} 4.0." for k in ("BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC-BY-4.0-short-notice": "Licensed under CC BY 4.0.",
    **{
        f"CC-{k}-4.0-long-notice": f"This work is licensed under a Creative Commons Attribution-{what} 4.0 International License."
        for k, what in {"BY-SA": "ShareAlike", "BY-ND": "NoDerivatives", "BY-NC": "NonCommercial", "BY-NC-SA": "NonCommercial-ShareAlike", "BY-NC-ND": "NonCommercial-NoDerivatives"}.items()
    },
}
_NAMES = {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"], "ISC": ["ISC License"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"], "Unlicense": ["Unlicense License"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2"], "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1"], "LGPL-3.0": ["GNU Lesser General Public License v3.0"], "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU AGPL v3"],
    "EPL-2.0": ["Eclipse Public License 2.0"], "CC0-1.0": ["CC0 1.0 Universal"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0"],
}
TEMPLATES |= {
    f"{k}-{article}{i}-notice": f"under {article} {name}" for k, names in _NAMES.items() for i, name in enumerate(names, 1) for article in ("the", "an" if name[0] in "AEIMU" else "a")
}
#: Lines that name a licence by its identifier, as source files carry them.
_IDS = sorted({*_NAMES, *(file.stem for file in (Path(__file__).parent / "license_texts").glob("*.txt")), "EPL-2.0", "Python-2.0", "PostgreSQL", "MS-PL", "Artistic-2.0"})
TEMPLATES |= {
    f"{k}{end}-spdx": f"SPDX-License-Identifier: {k}{end}" for k in _IDS for end in (("", "-only", "-or-later") if "GPL" in k or k.startswith("GFDL") else ("",))
}
#: The full texts, of which the above are headers and notices.
TEMPLATES |= {f"{file.stem}-text": file.read_text("utf-8") for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of token lists; each state knows where, in which lists, its longest run ends."""

    def __init__(self, lists: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for which, words in enumerate(lists):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((which, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves), self.length.append(length), self.link.append(link), self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def steps(self, words: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest match that ends at each token, where it has at least ``least`` tokens."""
        moves, link, length = self.next, self.link, self.length
        state, size = 0, 0
        for i, word in enumerate(words, 1):
            to = moves[state].get(word)
            while state and to is None:
                state = link[state]
                to = moves[state].get(word)
                size = length[state]
            state, size = (to, size + 1) if to is not None else (0, 0)
            if size >= least:
                yield i, size, state

    def runs(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches of at least ``least`` tokens: those that the next token ends."""
        return [(i, n, s) for i, n, s in self.steps(words, least) if i == len(words) or words[i] not in self.next[s]]

    def hits(self, words: list[str], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(list, start in words, start in list, length) of the matches with each place that neither side extends."""
        moves, link, length, ends = self.next, self.link, self.length, self.ends
        none: set[tuple[int, int]] = set()
        for i, n, s in self.steps(words, least):
            longer = none  # places where more than n tokens match
            while n >= least:
                to = moves[s].get(words[i]) if i < len(words) else None
                on = ends[to] if to is not None else none
                if len(on) < len(ends[s]):  # else the next token extends the match at all places
                    for which, at in ends[s]:
                        if (which, at + 1) not in on and (which, at) not in longer:
                            yield which, i - n, at - n, n
                longer, s = ends[s], link[s]
                n = length[s]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        lists = [tokens(templates[n]) for n in self.names]
        self.sizes = [len(x) for x in lists]
        self.least = min([MIN_RUN, *[n for n in self.sizes if n]])
        self.whole = {i for i, n in enumerate(self.sizes) if n < MIN_RUN}
        self.automaton = Automaton(lists)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(license, start, end, matched, coverage) of the spans in a text, in order."""
        if not text:
            return []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for which, start, at, size in self.automaton.hits(tokens(text), self.least):
            if size >= MIN_RUN or which in self.whole and size == self.sizes[which]:
                by.setdefault(which, []).append((start, at, size))
        enough = [(which, hits) for which, hits in by.items() if sum(h[2] for h in hits) >= self._enough(which)]
        spans = [s for which, hits in enough for s in self._chains(which, sorted(hits))]
        spans.sort(key=lambda s: (-s[3], -s[4], s[1], s[0]))
        starts: list[int] = []
        taken: list[tuple[str, int, int, int, float]] = []  # apart from each other and in order, so neighbours tell
        for s in spans:
            at = bisect_left(starts, s[1])
            if (at == 0 or taken[at - 1][2] <= s[1]) and (at == len(taken) or taken[at][1] >= s[2]):
                starts.insert(at, s[1])
                taken.insert(at, s)
        return taken

    def _enough(self, which: int) -> float:
        return self.sizes[which] * (1.0 if self.sizes[which] <= NOTICE else COVER)

    def _chains(self, which: int, hits: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Best chains: hits in order in both text and template, at most GAP text tokens apart; overlaps count once."""
        best: list[tuple[int, int]] = []  # matched tokens, start
        near: list[int] = []
        for i, (x, y, n) in enumerate(hits):
            here = (n, x)
            near = [j for j in near if x - hits[j][0] - hits[j][2] <= GAP]
            for j in near:
                px, py, pn = hits[j]
                lap = max(0, px + pn - x, py + pn - y)
                if px < x and py < y and lap < n:
                    here = max(here, (best[j][0] + n - lap, best[j][1]), key=lambda c: (c[0], -c[1]))
            best.append(here)
            near.append(i)
        return [
            (self.names[which], start, x + n, got, round(min(1.0, got / self.sizes[which]), 6))
            for (x, _, n), (got, start) in zip(hits, best) if got >= self._enough(which)
        ]


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """Kept by a Python worker from task to task."""
    return Scanner(dict(templates))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Licence spans of every document; one narrow stage without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple((TEMPLATES if templates is None else templates).items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(shared.value)
        for pdf in batches:
            rows = [(d, *s) for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for s in scanner.scan(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "start_token", "end_token", "matched", "coverage"])
            yield out.astype({"doc_id": "Int64", "start_token": "int32", "end_token": "int32", "matched": "int32", "coverage": "float64"})

    return map_slices(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")), run, SCHEMA)
