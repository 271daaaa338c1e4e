from __future__ import annotations

import random

from groundcheck.llm import licenses as L


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        lists = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(rng.randrange(1, 4))]
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        runs = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        longest = [max((n for n in range(1, e + 1) if tuple(words[e - n : e]) in runs), default=0) for e in range(1, len(words) + 1)]
        want = [(e, n) for e, n in enumerate(longest, 1) if n >= 1 and (e == len(words) or longest[e] <= n)]
        a = L.Automaton(lists)
        got = a.runs(words, 1)
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            places = {(w, i + n) for w, x in enumerate(lists) for i in range(len(x) - n + 1) if x[i : i + n] == words[e - n : e]}
            assert a.ends[state] == places


def test_templates_are_found_in_noise():
    scanner = L.Scanner(L.TEMPLATES)
    rng = random.Random(1)
    for name, text in L.TEMPLATES.items():
        noise = " ".join(f"q{rng.randrange(99)}" for _ in range(50))
        got = scanner.scan(f"{noise}\n{text.upper().replace(' ', '*** ')}\n{noise}")
        assert [g[0] for g in got] == [name] and got[0][4] == 1.0 and (got[0][1], got[0][2]) == (50, 50 + len(L.tokens(text)))


def test_edited_template_and_partial_template():
    scanner = L.Scanner(L.TEMPLATES)
    words = L.TEMPLATES["MIT"].split()
    edited = " ".join("zzz" if i % 20 == 10 else w for i, w in enumerate(words))
    got = scanner.scan(edited)
    assert [g[0] for g in got] == ["MIT"] and 0.75 <= got[0][4] < 1
    assert scanner.scan(" ".join(words[: len(words) // 2])) == []
    assert scanner.scan("the rights to use the work as it is and the notice of the house") == []


def test_overlap_keeps_the_longer():
    text = L.TEMPLATES["Apache-2.0"]
    assert [s[0] for s in L.Scanner(L.TEMPLATES).scan(text)] == ["Apache-2.0"]
    twice = L.Scanner({"b": "one two three four", "a": "one two three four"}).scan("x one two three four")
    assert [(s[0], s[1], s[2]) for s in twice] == [("a", 1, 5)]
    assert L.Scanner({"s": "just this", "e": ""}).scan("well just this") == [("s", 1, 3, 2, 1.0)]


def test_table(spark, odd, none):
    assert L.scanned(odd).collect() == [] and L.scanned(none).collect() == []
    rows = [(1, "Released under the MIT License."), (None, "a\nReleased### under%%% the*** MIT&&& License.\nb"), (1, "Released under the MIT License."), (2, None), (3, "")]
    got = L.scanned(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")).collect()
    assert sorted((str(r["doc_id"]), r["license"], r["start_token"]) for r in got) == [("1", "MIT-notice", 0), ("1", "MIT-notice", 0), ("None", "MIT-notice", 1)]


def test_every_notice_of_the_table(spark, small):
    import re

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {r["doc_id"] for r in docs if re.search(r"licensed\W+under|under\W+the\W+mit\W+license", r["text"].lower())}
    got = {r["doc_id"] for r in L.scanned(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == want


def test_hits_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        lists = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(rng.randrange(1, 4))]
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        want = set()
        for w, x in enumerate(lists):
            for i in range(len(words)):
                for j in range(len(x)):
                    if words[i] == x[j] and not (i and j and words[i - 1] == x[j - 1]):
                        n = next((n for n in range(1, len(x)) if words[i + n : i + n + 1] != x[j + n : j + n + 1] or i + n == len(words)), len(x) - j)
                        want.add((w, i, j, n))
        for least in (1, 3):
            got = list(L.Automaton(lists).hits(words, least))
            assert len(got) == len(set(got)) and set(got) == {h for h in want if h[3] >= least}


def test_notice_followed_by_words_of_a_longer_template():
    scanner = L.Scanner(L.TEMPLATES)
    for more in ("The parser ...", '(the "License"). All rights reserved.', "you may not", "zzz"):
        got = scanner.scan(f"zzz Licensed under the Apache License, Version 2.0. {more}")
        assert [(s[0], s[1], s[2], s[4]) for s in got] == [("Apache-2.0-notice", 1, 9, 1.0)]


def test_close_relatives_are_reported_under_their_own_names():
    scanner = L.Scanner(L.TEMPLATES)
    header = (
        "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by "
        "the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU {1}General Public License for more details."
    )
    two = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    )
    want = {
        header.format("program", "", "3"): "GPL-3.0",
        header.format("program", "", "2"): "GPL-2.0",
        header.format("program", "", "2").replace("either version 2 of the License, or (at your option) any later version", "version 2 of the License"): "GPL-2.0",
        header.format("program", "Affero ", "3"): "AGPL-3.0",
        header.format("library", "Lesser ", "2.1"): "LGPL-2.1",
        header.format("library", "Lesser ", "3"): "LGPL-3.0",
        header.format("program", "Lesser ", "3"): "LGPL-3.0-program",
        two: "BSD-2-Clause",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": None,
        L.TEMPLATES["MPL-2.0"]: "MPL-2.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0-notice",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0-long-notice",
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1-notice",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-notice",
    }
    for text, name in want.items():
        assert [s[0] for s in scanner.scan(f"zzz {text} zzz")] == ([] if name is None else [name]), text


def test_full_texts_with_edits():
    scanner = L.Scanner(L.TEMPLATES)
    full = [n for n in L.TEMPLATES if n.endswith("-text")]
    want = {f"{n}-text" for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
    assert want <= set(full)
    for name in full:
        edited = " ".join("zzz" if i % 60 == 30 else w for i, w in enumerate(L.TEMPLATES[name].split()))
        assert [s[0] for s in scanner.scan(edited)] == [name]


def test_identifiers_and_short_notices():
    scanner = L.Scanner(L.TEMPLATES)
    for text, name in {
        "// SPDX-License-Identifier: MIT": "MIT-spdx", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later-spdx", "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-spdx",
        "SPDX-License-Identifier: GPL-2.7": None, "Released under an MIT License": "MIT-an1-notice", "released under the MIT license": "MIT-notice",
        "under the Mozilla Public License 2.0": "MPL-2.0-the1-notice", "Licensed under the Apache License, Version 7.0": None,
    }.items():
        assert [s[0] for s in scanner.scan(f"zzz\n{text}\nint zzz")] == ([] if name is None else [name]), text


def test_chains_against_all_chains(monkeypatch):
    monkeypatch.setattr(L, "MIN_RUN", 2)
    rng = random.Random(3)
    for _ in range(150):
        x = [rng.choice("abcd") for _ in range(rng.randrange(14, 18))]
        words = [w for i, w in enumerate(x) for w in ([w] if rng.random() > 0.12 else ["zz"] * rng.randrange(0, 3))]
        scanner = L.Scanner({"x": " ".join(x)})
        hits = sorted((s, t, n) for _, s, t, n in scanner.automaton.hits(words, 2))

        def chains(last, got, start):
            yield got, start, last
            for h in hits:
                lap = max(0, last[0] + last[2] - h[0], last[1] + last[2] - h[1])
                if last[0] < h[0] and last[1] < h[1] and lap < h[2] and h[0] - last[0] - last[2] <= L.GAP:
                    yield from chains(h, got + h[2] - lap, start)

        every = [c for h in hits for c in chains(h, h[2], h[0])]
        most = max((got for got, _, _ in every), default=0)
        spans = scanner._chains(0, hits)
        assert bool(spans) == (most >= L.COVER * len(x))
        if spans:
            assert max(s[3] for s in spans) == most


def test_overlaps_against_comparing_all():
    rng = random.Random(5)
    scanner = L.Scanner({"a": "one two three four", "b": "three four five six seven", "c": "seven one two three"})
    for _ in range(100):
        words = [rng.choice("one two three four five six seven".split()) for _ in range(60)]
        for _ in range(4):
            at = rng.randrange(60)
            words[at:at] = rng.choice(["one two three four five six seven", "three four five six seven one two three"]).split()
        got = scanner.scan(" ".join(words))
        spans = [(name, i, i + n, n, 1.0) for name, n in (("a", 4), ("b", 5), ("c", 4)) for i in range(len(words)) if words[i : i + n] == {"a": "one two three four", "b": "three four five six seven", "c": "seven one two three"}[name].split()]
        taken = []
        for s in sorted(spans, key=lambda s: (-s[3], -s[4], s[1], s[0])):
            if all(s[2] <= t[1] or s[1] >= t[2] for t in taken):
                taken.append(s)
        assert got == sorted(taken, key=lambda s: s[1])


def test_many_notices_take_time_in_proportion():
    import time

    scanner = L.Scanner(L.TEMPLATES)
    seconds = []
    for n in (4000, 32_000):
        began = time.process_time()
        assert len(scanner.scan("Released under the MIT License. well " * n)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 14 * seconds[0] + 0.3
