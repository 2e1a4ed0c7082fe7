"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template, so one pass over a text's words gives the matching
statistics: at each word, how long a run ending there stands in some template, and, by the suffix links, in each
template. Each template's runs that cannot be extended and have ``MIN_MATCH`` words or more (or are a whole template)
are chained, in the order of text and template, into covered template spans; a span's coverage is the share of its
template's words. Of spans that lie by half or more in a better covered one (the longer one, then the label first in
the alphabet, on a tie) only that one stays.

The templates are a fixed short list of whole short licences, headers and notices, so the automaton is small; each
worker builds it once. No row is shuffled.

Words are runs of digits, lower-cased ASCII letters and characters beyond ASCII. Null and empty texts have no words,
no spans and score 0. Repeated rows are each scanned. Columns named like the results are replaced, others stay,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import others, quoted
from tessera.shipping import map_in_arrow

#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, headers and whole short licences, with their labels: published texts.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
     the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
     or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
     CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
     limitations under the License."""),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
     (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
     publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
     subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
     substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
     BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
     AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
     ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    *((f"gpl-{n}.0", f"licensed under the gnu general public license version {n}") for n in (2, 3)),
    *((f"gpl-{n}.0", f"released under the gnu general public license version {n}") for n in (2, 3)),
    *((f"gpl-{n}.0", f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
     This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""") for n in (2, 3)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
     following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
     following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
     COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
     OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
     the above copyright notice and this permission notice appear in all copies."""),
    *((f"cc-{a.replace(' ', '-')}-{v}", f"licensed under cc {a} {v}") for a in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("3.0", "4.0")),
    *((f"cc-{a}-4.0", f"creative commons {name} 4.0 international license") for a, name in (
        ("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"),
        ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"),
    )),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1.0"),
    ("cc0-1.0", "creative commons cc0 1.0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
MIN_MATCH = 3
MIN_COVERAGE = 0.8
MAX_GAP = 12
#: Words in a stretch of the index of kept spans.
STRETCH = 32

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """The generalised suffix automaton of word sequences, with the places of each state's runs."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.sequences = sequences
        for seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (length, sequence) of whole sequences that end a state's runs
        for k, seq in enumerate(sequences):
            state = 0
            for at, word in enumerate(seq):
                state = self.next[state][word]
                s = state
                while s > 0:
                    self.ends[s].append((k, at + 1))
                    s = self.link[s]
        for k, seq in enumerate(sequences):
            state = 0
            for word in seq:
                state = self.next[state][word]
            self.whole[state].append((len(seq), k))
        # what shorter suffixes of a state's runs add: template, length, its places; for templates that lack the longer run
        self.own = [{k: tuple(sorted(e for t, e in ends if t == k)) for k in {t for t, _ in ends}} for ends in self.ends]
        self.shorter: list[dict[int, tuple[int, tuple[int, ...]]]] = [{} for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.whole[s] = self.whole[s] + self.whole[up]
            if up:
                near = self.shorter[up] | {k: (self.length[up], ends) for k, ends in self.own[up].items() if self.counts(k, self.length[up])}
                self.shorter[s] = {k: v for k, v in near.items() if k not in self.own[s]}

    def counts(self, k: int, n: int) -> bool:
        """Whether a run of n words of sequence k is long enough to count."""
        return n >= MIN_MATCH or n == len(self.sequences[k])

    def runs(self, statistics: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        """(sequence, position, length, ends in the sequence): each sequence's runs that end there and go no further."""
        before: dict[int, tuple[int, tuple[int, ...]]] = {}
        last = -1
        for i, state, matched in statistics:
            now = {k: (matched, ends) for k, ends in self.own[state].items() if self.counts(k, matched)}
            now.update(self.shorter[state])
            for k, (n, ends) in before.items():
                if i != last + 1 or k not in now or now[k][0] != n + 1:
                    yield k, last, n, ends
            before, last = now, i
        for k, (n, ends) in before.items():
            yield k, last, n, ends

    def _new(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the runs that lead from p by word, apart from the longer ones of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][word], word)
        return state

    def statistics(self, text: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) wherever a run of one word or more ends; positions count from 0."""
        nxt, link, length = self.next, self.link, self.length
        root = nxt[0]
        state = matched = 0
        for i, word in enumerate(text):
            if not state:
                state = root.get(word, 0)
                if not state:
                    continue
                matched = 1
            else:
                while state and word not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                state = nxt[state].get(word, 0)
                if not state:
                    matched = 0
                    continue
                matched += 1
            yield i, state, matched


class LicenseScanner:
    """The scanner of one worker."""

    _own: dict = {}

    def __init__(self, base: dict[str, str], notices: list[tuple[str, str]]):
        self.templates = [(label, words(phrase)) for phrase, label in base.items()] + [(label, words(text)) for label, text in notices]
        self.n_base = len(base)
        self.automaton = SuffixAutomaton([seq for _, seq in self.templates])

    @classmethod
    def of_worker(cls) -> LicenseScanner:
        if "scanner" not in cls._own:
            cls._own["scanner"] = cls(BASE, NOTICES)
        return cls._own["scanner"]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Words in the text, (label, first word) of the base phrases' places, and (label, first, end, coverage)."""
        seq = words(text)
        places: list[tuple[str, int]] = []

        def noting() -> Iterator[tuple[int, int, int]]:
            """The text's matching statistics; base phrases that end on the way are noted."""
            for i, state, matched in self.automaton.statistics(seq):
                places.extend((self.templates[k][0], i - n + 1) for n, k in self.automaton.whole[state] if n <= matched and k < self.n_base)
                yield i, state, matched

        spans = self._best(self._chain(self.automaton.runs(noting())))
        return len(seq), places, spans

    def _chain(self, runs: Iterator[tuple[int, int, int, tuple[int, ...]]]) -> list[tuple[str, int, int, float]]:
        """Spans: runs that follow each other in the text and in one template."""
        open_: dict[int, list[int]] = {}  # template: first word, end word, end in template, words covered
        spans = []

        def close(k: int) -> None:
            first, end, _, covered = open_.pop(k)
            spans.append((self.templates[k][0], first, end, covered / len(self.templates[k][1])))

        for k, i, n, ends in runs:
            first = i - n + 1
            if k in open_:
                chain = open_[k]
                for end in ends:
                    overlap = max(0, chain[1] - first, chain[2] - (end - n))
                    if overlap < n and first - chain[1] <= MAX_GAP and end - n + overlap >= chain[2]:
                        chain[1:] = [i + 1, end, chain[3] + n - overlap]
                        break
                else:
                    close(k)
            if k not in open_:
                open_[k] = [first, i + 1, ends[0], n]
        for k in list(open_):
            close(k)
        return spans

    def _best(self, spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """The spans that do not lie by half or more in a better one."""
        kept: list[tuple[str, int, int, float]] = []
        near: dict[int, list[tuple[str, int, int, float]]] = {}  # kept spans by the stretches of words that they touch
        for span in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[0], s[1])):
            _, first, end, _ = span
            # whatever covers half of a span covers one of its middle words
            middle = {(first + end - 1) // 2 // STRETCH, (first + end) // 2 // STRETCH}
            if not any(2 * (min(end, k[2]) - max(first, k[1])) >= end - first for m in middle for k in near.get(m, ())):
                kept.append(span)
                for m in range(first // STRETCH, (end - 1) // STRETCH + 1):
                    near.setdefault(m, []).append(span)
        return sorted(kept, key=lambda s: (s[1], s[0]))


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())])
PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType())])


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, base_places (label, first) and license_spans (label, first, end, coverage).

    Positions are word numbers from 0. Columns of those names, in any case, are replaced.
    """
    added = ["n_words", "base_places", "license_spans"]
    keep = others(df.columns, text, *added)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("base_places", T.ArrayType(PLACE)), T.StructField("license_spans", T.ArrayType(SPAN))])
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner.of_worker()
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(0)]
            columns = [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([[{"label": a, "first": b} for a, b in f[1]] for f in found], place),
                pa.array([[{"label": a, "first": b, "end": c, "coverage": d} for a, b, c, d in f[2]] for f in found], span),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*keep, *added])

    return map_in_arrow(df.select(text, *quoted(keep)), scan, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """n_base, first_word, last_word, base_labels, labels and score of each scanned row."""
    base = F.transform("base_places", lambda p: p["label"])
    found = F.transform(F.filter("license_spans", lambda s: s["coverage"] >= MIN_COVERAGE), lambda s: s["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        *quoted(others(scanned.columns, "base_places", "license_spans", "n_base", "first_word", "last_word", "base_labels", "labels", "score")),
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(F.transform("base_places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("base_places", lambda p: p["first"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        F.coalesce(F.array_max(F.transform("license_spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
