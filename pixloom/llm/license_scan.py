"""License scan: matching statistics against a generalised suffix automaton of licence tokens.

All templates and base phrases go into one suffix automaton over token ids.  A
text streams through it once; at every word the automaton holds the longest
template substring that ends there.  Maximal matches are chained per template
(forward in text and template, small gaps), and the chain's covered tokens give
the template's coverage and its span in the text.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: bytes.translate table: A-Z become a-z; all ASCII but letters and digits becomes a space.
WORD_BYTES = bytes(i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Wording of public licences and notices, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mit", "Released under the MIT License"),
    ("all-rights-reserved", "All rights reserved"),
)
#: Least tokens of a match that may join a chain (shorter templates: all their tokens), most tokens of a gap, least coverage of a label.
LEAST, GAP, COVERAGE = 5, 20, 0.7


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.len = [{}], [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of which the state's strings are suffixes
        places = []
        for k, seq in enumerate(sequences):
            last = 0
            for at, t in enumerate(seq):
                last = self._extend(last, t)
                places.append((last, k, at + 1))
        for state, k, at in places:
            while state > 0:
                self.ends[state].append((k, at))
                state = self.link[state]

    def _add(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.len.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, t: int) -> int:
        """A copy of q for the strings that p's longest string and t make."""
        clone = self._add(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, t)
        new, p = self._add(self.len[last] + 1, 0, {}), last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, t)
        return new


class Scanner:
    def __init__(self, base, templates):
        names = [(label, tokens(text.encode())) for text, label in base] + [(label, tokens(text.encode())) for label, text in templates]
        self.n_base, self.labels, self.size = len(base), [n for n, _ in names], [len(t) for _, t in names]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, t in names for w in t))}
        self.auto = Automaton([[self.ids[w] for w in t] for _, t in names])
        self.least = [min(LEAST, n) for n in self.size]
        shortest = min(self.size)
        # base phrases that are suffixes of a state's strings: its own, if the match is as long, and those up its links
        self.phrases: list[list[int]] = [[] for _ in self.auto.len]
        for state in sorted(range(1, len(self.auto.len)), key=self.auto.len.__getitem__):
            own = [k for k, at in self.auto.ends[state] if k < self.n_base and at == self.size[k] and self.auto.len[self.auto.link[state]] < at <= self.auto.len[state]]
            self.phrases[state] = own + self.phrases[self.auto.link[state]]
        self.shortest = shortest

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """((start, phrase) of base places, (start, length, state) of maximal matches)."""
        step, link, size, phrases, shortest = self.auto.next, self.auto.link, self.auto.len, self.phrases, self.shortest
        base, found, state, length = [], [], 0, 0
        for i, t in enumerate(map(self.ids.get, words)):
            if t is None:
                if length >= shortest:
                    found.append((i - length, length, state))
                state = length = 0
                continue
            after = step[state].get(t)
            if after is None:
                if length >= shortest:
                    found.append((i - length, length, state))
                while after is None and state:
                    state = link[state]
                    length = size[state]
                    after = step[state].get(t)
            if after is None:
                state = length = 0
                continue
            state, length = after, length + 1
            if phrases[state]:
                base += [(i + 1 - self.size[k], k) for k in phrases[state] if self.size[k] <= length]
        if length >= shortest:
            found.append((len(words) - length, length, state))
        return base, found

    def chains(self, places: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(words matched, first word, word after the last, template position after it) of the best chain that ends with each match, matches sorted."""
        out, live = [], []
        for s, t, n in places:
            grown = (n, s, s + n, t + n)
            live = [c for c in live if s - c[2] <= GAP]  # none of the others can grow any more
            for matched, first, last, at in live:
                over = max(0, last - s, at - t)  # a match may start inside the one before
                if over < n and s + over - last <= GAP and t + over - at <= GAP and (matched + n - over, first) > grown[:2]:
                    grown = (matched + n - over, first, s + n, t + n)
            live.append(grown)
            out.append(grown)
        return out

    def spans(self, found: list[tuple[int, int, int]]) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first word, word after the last) of the chains of every template with matches.

        These are all chains that reach COVERAGE and don't overlap, the fullest
        first; where a template has none, its best chain.
        """
        by: dict[int, set[tuple[int, int, int]]] = {}
        for start, length, state in found:
            for k, end in self.auto.ends[state]:
                if k >= self.n_base and length >= self.least[k]:
                    by.setdefault(k, set()).add((start, end - length, length))
        out = []
        for k, places in by.items():
            taken: list[tuple[int, int]] = []  # first words and words after the last, sorted
            share = lambda c: min(1.0, c[0] / self.size[k])  # noqa: B023, E731
            while places:
                free: dict[int, list] = {}  # matches by the gap between chains that holds them: no chain reaches over another
                for p in sorted(places):
                    free.setdefault(bisect_left(taken, (p[0] + 1, 0)), []).append(p)
                ordered = sorted((c for ps in free.values() for c in self.chains(ps)), key=lambda c: (-c[0], c[2] - c[1], c[1]))
                more = [c for c in ordered if share(c) >= COVERAGE]
                if not more:
                    if not taken:
                        out.append((k, share(ordered[0]), ordered[0][1], ordered[0][2]))
                    break
                for c in more:
                    at = bisect_left(taken, (c[1], c[2]))
                    if (at == 0 or taken[at - 1][1] <= c[1]) and (at == len(taken) or c[2] <= taken[at][0]):
                        taken.insert(at, (c[1], c[2]))
                        out.append((k, share(c), c[1], c[2]))
                # what is left of the matches between the chains may chain anew
                places = {p for m in places for p in outside(m, taken) if p[2] >= self.least[k]}
        return sorted(out, key=lambda x: (x[0], x[2]))


def outside(match: tuple[int, int, int], taken: list[tuple[int, int]]):
    """The parts of a match (word, template position, words) outside of sorted intervals of words."""
    s, t, n = match
    at = max(0, bisect_left(taken, (s, 0)) - 1)
    while at < len(taken) and taken[at][0] < s + n:
        first, last = taken[at]
        if first > s:
            yield s, t, first - s
        if last > s:
            s, t, n = last, t + last - s, n - (last - s)
            if n <= 0:
                return
        at += 1
    yield s, t, n


@lru_cache(2)
def scanner(base=BASE, templates=TEMPLATES) -> Scanner:
    return Scanner(base, templates)


SPANS = "array<struct<label:string,coverage:double,first_word:long,end_word:long>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of docs.

    labels holds base_labels and the labels of templates covered to COVERAGE or
    more; score is the best template's coverage, 0.5 at least beside a base
    phrase.  Null and empty texts have no words, labels or spans and score 0.
    Repeated rows and rows without an id are kept; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def one(text):
        sc, words = scanner(base, templates), tokens(text)
        places, found = sc.scan(words)
        spans = sc.spans(found) if found else []
        named = {sc.labels[k] for _, k in places}
        more = {sc.labels[k] for k, share, _, _ in spans if share >= COVERAGE}
        starts = [s for s, _ in places]
        score = max([0.5 * bool(places), *(share for _, share, _, _ in spans)])
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | more)), score, [{"label": sc.labels[k], "coverage": c, "first_word": a, "end_word": z} for k, c, a, z in spans]

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches):
        for b in batches:
            rows = [one(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")


def op9_license(spark, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every document; odd rows as in `scanned`."""
    return scanned(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))
