"""License scan (operator 11) by matching statistics on a generalised suffix automaton.

Method. The words of all license templates, and of the base phrases, make one
suffix automaton. Each text is streamed through it: at every word the
automaton knows the longest run of words that ends there and stands in some
template. A run that the next word does not lengthen is a match; matches of at
least ``MIN_MATCH`` words are chained, per template, where both the text and
the template move on by at most ``GAP`` words. A chain that covers ``COVER``
of its template is a span, and the spans of a text are the disjoint ones that
cover most. Base phrases end where the automaton's state, or one on its chain
of suffix links, is that of a phrase.

Scale. One pass over the texts without a shuffle; a text is cut into words a
piece at a time, and what is held of it are the matches still within reach.
The automaton has at most two states a template word and is built in each
task; templates of more than ``MOST_WORDS`` words in all are refused.

Defined results: a null or empty text has no words, no labels and score 0.
Repeated rows each get a row; an empty table gives none. Texts are searched
whole, whatever their length. Columns to keep that are named like a result are
replaced by it. A template of fewer words than ``MIN_MATCH`` never matches.
The score is the largest share of a template that one chain covers, and 1
where a base phrase stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .decontaminate import _WORD_BYTES, words

MIN_MATCH = 4
GAP = 12
COVER = 0.7
MOST_WORDS = 50_000
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "score")
_NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} General Public License for more details."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: (label, text) of well-known licenses, notices and one-line statements.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
            "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
            "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
               "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", " ".join(_GNU.format("", "").split())),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", _GNU.format("Lesser", "Lesser")),
    ("agpl", _GNU.format("Affero", "Affero")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
                  "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", _CC.format("Attribution")),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", _CC.format("Attribution-ShareAlike")),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", _CC.format("Attribution-NonCommercial")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", _CC.format("Attribution-NoDerivatives")),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
]


class SuffixAutomaton:
    """Of several strings of numbers; each state knows where its strings end in them."""

    def __init__(self, strings: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.whole = []
        for s, string in enumerate(strings):
            at = 0
            for k, x in enumerate(string):
                at = self._extend(at, x)
                self.ends[at].append((s, k))
            self.whole.append(at)
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] += self.ends[v]
        self.ends[0] = []

    def _state(self, length: int, like: int = -1) -> int:
        self.next.append(dict(self.next[like]) if like >= 0 else {})
        self.link.append(self.link[like] if like >= 0 else -1)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """The state of p's longest string with x after it, cut out of q if that has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, like=q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x], p = clone, self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, self.next[last][x], x)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x], p = new, self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][x], x)
        return new


class Chains:
    """Chains of matches with one template; those within reach of the text's place are held, and those that cover enough."""

    def __init__(self, least: float, gap: int) -> None:
        self.least, self.gap, self.most = least, gap, 0
        self.open: list[tuple[int, int, int, int, int, int]] = []  # start, end, start and end in the template, covered, start of the chain
        self.found: list[tuple[int, int, int]] = []  # start, end, covered

    def add(self, start: int, end: int, first: int, last: int) -> None:
        gap = self.gap
        self.open = [c for c in self.open if c[1] >= start - gap]
        covered, begin = end - start, start
        for s, e, f, t, c, b in self.open:
            if s < start and e < end and f < first and t < last and first - t <= gap:
                more = c + min(end - start, end - e, last - t)
                if (more, -b) > (covered, -begin):
                    covered, begin = more, b
        self.open.append((start, end, first, last, covered, begin))
        self.most = max(self.most, covered)
        if covered >= self.least:
            self.found.append((begin, end, covered))


def disjoint(spans: list[tuple]) -> list[tuple]:
    """Of ``(start, end, covered, ...)`` the disjoint ones that cover most; of equal choices the one with the earliest ends."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[3:]))
    ends = [s[1] for s in spans]
    best, take = [0], []
    for s in spans:
        k = bisect_left(ends, s[0] + 1)  # spans that end by the start of this one
        take.append((best[k] + s[2] > best[-1], k))
        best.append(max(best[-1], best[k] + s[2]))
    out, k = [], len(spans)
    while k:
        use, before = take[k - 1]
        if use:
            out.append(spans[k - 1])
        k = before if use else k - 1
    return out[::-1]


class Scanner:
    """The automaton of templates and phrases, and what it finds in a text."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int, gap: int, cover: float) -> None:
        self.templates, self.min_match, self.gap, self.cover = templates, min_match, gap, cover
        vocab: dict[bytes, int] = {}
        strings = [[vocab.setdefault(w, len(vocab) + 1) for w in words(t)] for t in [*phrases, *(t for _, t in templates)]]
        if sum(map(len, strings)) > MOST_WORDS:
            raise ValueError(f"the templates have more than {MOST_WORDS} words")
        self.vocab, self.sizes, self.n_phrases = vocab, [len(s) for s in strings], len(phrases)
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.shortest = min([min_match, *self.sizes[: len(phrases)]])
        self.automaton = a = SuffixAutomaton(strings)
        own: dict[int, list[int]] = {}
        for p in range(self.n_phrases):
            own.setdefault(a.whole[p], []).append(p)
        self.phrases: list[list[int]] = [[] for _ in a.link]
        for v in sorted(range(1, len(a.link)), key=lambda v: a.length[v]):
            self.phrases[v] = self.phrases[a.link[v]] + own.get(v, [])

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[tuple], float]:
        """Words, (phrase, start) places, spans ``(start, end, covered, share, label)``, score."""
        places: list[tuple[int, int]] = []
        chains: dict[int, Chains] = {}
        n = at = length = lo = 0
        while lo < len(data):
            cut = _NO_WORD.search(data, lo + PIECE)
            hi = cut.start() if cut else len(data)
            found = data[lo:hi].translate(_WORD_BYTES).split()
            ids = np.fromiter(map(self.vocab.get, found, repeat(0)), np.int32, len(found))
            known = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False])).astype(np.int8)))
            if length and len(ids) and not ids[0]:
                at, length = self._stop(n, at, length, chains)
            for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
                if stop - start + length >= self.shortest or stop == len(ids):
                    at, length = self._run(ids[start:stop].tolist(), n + start, at, length, places, chains)
                if stop < len(ids):
                    at, length = self._stop(n + stop, at, length, chains)
            n, lo = n + len(found), hi
        self._stop(n, at, length, chains)
        spans, score = [], float(bool(places))
        for s, c in chains.items():
            score = max(score, min(1.0, c.most / self.sizes[s]))
            spans += [(start, end, covered, min(1.0, covered / self.sizes[s]), self.labels[s]) for start, end, covered in c.found]
        return n, places, disjoint(spans), score

    def _run(self, ids: list[int], begin: int, at: int, length: int, places: list, chains: dict[int, Chains]) -> tuple[int, int]:
        """Words of the templates in a row, from place ``begin`` on."""
        a, least = self.automaton, self.min_match
        step, link, size = a.next, a.link, a.length
        for k, x in enumerate(ids, begin):
            if x not in step[at]:
                if length >= least:
                    self._match(k, at, length, chains)
                while at and x not in step[at]:
                    at = link[at]
                length = size[at]
            at = step[at][x]
            length += 1
            if self.phrases[at]:
                for p in self.phrases[at]:
                    if length >= self.sizes[p]:
                        places.append((p, k + 1 - self.sizes[p]))
        return at, length

    def _stop(self, end: int, at: int, length: int, chains: dict[int, Chains]) -> tuple[int, int]:
        if length >= self.min_match:
            self._match(end, at, length, chains)
        return 0, 0

    def _match(self, end: int, state: int, length: int, chains: dict[int, Chains]) -> None:
        for s, last in sorted(self.automaton.ends[state]):
            if s >= self.n_phrases:
                if s not in chains:
                    chains[s] = Chains(self.cover * self.sizes[s], self.gap)
                chains[s].add(end - length, end, last + 1 - length, last + 1)


SPANS = "array<struct<label:string,start:long,end:long,covered:long,share:double>>"


def scan_licenses(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
    min_match: int = MIN_MATCH, gap: int = GAP, cover: float = COVER,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with words, base places, spans and score; places are word numbers, ends exclusive."""
    bounded_batches(docs.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    kinds = dict(n_words="long", n_base="long", first_word="long", last_word="long", base_labels="array<string>", spans=SPANS, score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_match, gap, cover)
        for b in batches:
            out: dict[str, list] = {c: [] for c in RESULTS}
            for text in b.column("_text"):
                data = text.as_buffer()
                n, places, spans, score = scanner.scan(data.to_pybytes() if data is not None else b"")
                starts = [s for _, s in places]
                row = (n, len(places), min(starts, default=None), max(starts, default=None), sorted({scanner.labels[p] for p, _ in places}))
                found = [dict(label=x[4], start=x[0], end=x[1], covered=x[2], share=x[3]) for x in spans]
                for c, v in zip(RESULTS, (*row, found, score)):
                    out[c].append(v)
            span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
            types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(span), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *[pa.array(out[c], t) for c, t in zip(RESULTS, types)]], names=["_row", *RESULTS])

    row = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    nested = docs.select(row.alias("_row"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    found = nested.mapInArrow(run, f"_row {nested.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return found.select(*[F.col("_row")[c].alias(c) for c in kept], *RESULTS)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, labels and scores of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    labels = F.concat("base_labels", F.transform("spans", lambda s: s["label"]))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(labels).alias("labels"), "score")


def plain_licenses(text: str | None, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = MIN_MATCH, gap: int = GAP, cover: float = COVER) -> tuple:
    """Brute force for tests: every run of words compared with every place of every template, every chain and every set of spans."""
    w, n = words(text), len(words(text))
    places = [(label, k) for p, label in phrases.items() for k in range(n) if w[k : k + len(words(p))] == words(p)]
    strings = [words(t) for t in [*phrases, *(t for _, t in templates)]]
    stands = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    longest = [next((k for k in range(min(e, max(map(len, strings), default=0)), 0, -1) if tuple(w[e - k : e]) in stands), 0) for e in range(1, n + 1)]
    ends = [(k + 1, m) for k, m in enumerate(longest) if m >= min_match and (k + 1 == n or longest[k + 1] != m + 1)]
    spans, score = [], float(bool(places))
    for (label, _), s in zip(templates, strings[len(phrases) :]):
        found = [(e - m, e, f, f + m) for e, m in ends for f in range(len(s)) if s[f : f + m] == w[e - m : e]]
        best: list[tuple[int, int]] = []
        for j, (a, b, f, t) in enumerate(found):
            options = [(b - a, -a)]
            for i, (a2, b2, f2, t2) in enumerate(found[:j]):
                if a2 < a and b2 < b and f2 < f and t2 < t and a - b2 <= gap and f - t2 <= gap:
                    options.append((best[i][0] + min(b - a, b - b2, t - t2), best[i][1]))
            best.append(max(options))
            covered, begin = best[-1]
            score = max(score, min(1.0, covered / len(s)))
            if covered >= cover * len(s):
                spans.append((-begin, b, covered, min(1.0, covered / len(s)), label))
    starts = [k for _, k in places]
    return n, len(places), min(starts, default=None), max(starts, default=None), sorted({x for x, _ in places}), sorted(set(spans)), score
