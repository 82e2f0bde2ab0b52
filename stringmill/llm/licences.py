"""Licence scans: matching statistics from a generalised suffix automaton, chained into template spans.

The automaton holds every run of words of all licence templates and is small: two states for each
template word at most. A text is streamed through it: after each word the state and a length say how
long a run ending here stands somewhere in a template. Runs that cannot grow further and have at
least MIN_MATCH words are anchors; anchors of one template that follow each other in text and
template, with small gaps, are chained, and a chain that covers enough of its template is a span. The
base phrases are sequences of the same automaton: a phrase ends wherever its state is a suffix of the
current one.

Words are looked up all at once, and only stretches in which each word may follow the one before (in
some template) are streamed: no match crosses their edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text
from .words import Words, same_words, slices, words_of

MIN_MATCH = 5
MAX_GAP = 12
MIN_COVER = 0.6
# The words that name a licence, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public licence texts and notices, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Distributed under the terms of the MIT License",
    ],
    "no-warranty": [
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for "
        "any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with "
        "the software or the use or other dealings in the software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ],
    "cc-by-4.0": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-sa-4.0": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ],
    "cc-by-nc-4.0": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
}

SPAN = "struct<label string, template int, first_word long, last_word long, covered int, length int>"
SCHEMA = f"doc_id long, n_words long, places array<struct<label string, first_word long>>, spans array<{SPAN}>"
_BREAKS = np.zeros(256, bool)  # bytes between words, after A-Z became a-z
_BREAKS[:0x30] = _BREAKS[0x3A:0x61] = _BREAKS[0x7B:0x80] = True


class Automaton:
    """Generalised suffix automaton of some sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for number, sequence in enumerate(sequences):
            state = 0
            for place, token in enumerate(sequence):
                state = self._extended(state, token)
                ends.setdefault(state, []).append((number, place + 1))
        self._ends = ends
        self._below: dict[int, list[int]] = {}
        for state, up in enumerate(self.link):
            self._below.setdefault(up, []).append(state)
        self._found: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, state: int, token: int, target: int) -> int:
        """A state of its own for the strings that end the state's longest one followed by the token."""
        own = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = own
        while state != -1 and self.next[state].get(token) == target:
            self.next[state][token] = own
            state = self.link[state]
        return own

    def _extended(self, state: int, token: int) -> int:
        def proper(at: int) -> int:
            target = self.next[at][token]
            return target if self.length[target] == self.length[at] + 1 else self._split(at, token, target)

        if token in self.next[state]:
            return proper(state)
        own = self._state(self.length[state] + 1, 0, {})
        while state != -1 and token not in self.next[state]:
            self.next[state][token] = own
            state = self.link[state]
        if state != -1:
            self.link[own] = proper(state)
        return own

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """After each token: the state, and the length of the longest run that ends here and stands in a sequence."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length

    def places(self, state: int) -> list[tuple[int, int]]:
        """Sequence and end of every place where the strings of a state stand."""
        if state not in self._found:
            out, todo = [], [state]
            while todo:
                at = todo.pop()
                out += self._ends.get(at, [])
                todo += self._below.get(at, [])
            self._found[state] = sorted(out)
        return self._found[state]


@dataclass
class Chain:
    """Anchors of a template that follow each other in a text: words covered, text span, ends of the last anchor."""

    covered: int
    first: int
    end: int
    template_end: int


def chained(anchors: list[tuple[int, int, int]], gap: int = MAX_GAP) -> list[Chain]:
    """Chains of one template over its anchors (text end, template end, length), each ending at another anchor.

    An anchor follows another when it ends later in both, and at most gap words lie between them in
    the text; words that both cover count once. The best chain to each anchor is kept.
    """
    anchors = sorted(anchors)
    longest = max((n for _, _, n in anchors), default=0)
    out: list[Chain] = []
    low = 0
    for end, template_end, n in anchors:
        best = Chain(n, end - n, end, template_end)
        while low < len(out) and out[low].end < end - longest - gap:
            low += 1
        for other in out[low:]:
            if other.end < end and other.template_end < template_end and end - n - other.end <= gap:
                covered = other.covered + min(n, end - other.end, template_end - other.template_end)
                if covered > best.covered:
                    best = Chain(covered, other.first, end, template_end)
        out.append(best)
    return out


@dataclass
class Scanner:
    """Templates and phrases, split into words and held in one automaton."""

    templates: dict[str, list[str]]
    phrases: dict[str, str]
    min_match: int = MIN_MATCH
    min_cover: float = MIN_COVER
    gap: int = MAX_GAP
    _ready: bool = field(default=False, repr=False)

    def __getstate__(self) -> dict:
        """Tasks get the texts and build their own automaton, which is smaller to send."""
        own = ("templates", "phrases", "min_match", "min_cover", "gap")
        return {k: v for k, v in self.__dict__.items() if k in own} | {"_ready": False}

    def _build(self) -> None:
        named = [(label, text) for label, texts in self.templates.items() for text in texts]
        words = words_of(pa.array([t for _, t in named] + list(self.phrases), pa.string()), lower=True, space=_BREAKS)
        raw = words.data.tobytes()
        whole = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
        kinds = {w: i for i, w in enumerate(dict.fromkeys(whole))}
        ids = [kinds[w] for w in whole]
        sequences = [ids[a:b] for a, b in zip(words.first, words.first[1:])]
        self.labels, self.lengths = [label for label, _ in named], [len(s) for s in sequences[: len(named)]]
        self.automaton = Automaton(sequences)
        self.vocabulary = words_of(pa.array([w.decode() for w in kinds], pa.string()), space=_BREAKS)
        hashes = self.vocabulary.hashes(61)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # 1: the second word follows the first somewhere; 2: and both begin a phrase
        self.follows = np.zeros((len(kinds), len(kinds)), np.int8)
        for s in sequences:
            self.follows[s[:-1], s[1:]] = 1
        self.single, ends = set(), {}
        for label, s in zip(self.phrases.values(), sequences[len(named) :]):
            if not s:
                continue
            if len(s) > 1:
                self.follows[s[0], s[1]] = 2
            else:
                self.single.add(s[0])
            for state, _ in self.automaton.stream(s):
                pass
            ends.setdefault(state, []).append((label, len(s)))
        # all phrases that end where a state's strings end
        self.ending: list[tuple] = [()] * len(self.automaton.length)
        for state in sorted(range(len(self.ending)), key=self.automaton.length.__getitem__):
            up = self.automaton.link[state]
            self.ending[state] = (*ends.get(state, ()), *(self.ending[up] if up >= 0 else ()))
        self._ready = True

    def known(self, words: Words) -> np.ndarray:
        """Number of each word in the vocabulary, -1 where absent; bytes are compared."""
        out = np.full(len(words.starts), -1, np.int64)
        if not len(self.hashes) or not len(out):
            return out
        hashes = words.hashes(61)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        kind = self.order[at[hit]]
        good = same_words(words, hit, self.vocabulary, kind)
        out[hit[good]] = kind[good]
        return out

    def stretches(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words in which every pair follows in a template, if long enough for a match or with a phrase."""
        if not len(ids):
            return []
        pair = np.zeros(len(ids), np.int8)  # of each word with the one before
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        pair[both] = self.follows[ids[both - 1], ids[both]]
        pair[first[:-1][first[:-1] < len(ids)]] = 0  # a text begins
        starts = np.flatnonzero(pair == 0)
        sizes = np.diff(np.append(starts, len(ids)))
        wanted = sizes >= self.min_match
        wanted |= np.maximum.reduceat(pair, starts) == 2
        if self.single:
            wanted |= np.logical_or.reduceat(np.isin(ids, list(self.single)), starts)
        wanted &= ids[starts] >= 0
        return list(zip(starts[wanted].tolist(), (starts + sizes)[wanted].tolist()))

    def scan(self, words: Words) -> dict[int, tuple[list, list]]:
        """Places (label, first word) and spans of each text that has any, by its index."""
        if not self._ready:
            self._build()
        ids = self.known(words)
        anchors: dict[int, dict[int, list]] = {}
        out: dict[int, tuple[list, list]] = {}
        stretches = self.stretches(ids, words.first)
        texts = np.searchsorted(words.first, [a for a, _ in stretches], "right") - 1
        for text, (a, b) in zip(texts.tolist(), stretches):
            start = a - int(words.first[text])
            track = list(self.automaton.stream(ids[a:b].tolist()))
            for i, (state, n) in enumerate(track):
                for label, size in self.ending[state]:
                    if size <= n:
                        out.setdefault(text, ([], []))[0].append((label, start + i + 1 - size))
                if n >= self.min_match and (i + 1 == len(track) or track[i + 1][1] <= n):
                    for template, end in self.automaton.places(state):
                        if template < len(self.labels):
                            anchors.setdefault(text, {}).setdefault(template, []).append((start + i + 1, end, n))
        for text, found in anchors.items():
            for template, own in sorted(found.items()):
                taken: list[Chain] = []
                for chain in sorted(chained(own, self.gap), key=lambda c: (-c.covered, c.first, c.end)):
                    if chain.covered < self.min_cover * self.lengths[template]:
                        break
                    if all(chain.end <= c.first or chain.first >= c.end for c in taken):
                        taken.append(chain)
                for c in sorted(taken, key=lambda c: c.first):
                    spans = out.setdefault(text, ([], []))[1]
                    spans.append((self.labels[template], template, c.first, c.end - 1, min(c.covered, self.lengths[template]), self.lengths[template]))
        return out


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, places, spans.

    places holds every place of a base phrase (label, first word), spans every covered template:
    label, number of the template, first and last word, words covered, words of the template. Words
    are runs of ASCII letters, digits and all code points beyond ASCII, with A-Z in lower case,
    counted from 0. Null, empty and wordless texts have empty lists; a null id stays null; repeated
    rows carry the same result. All other columns are left.
    """
    scanner = scanner or Scanner(TEMPLATES, PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("places", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int32()), ("length", pa.int32())])))])
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), lower=True, space=_BREAKS)
            found = scanner.scan(words)
            places = [[dict(zip(("label", "first_word"), x)) for x in found[i][0]] if i in found else [] for i in range(batch.num_rows)]
            spans = [[dict(zip(("label", "template", "first_word", "last_word", "covered", "length"), x)) for x in found[i][1]] if i in found else [] for i in range(batch.num_rows)]
            lists = [pa.array(x, kinds.field(i).type) for i, x in enumerate((places, spans))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), *lists], names=["doc_id", "n_words", "places", "spans"])

    return id_and_text(docs, key, text).mapInArrow(run, SCHEMA)


def summary(rows: DataFrame) -> DataFrame:
    """Labels, first and last place and the score of scanned() rows.

    score is the largest covered share of a template; a base phrase is covered whole and counts as 1.
    """
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts, base = F.col("places.first_word"), F.col("places.label")
    share = F.array_max(F.transform("spans", lambda s: s["covered"] / s["length"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
