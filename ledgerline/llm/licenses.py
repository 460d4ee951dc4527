"""Licence scans: matching statistics against a generalised suffix automaton of licence texts.

The automaton holds every stretch of words of every template. A text is streamed through it: at each word
the longest stretch that ends there and occurs in a template is known, and its suffix links lead to the
shorter ones that other places of the templates end with. At each place of each template, stretches of
at least MIN_MATCH words that can't be made longer there are chained, template by template, in the order
of both the text and the template; a chain that covers enough of the template is a finding.

A stretch of MIN_MATCH words needs that many words in a row of which every neighbouring two occur side by
side in a template; elsewhere the automaton's match is shorter and can't matter. Those stretches are
found with numpy, and only they are streamed, from the start state, to the same statistics.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import blocks, text_buffer, words

MIN_MATCH = 4
MIN_COVERAGE = 0.7
#: Words of the text that two links of a chain may lie apart.
MAX_GAP = 40

TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "All-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
}
_NAMES = ["doc_id", "license", "start_word", "end_word", "n_covered", "n_template"]
_SCHEMA = "doc_id bigint, license string, start_word bigint, end_word bigint, n_covered int, n_template int"


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its stretches end, (template, position)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for which, sequence in enumerate(sequences):
            last = 0
            for position, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((which, position))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        sets: list[set[tuple[int, int]]] = [set(e) for e in ends]
        for s in order:
            if self.link[s] > 0:
                sets[self.link[s]] |= sets[s]
        self.ends = [sorted(e) for e in sets]

    def _state(self, length: int, link: int, following: dict[int, int], ends: list) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int, ends: list) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word, ends)
        current, p = self._state(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = current
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[current] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word, ends)
        return current

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest stretch of a template that ends there), word by word."""
        state, length, out = 0, 0, []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            following = self.next[state].get(word)
            state, length = (following, length + 1) if following is not None else (0, 0)
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP):
        self.names = sorted(k for k, v in templates.items())
        raw, offsets = text_buffer(pa.array([templates[k] for k in self.names], pa.string()))
        found = words(raw, offsets, 0, len(self.names))
        self.vocabulary, coded = np.unique(found.hashes, return_inverse=True)
        sequences = [coded[a:b].tolist() for a, b in zip(found.doc_bounds[:-1], found.doc_bounds[1:])]
        self.sizes = [len(s) for s in sequences]
        self.needs = [min(min_match, n) for n in self.sizes]
        self.automaton = Automaton(sequences)
        self.sequences = sequences
        self.least, self.min_coverage, self.max_gap = min([n for n in self.needs if n], default=1), min_coverage, max_gap
        self.shorter = [self._shorter(s) for s in range(len(self.automaton.next))]
        pairs = [coded[a : b - 1] * len(self.vocabulary) + coded[a + 1 : b] for a, b in zip(found.doc_bounds[:-1], found.doc_bounds[1:]) if b - a > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def _shorter(self, state: int) -> list[tuple[int, int, int]]:
        """(template, position, length) of the longest match at each place that a state's stretches don't end at but a suffix of them does."""
        known, out, state = set(self.automaton.ends[state]), [], self.automaton.link[state]
        while state > 0 and self.automaton.length[state] >= self.least:
            fresh = [e for e in self.automaton.ends[state] if e not in known]
            out += [(*e, self.automaton.length[state]) for e in fresh]
            known.update(fresh)
            state = self.automaton.link[state]
        return out

    def matches(self, code: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, first word of the template, length) of all matches that count and can't be made longer."""
        for k, (state, length) in enumerate(self.automaton.statistics(code)):
            if length < self.least:
                continue
            onward = code[k + 1] if k + 1 < len(code) else -1
            for which, position, n in [*((*e, length) for e in self.automaton.ends[state]), *self.shorter[state]]:
                sequence = self.sequences[which]
                if n >= self.needs[which] and (position + 1 == len(sequence) or sequence[position + 1] != onward):
                    yield which, k - n + 1, position - n + 1, n

    def stretches(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, template words by number) of all stretches that could hold a match that counts."""
        known = np.zeros(len(hashes) + 1, bool)
        code = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.bitmap[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        sure = self.vocabulary[at] == hashes[maybe]
        known[maybe[sure]], code[maybe[sure]] = True, at[sure]
        if self.least <= 1:
            joined = known[:-1][1:] & known[:-1][:-1]
        else:
            both = np.flatnonzero(known[:-1][1:] & known[:-1][:-1])
            joined = np.zeros(max(0, len(hashes) - 1), bool)
            joined[both[np.isin(code[both] * len(self.vocabulary) + code[both + 1], self.pairs)]] = True
        inner = bounds[1:-1]
        joined[inner[(inner > 0) & (inner < len(hashes))] - 1] = False  # no stretch crosses texts
        if self.least <= 1:
            start = np.flatnonzero(known[:-1] & ~np.concatenate([[False], joined]))
            stop = np.flatnonzero(known[:-1] & ~np.concatenate([joined, [False]])) + 1
        else:
            edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        for a, b in zip(start, stop):
            if b - a >= self.least:
                yield int(a), code[a:b]

    def findings(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(text, licence, start_word, end_word, words covered, words of the template)."""
        blocks_of: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for first, code in self.stretches(hashes, bounds):
            doc = int(np.searchsorted(bounds, first, side="right")) - 1
            for which, start, at, length in self.matches(code.tolist()):
                blocks_of.setdefault((doc, which), []).append((first + start - int(bounds[doc]), at, length))
        for (doc, which), found in sorted(blocks_of.items()):
            for start, end, covered in self.chains(found):
                if covered >= self.min_coverage * self.sizes[which]:
                    yield doc, self.names[which], start, end, covered, self.sizes[which]

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, covered) of the best chains that don't overlap in the text, the best first.

        Blocks (text, template, length) are linked where both starts rise; words shared with the block
        before count once. A block's best chain is the one that covers most words.
        """
        found = sorted(set(found))
        longest = max(n for _, _, n in found)
        best: list[tuple[int, int]] = []
        for j, (t, p, n) in enumerate(found):
            top = (n, -1)
            for i in range(j - 1, -1, -1):  # no further back than the longest block and the gap reach
                u, q, m = found[i]
                if t - (u + longest) > self.max_gap:
                    break
                if u >= t or q >= p or t - (u + m) > self.max_gap:
                    continue
                gain = n - max(0, u + m - t, q + m - p)
                if gain > 0 and best[i][0] + gain > top[0]:
                    top = (best[i][0] + gain, i)
            best.append(top)
        begin, stop = [t for t, _, _ in found], [t + n for t, _, n in found]
        for j, (_, i) in enumerate(best):  # a chain's first and last word follow from its last block's
            if i >= 0:
                begin[j], stop[j] = begin[i], max(stop[j], stop[i])
        out: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []  # in order; they don't overlap
        for j in sorted(range(len(found)), key=lambda j: (-best[j][0], j)):
            start, end = begin[j], stop[j]
            k = bisect(taken, (start, end))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
                taken.insert(k, (start, end))
                out.append((start, end, best[j][0]))
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP) -> DataFrame:
    """(doc_id, license, start_word, end_word, n_covered, n_template), a row for each covered span.

    A span covers at least min_coverage of the template's words, in chained matches of at least min_match
    words (or the whole template, if that is shorter). Case and punctuation play no part. A text may hold
    several licences, and one several times. Null, empty and wordless texts, empty tables and templates
    without words give no rows; rows that repeat, and rows with a null id, are scanned each. Other columns
    are ignored, whatever their names. Texts of any length are scanned whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, min_match, min_coverage, max_gap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for first, last in blocks(offsets):
                found = words(raw, offsets, first, last)
                rows = list(shared.value.findings(found.hashes, found.doc_bounds)) if len(found.hashes) and len(shared.value.vocabulary) else []
                if rows:
                    doc, name, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([first + d for d in doc])), pa.array(name), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.int32())))], _NAMES)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, _SCHEMA)
