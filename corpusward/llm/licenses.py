"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates. A text's words stream through it: at each
word it gives the longest template substring that ends there. Long matches of one template that
follow each other, in the text and in the template, chain into a span; a template is found where
a span covers enough of its words. Only stretches of words that all occur in templates are
streamed, since any other word takes the automaton back to its start.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.text import ALNUM, FOLD, find_words, hash_words, runs

# Texts of licences. Fixed values.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Notices by which licences are named or granted, and whole licences: label, text. Fixed values.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "This work is dedicated to the public domain"),
    ("mit", _MIT),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd", f"{_BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
]
#: Phrases that are counted wherever their words stand consecutively: phrase, label. Fixed values.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def word_hashes(text: str) -> list[int]:
    data = FOLD[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = find_words(data, np.array([0, len(data)]), ALNUM)
    return hash_words(data, starts, ends).tolist()


@dataclass
class Automaton:
    """The generalised suffix automaton of word sequences."""

    sequences: list[list[int]]
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(self.sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].add((t, i + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]  # (template, words up to the end) of each place

    def _new(self, length: int, step: dict, link: int, ends) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, ends) -> int:
        """The state of exactly the strings that `p` and `w` make."""
        q = self.step[p][w]
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q], ends)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int, ends) -> int:
        if w in self.step[last]:
            return self._split(last, w, ends)
        state, p = self._new(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, ends)
        return state

    def longest(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(state, place after the last word, length) of the matches of at least `least` words that
        can't be longer to the right, from the matching statistics of each place."""
        found, state, n = [], 0, 0
        for i, w in enumerate(words):
            if w not in self.step[state]:
                if n >= least:
                    found.append((state, i, n))
                while state and w not in self.step[state]:
                    state = self.link[state]
                n = self.length[state]
            if w in self.step[state]:
                state, n = self.step[state][w], n + 1
        if n >= least:
            found.append((state, len(words), n))
        return found


class Scanner:
    def __init__(self, templates, phrases, least: int, cover: float, gap: int):
        self.labels, self.least, self.cover, self.gap = [x for x, _ in templates], least, cover, gap
        self.automaton = Automaton([word_hashes(t) for _, t in templates])
        self.size = [len(s) for s in self.automaton.sequences]
        self.vocabulary = np.unique(np.array([w for s in self.automaton.sequences for w in s] or [0], np.uint64))
        self.phrases = [(np.array(word_hashes(p), np.uint64), label) for p, label in phrases]

    def spans(self, stretches: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, coverage) of templates found; stretches: (first
        place, words), in the order of the text."""
        chains: dict[int, list[list]] = {}  # template: [first, end, covered words, template place] of its chains; the last is open
        for begin, words in stretches:
            for state, end, n in self.automaton.longest(words, self.least):
                start = begin + end - n
                for t, place in self.automaton.ends[state]:
                    own = chains.setdefault(t, [])
                    if own and own[-1][0] == start and n <= own[-1][2]:
                        continue  # another place in the template of a match that has one
                    if own and start - own[-1][1] <= self.gap and place > own[-1][3] and start >= own[-1][0]:
                        open_ = own[-1]
                        open_[2] += min(n, place - open_[3])
                        open_[1], open_[3] = begin + end, place
                    else:
                        own.append([start, begin + end, n, place])
        made = [(self.labels[t], a, b, min(1.0, c / self.size[t])) for t, own in chains.items() for a, b, c, _ in own]
        return sorted(x for x in made if x[3] >= self.cover)

    def scan(self, texts) -> list[tuple]:
        """(words, base places, first, last, base labels, spans) of each text."""
        out = []
        for low, high, data, offsets in runs(texts):
            data = FOLD[data]
            starts, ends, first = find_words(data, offsets, ALNUM)
            words = hash_words(data, starts, ends)
            counts = np.diff(first)
            row = np.repeat(np.arange(high - low), counts)
            base: list[tuple[int, int, str]] = []
            for phrase, label in self.phrases:
                k = len(phrase)
                if len(words) < k:
                    continue
                hit = np.flatnonzero(words[: len(words) - k + 1] == phrase[0])
                for j in range(1, k):
                    hit = hit[words[hit + j] == phrase[j]]
                hit = hit[row[hit] == row[hit + k - 1]]
                base += [(r, p, label) for r, p in zip(row[hit].tolist(), (hit - first[row[hit]]).tolist())]
            by_row: dict[int, list[tuple[int, str]]] = {}
            for r, p, label in base:
                by_row.setdefault(r, []).append((p, label))
            at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == words
            edge = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
            a, b = edge[::2], edge[1::2]
            long = b - a >= self.least
            stretches: dict[int, list[tuple[int, list[int]]]] = {}
            for i, j in zip(a[long].tolist(), b[long].tolist()):
                r = int(row[i])
                while i < j:  # a stretch may go on into the next text
                    stop = min(j, int(first[r + 1]))
                    if stop - i >= self.least:
                        stretches.setdefault(r, []).append((i - int(first[r]), words[i:stop].tolist()))
                    i, r = stop, r + 1 if stop < j else r
                    while i < j and first[r + 1] <= i:
                        r += 1
            for r in range(high - low):
                places = by_row.get(r, [])
                spans = self.spans(stretches[r]) if r in stretches else []
                out.append((int(counts[r]), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), sorted({x for _, x in places}), spans))
        return out


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]


def _scan_batches(batches, how):
    scanner = Scanner(*how)
    for batch in batches:
        found = list(zip(*scanner.scan(batch.column("text")))) or [[]] * 6
        columns = [pa.array(x if name != "spans" else [[dict(zip(("label", "first_word", "end_word", "coverage"), s)) for s in some] for some in x], kind) for (name, kind), x in zip(_FIELDS, found)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", *(n for n, _ in _FIELDS)])


def scan(docs: DataFrame, templates=tuple(TEMPLATES), phrases=tuple(PHRASES), least: int = 4, cover: float = 0.8, gap: int = 50) -> DataFrame:
    """docs (all columns in a struct `doc`) with n_words; the base phrases' n_base, first_word,
    last_word (null if none) and base_labels; spans (label, first_word, end_word, coverage) of
    templates of which a chain of matches of at least `least` words, with at most `gap` words
    between two, covers `cover` of the words; labels (base and spans', distinct and sorted) and
    score (the best coverage; 0 if there is no span).

    A null or empty text has no words, labels or spans. Repeated rows come out repeated; no rows
    give no rows."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    out = rows.select("doc", *[null("long", n) for n in ("n_words", "n_base", "first_word", "last_word")], null("array<string>", "base_labels"), null("array<struct<label:string,first_word:long,end_word:long,coverage:double>>", "spans")).schema
    found = rows.mapInArrow(partial(_scan_batches, how=(list(templates), list(phrases), least, cover, gap)), out)
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    return found.withColumn("labels", labels).withColumn("score", F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))
