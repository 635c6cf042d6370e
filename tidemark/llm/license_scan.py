"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds all templates, token by token. Texts are streamed through
it for matching statistics: at each word, the longest run ending there that
stands in some template. Runs that contain a whole base phrase give that
phrase's places; long maximal matches of a template are chained in order into
spans, and a template whose tokens are covered to COVERED or more adds its
label. Words are looked up and adjacent pairs checked against the automaton
in array operations; only runs of valid pairs are streamed, which is where
matches of two words or more can be.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, slices, word_hash, words

#: Phrases whose places are counted, and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Openings of well-known public licences, and their labels (fixed values).
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("this work is licensed under a creative commons attribution sharealike international license", "cc-by-sa"),
    ("licensed under the creative commons attribution license", "cc-by"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("the software is provided as is without warranty of any kind express or implied", "no-warranty"),
)
#: Whole public licence texts and notices, and their labels (fixed values).
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
    "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
    OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
    above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
    WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
    FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
    AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
    met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
    AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission.""", "bsd-3-clause"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
    obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
    distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
    the License for the specific language governing permissions and limitations under the License.""", "apache-2.0"),
    ("""Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
    worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display,
    publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""", "apache-2.0"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
    that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
    the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""", "gpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
    file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mpl-2.0"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
    arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
    and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
    you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
    would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
    the original software. 3. This notice may not be removed or altered from any source distribution.""", "zlib"),
)
MIN_MATCH, COVERED, MAX_GAP = 3, 0.6, 12
_WORD = re.compile("[0-9a-z]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over token numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of the state's strings
        for number, seq in enumerate(sequences):
            last = 0
            for i, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].add((number, i + 1))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def _state(self, size: int, link: int, nxt: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(nxt)
        self.ends.append(set())
        return len(self.size) - 1

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None and self.size[known] == self.size[last] + 1:
            return known
        if known is not None:
            return self._clone(last, token, known)
        cur = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, token, q)
        return cur

    def _clone(self, p: int, token: int, q: int) -> int:
        c = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        return c

    def step(self, state: int, size: int, token: int) -> tuple[int, int]:
        """State and length of the longest match once this token is read."""
        while state and token not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        to = self.next[state].get(token)
        return (0, 0) if to is None else (to, size + 1)


class Scanner:
    def __init__(self, base=BASE, templates=(*TEMPLATES, *TEXTS)):
        texts = [template_words(t) for t, _ in (*base, *templates)]
        tokens = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(tokens)}
        self.labels = [label for _, label in (*base, *templates)]
        self.seqs = [[number[w] for w in t] for t in texts]
        self.n_base = len(base)
        self.auto = Automaton(self.seqs)
        hashes = np.array([word_hash(w.encode()) for w in tokens], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.pairs = np.unique([a << 32 | b for s in self.seqs for a, b in zip(s, s[1:], strict=False)])
        self.singles = {s[0]: i for i, s in enumerate(self.seqs[: self.n_base]) if len(s) == 1}
        # Base phrases that end with a state's strings: (phrase, words). A state's own are as long as its longest
        # string; shorter ones stand at its suffix links, so those of all links are taken along.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.auto.size]
        for s in sorted(range(1, len(self.auto.size)), key=lambda s: self.auto.size[s]):
            k = self.auto.size[s]
            own = [(n, k) for n, e in sorted(self.auto.ends[s]) if n < self.n_base and e == k == len(self.seqs[n])]
            self.phrases[s] = own + self.phrases[self.auto.link[s]]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], -1)

    def scan(self, h: np.ndarray, bounds: np.ndarray):
        """Of every row with matches: base places (phrase, word) and maximal matches (template, from, to, word)."""
        places: dict[int, list] = {}
        found: dict[int, list] = {}
        if len(h) < 1:
            return places, found
        v = self.numbers(h)
        for token, phrase in self.singles.items():
            for i in np.flatnonzero(v == token).tolist():
                d = int(np.searchsorted(bounds, i, "right")) - 1
                places.setdefault(d, []).append((phrase, i - int(bounds[d])))
        good = np.zeros(len(v) + 1, bool)
        if len(v) > 1:
            good[:-2] = (v[:-1] >= 0) & (v[1:] >= 0) & np.isin(v[:-1] << 32 | v[1:], self.pairs)
        cuts = bounds[1:-1]
        good[cuts[cuts > 0] - 1] = False  # no pair crosses a text border
        edge = np.flatnonzero(np.diff(np.r_[False, good].astype(np.int8)))
        for a, b in edge.reshape(-1, 2).tolist():
            d = int(np.searchsorted(bounds, a, "right")) - 1
            self._stream(v[a : b + 1].tolist(), a - int(bounds[d]), places.setdefault(d, []), found.setdefault(d, []))
        return places, found

    def _stream(self, tokens: list[int], at: int, places: list, found: list) -> None:
        state = size = 0
        for i, t in enumerate([*tokens, None]):
            was, had = state, size
            state, size = self.auto.step(state, size, t) if t is not None else (0, 0)
            if had >= MIN_MATCH and size <= had:  # the match before this word could not be extended
                for n, end in self.auto.ends[was]:
                    if n >= self.n_base:
                        found.append((n, end - had, end, at + i - had))
            for n, words_ in self.phrases[state]:
                if words_ <= size and words_ > 1:
                    places.append((n, at + i + 1 - words_))

    def chains(self, matches: list) -> dict[int, tuple[float, int, int]]:
        """Share of each template covered by its best chain of matches, and the chain's words in the text.

        matches: (template, from, to, word). In a chain, matches follow one
        another in the text, at most MAX_GAP words apart, and in the template;
        where two of them overlap in either, the later one counts from the end
        of the earlier.
        """
        best: dict[int, tuple[float, int, int]] = {}
        by: dict[int, list] = {}
        for n, a, b, w in matches:
            by.setdefault(n, []).append((w, a, b))
        for n, own in by.items():
            own.sort()
            open_: list[tuple[int, int, int, int]] = []  # end in text, end in template, covered, first word
            for w, a, b in own:
                open_ = [c for c in open_ if w - c[0] <= MAX_GAP]
                chain = (w + b - a, b, b - a, w)
                for end, to, covered, first in open_:
                    late = max(0, end - w, to - a)  # words of this match that the chain has already
                    if late < b - a and covered + b - a - late > chain[2]:
                        chain = (w + b - a, b, covered + b - a - late, first)
                open_.append(chain)
                share = chain[2] / len(self.seqs[n])
                if share > best.get(n, (0.0,))[0]:
                    best[n] = (share, chain[3], chain[0])
        return best


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _scan(scanner):
    def run(batches):
        m = scanner.value
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for s in slices(b.column("text")):
                w = words(s, ALNUM)
                places, found = m.scan(w.hashes, w.bounds)
                n_words = np.diff(w.bounds).tolist()
                for i in range(s.hi - s.lo):
                    own, chains = places.get(i, ()), m.chains(found[i]) if found.get(i) else {}
                    at = [p for _, p in own]
                    base = {m.labels[n] for n, _ in own}
                    more = {m.labels[n] for n, (share, _, _) in chains.items() if share >= COVERED}
                    score = 1.0 if own else max((x[0] for x in chains.values()), default=0.0)
                    spans = sorted([m.labels[n], x, y, round(share, 4)] for n, (share, x, y) in chains.items())
                    for column, value in zip(out, (n_words[i], len(own), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), min(1.0, score), json.dumps(spans)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan(docs: DataFrame, base=BASE, templates=(*TEMPLATES, *TEXTS)) -> DataFrame:
    """Licence phrases and templates in every row of docs(doc_id, text).

    Returns doc_id, n_words, n_base (all places of base phrases), first_word
    and last_word (their smallest and largest first word, from 0, else null),
    base_labels and labels (with those of covered templates; distinct,
    sorted, comma-joined), score (1 with a base phrase, else the largest
    covered share of a template) and spans (JSON list of label, first word,
    end, share). Null texts are empty: no words, no labels, score 0. Texts of any length are taken whole. Rows
    with the same doc_id or text are rows of their own. Other columns are
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(base, templates))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(_scan(shared), _OUT)
