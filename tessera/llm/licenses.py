"""License scans by patience alignment.

Words are runs of letters and digits, lower case. A template is aligned with the text: words that are unique in both are anchors, the longest increasing subsequence of their places is kept, and the
gaps between them are aligned in the same way; what is equal at a gap's ends is taken with it, and a gap without a word that is unique in both has its longest common subsequence. Coverage is the share
of the template's words that are aligned.

A text can have several copies, in which no word is unique then, and words of a template anywhere. So the whole text is searched for the place first: the longest common subsequence with the template of
which no two neighbours are further apart than REACH allows, the first of such. It is found exactly, without windows; what lies between its ends is aligned. Templates that match one place
are told apart by the words they have aligned: only the best stays.

Before, documents are left out that lack so many of a template's words that no alignment can reach the threshold; that is exact.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrays import ALNUM, U, column_bytes, parts, word_hashes, words
from tessera.llm._shared import letters

COVERAGE = 0.8

#: Words between two neighbours: of a template of up to SHORT words half its length, of a longer one this many times its length, as only a copy has so many of its words in order.
SHORT, FAR = 20, 4


def reach(m: int) -> int:
    """How far apart two neighbours may be in the text, of a template of m words."""
    return max(2, (m + 1) // 2) if m <= SHORT else FAR * m


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of the License, or (at "
    "your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the {1} for more details. You should have received a copy of the {1} along with {3}. If not, see https://www.gnu.org/licenses/."
)
_CREATIVE = {"CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0"}
_SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only"]

#: License texts, headers of files, and notices. Holders of a copyright aren't part of a text.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    **{f"{k}-notice": f"Licensed under {name}" for k, name in _CREATIVE.items()},
    **{f"{k}-tag": f"SPDX-License-Identifier: {k}" for k in _SPDX},
    "all-rights-reserved": "All rights reserved",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": _GNU.format("This program", "GNU General Public License", "3", "this program"),
    "LGPL-3.0-header": _GNU.format("This library", "GNU Lesser General Public License", "3", "this library"),
    "AGPL-3.0-header": _GNU.format("This program", "GNU Affero General Public License", "3", "this program"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
}

_other = re.compile(r"[\W_]+")


def template_words(text: str) -> list[str]:
    return _other.sub(" ", text.lower()).split()


def common(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a[a0:a1] and b[b0:b1]: a row of bits for each word of a."""
    places: dict = {}
    for i in range(b0, b1):
        places[b[i]] = places.get(b[i], 0) | 1 << (i - b0)
    full = (1 << (b1 - b0)) - 1
    row, rows = full, [full]
    for j in range(a0, a1):
        u = row & places.get(a[j], 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i = [], b1 - b0
    for j in range(a1 - a0, 0, -1):
        # down to the last word of b that the subsequence ends at
        while i and rows[j] >> (i - 1) & 1:
            i -= 1
        if not i:
            break
        if rows[j - 1] >> (i - 1) & 1:
            out.append((a0 + j - 1, b0 + i - 1))
            i -= 1
    return out[::-1]


def align(a: Sequence, b: Sequence, a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences of words, increasing in both."""
    todo, out = [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in where]
        ends: list[int] = []
        heads: list[int] = []
        before = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            at = bisect_left(ends, j)
            before[k] = heads[at - 1] if at else -1
            if at == len(ends):
                ends.append(j)
                heads.append(k)
            else:
                ends[at], heads[at] = j, k
        k, chain = heads[-1] if heads else -1, []
        while k >= 0:
            chain.append(both[k])
            k = before[k]
        if not chain:
            out.extend(common(a, b, a0, a1, b0, b1))
            continue
        chain.reverse()
        x, y = a0, b0
        for i, j in [*chain, (a1, b1)]:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        out.extend(chain)
    return sorted(out)


def common_length(text: Sequence, places: dict, m: int) -> int:
    """Length of the longest common subsequence with a template of m words, a bit for each; places has the bits of each word."""
    full = row = (1 << m) - 1
    for w in text:
        if w in places:
            u = row & places[w]
            row = ((row + u) | (row - u)) & full
    return m - row.bit_count()


def spread(text: Sequence, template: Sequence, least: int) -> tuple[int, int, int] | None:
    """(words, first word, last word + 1) of the longest common subsequence of at least `least` words that has no two neighbours further apart in the text than `reach` allows, the first of such."""
    m, best = len(template), None
    far = reach(m)
    places: dict = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    columns = {w: np.array([i for i in range(m) if b >> i & 1]) for w, b in places.items()}
    hits = [j for j, w in enumerate(text) if w in places]
    cuts = [0, *(k for k in range(1, len(hits)) if hits[k] - hits[k - 1] > far), len(hits)]
    for s, e in zip(cuts, cuts[1:]):
        run = hits[s:e]
        if e - s < least or common_length([text[j] for j in run], places, m) < least:
            continue
        # rows of the last `far` words: the best, over subsequences that end there, of length << 32 | start, for each end in the template or one before
        old, behind = [], []  # a queue of two stacks, with the maxima of each
        newest = np.zeros(m + 1, np.int64)
        for j in run:
            while (old[-1][0] if old else behind[0][0] if behind else j) < j - far:
                if not old:
                    tops = np.maximum.accumulate(np.stack([r for _, r in reversed(behind)]))
                    old, behind = [(k, top) for (k, _), top in zip(reversed(behind), tops)], []
                    newest = np.zeros(m + 1, np.int64)
                old.pop()
            before = np.maximum(newest, old[-1][1]) if old else newest
            at = columns[text[j]]
            row = np.zeros(m + 1, np.int64)
            row[at + 1] = np.where(before[at] > 0, before[at], j) + (1 << 32)
            top = int(row.max())
            if top >> 32 >= least:
                best, least = (top >> 32, top & 0xFFFFFFFF, j + 1), (top >> 32) + 1
            row = np.maximum.accumulate(row)
            behind.append((j, row))
            newest = np.maximum(newest, row)
    return best


def best_match(text: Sequence, template: Sequence, threshold: float = COVERAGE) -> tuple[float, int, int] | None:
    """(coverage, first word, last word + 1) of the alignment at the best place, if it reaches the threshold."""
    m = len(template)
    place = spread(text, template, max(1, int(np.ceil(threshold * m - 1e-9)))) if m else None
    if not place:
        return None
    pairs = align(text, template, place[1], place[2])
    if len(pairs) < place[0]:  # anchors that mislead, as words that are unique but out of order
        pairs = common(text, template, place[1], place[2], 0, m)
    return len(pairs) / m, pairs[0][0], pairs[-1][0] + 1


def best_of_places(found: list[tuple]) -> list[tuple]:
    """Of matches (name, words aligned, coverage, first, last + 1) those that no other with more words aligned, or as many and more coverage, covers for more than half; of equal ones the first by name."""
    order = sorted(found, key=lambda f: (-f[1], -f[2], f[0]))
    kept: list[tuple] = []
    for f in order:
        if not any(2 * (min(f[4], g[4]) - max(f[3], g[3])) > f[4] - f[3] for g in kept):
            kept.append(f)
    return sorted(kept)


def _scan(templates: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = {}
        for name, text in templates.items():
            offsets, data = column_bytes(pa.array([" ".join(template_words(text))]))
            starts, ends, _ = words(offsets, data, ALNUM)
            hashed[name] = word_hashes(data, starts, ends)
        names = list(hashed)
        vocabulary = np.unique(np.concatenate([*hashed.values(), np.zeros(0, U)]))
        share = np.zeros((len(names), len(vocabulary)))
        for k, h in enumerate(hashed.values()):
            np.add.at(share[k], np.searchsorted(vocabulary, h), 1 / max(1, len(h)))
        lists = {k: h.tolist() for k, h in hashed.items()}
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, offsets, data in parts(batch.column("text")):
                starts, ends, row = words(offsets, data, ALNUM)
                if not len(starts) or not len(vocabulary):
                    continue
                h = word_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                there = np.zeros((b - a, len(vocabulary)), bool)
                there[row[hit], at[hit]] = True
                able = there @ share.T >= threshold - 1e-9
                first = np.searchsorted(row, np.arange(b - a + 1))
                out = []
                for i in np.flatnonzero(able.any(axis=1)):
                    text = h[first[i] : first[i + 1]].tolist()
                    matched = []
                    for k in np.flatnonzero(able[i]):
                        m = best_match(text, lists[names[k]], threshold)
                        if m:
                            matched.append((names[k], round(m[0] * len(lists[names[k]])), *m))
                    out += [(ids[a + int(i)].as_py(), name, round(c, 6), s, e) for name, _, c, s, e in best_of_places(matched)]
                if out:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "license", "coverage", "start_word", "end_word"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) of each template covered to the threshold, once per document and template: the best place, the first of several; of templates that match
    one place the best, see `best_of_places`.

    A null or wordless text, and an empty template, have none. Rows that repeat give rows that repeat; a null id stays null.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), letters(F.col(text_col)).alias("text"))
    return cut.mapInArrow(_scan(templates, threshold), "doc_id long, license string, coverage double, start_word int, end_word int")
