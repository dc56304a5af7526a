"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts become words in lower case with single blanks between. The hashes of every K bytes are winnowed: of each
WINDOW neighbours the least is kept, so any K + WINDOW - 1 bytes in common share a fingerprint. An inverted index of the
templates' fingerprints gives candidate places: one hit is enough. Hits that stand close are a cluster; a cluster whose words can't cover
the template is dropped, as no alignment of it could. Each other is aligned with its template, word by word, within a band along the
chain of its hits, so blocks left out or put in move the band. A match that covers MIN_COVERAGE of the template's words is reported with its span; of overlapping ones, that of the most words.

The templates are a fixed list, so what every task holds does not grow with the data.

Defined results: null and empty texts match nothing; null and repeated ids are ordinary rows, with a match each; an empty
table gives no rows; other columns are ignored. Texts are scanned whole, in chunks, so memory follows the chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import body, tune

K, WINDOW, BAND, MIN_COVERAGE = 12, 8, 12, 0.8
CHUNK = 1 << 19
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Public license notices and short license lines.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(TABLE).split()


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every K bytes."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(data) - K + 1, np.uint64)
        for i in range(K):
            h = h * np.uint64(0x100000001B3) + data[i : i + len(h)]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def winnow(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: the rightmost least hash of each WINDOW neighbours."""
    if len(data) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hashes(data)
    if len(h) <= WINDOW:
        at = np.array([len(h) - 1 - int(h[::-1].argmin())])
        return at, h[at]
    best, low = h[: len(h) - WINDOW + 1].copy(), np.zeros(len(h) - WINDOW + 1, np.int64)
    for i in range(1, WINDOW):
        nxt = h[i : i + len(best)]
        less = nxt <= best
        best = np.where(less, nxt, best)
        low[less] = i
    at = np.unique(low + np.arange(len(low)))
    return at, h[at]


class Index:
    """The templates' words, and for each fingerprint the templates and words where it stands."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(t for t in templates if normal_words(templates[t]))
        self.words = [normal_words(templates[t]) for t in self.names]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.counts = [Counter(w) for w in self.words]
        for t, words in enumerate(self.words):
            data = b" ".join(words)
            at, h = winnow(np.frombuffer(data, np.uint8))
            for a, x in zip(at.tolist(), h.tolist(), strict=True):
                self.places[x].append((t, data.count(b" ", 0, a)))
        self.known = np.array(sorted(self.places), np.uint64)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(place, hash) of the data's fingerprints that some template has."""
        out = []
        for base in range(0, max(1, len(data) - K - WINDOW + 2), CHUNK):
            at, h = winnow(np.frombuffer(data[base : base + CHUNK + K + WINDOW - 2], np.uint8))
            some = self.quick[(h >> np.uint64(48)).astype(np.int64)]
            at, h = at[some], h[some]
            found = np.searchsorted(self.known, h)
            same = (found < len(self.known)) & (self.known[np.minimum(found, len(self.known) - 1)] == h) if len(self.known) else np.zeros(len(h), bool)
            out += list(zip((at[same] + base).tolist(), h[same].tolist(), strict=True))
        return sorted(set(out))


def chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of hits (word of the text, word of the template), a longest run in which both ascend."""
    ends: list[tuple[int, int]] = []  # the least template word that ends a run of each length, and its hit
    back, hits = [], sorted(hits, key=lambda h: (h[0], -h[1]))
    for n, (_, i) in enumerate(hits):
        k = bisect_left(ends, (i, -1))
        back.append(ends[k - 1][1] if k else -1)
        ends[k : k + 1] = [(i, n)]
    out, n = [], ends[-1][1] if ends else -1
    while n >= 0:
        out.append(hits[n])
        n = back[n]
    return out[::-1]


def band(n: int, run: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each of n template words, the words of the text that it may stand for: BAND around the diagonals of the hits beside it."""
    out, k = [], 0
    for i in range(n):
        while k < len(run) and run[k][1] < i:
            k += 1
        beside = [h[0] - h[1] for h in run[max(0, k - 1) : k + 1]]
        out.append((i + min(beside) - BAND, i + max(beside) + BAND + 1))
    return out


def align(template: list[bytes], words: list[bytes], limits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Best local alignment within the limits: words matched, first and last word of the text.

    A match counts 2, a word left out or replaced -1. A cell holds score, matches and first word; the best alignments of the cells above, left and diagonal are extended.
    """
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for w, (low, high) in zip(template, limits, strict=True):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, low), min(len(words), high)):
            s, m, first = above.get(j - 1, (0, 0, j))
            if m == 0:
                first = j
            cell = (s + 2, m + 1, -first) if words[j] == w else (s - 1, m, -first)
            for other in (above.get(j), row.get(j - 1)):
                if other is not None:
                    cell = max(cell, (other[0] - 1, other[1], -other[2]))
            if cell[0] > 0:
                row[j] = (cell[0], cell[1], -cell[2])
                if words[j] == w and cell[0] > best[0]:
                    best = (cell[0], cell[1], -cell[2], j)
        above = row
    return best[1:]


def clusters(hits: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Hits whose words of the text are at most n words apart; of long ones, windows of 3n words that overlap by 2n, so that one holds all hits of a match."""
    out: list[list[tuple[int, int]]] = []
    for hit in sorted(hits):
        if not out or hit[0] - out[-1][-1][0] > n:
            out.append([])
        out[-1].append(hit)
    parts = []
    for held in out:
        at, first, last = held[0][0], 0, 0
        while True:
            while held[first][0] < at:
                first += 1
            while last < len(held) and held[last][0] < at + 3 * n:
                last += 1
            parts.append(held[first:last])
            if last == len(held):
                break
            at = max(at + n, held[first][0])
    return parts


def tries(hits: list[tuple[int, int]], n: int) -> Iterator[list[tuple[int, int]]]:
    """All hits, then those near each place where a copy of the template may begin: copies that follow each other have hits that ascend together."""
    yield hits
    last = None
    for begin in sorted({j - i for j, i in hits}):
        if last is None or begin - last > BAND:
            last = begin
            near = [h for h in hits if begin - BAND <= h[0] <= begin + n + n // 2 + BAND]
            if near and len(near) < len(hits):
                yield near


def matches(index: Index, text: str) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end in code points) of the text's matches."""
    words = normal_words(text)
    data = b" ".join(words)
    found = index.hits(data)
    if not found:
        return []
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
    at = np.searchsorted(starts, np.array([place for place, _ in found]), side="right") - 1
    for j, (_, h) in zip(at.tolist(), found, strict=True):
        for t, i in index.places[h]:
            hits[t].add((j, i))
    spans, out = None, []
    for t, own in sorted(hits.items()):
        template, need = index.words[t], index.counts[t]
        n = len(template)
        seen: list[tuple[int, int]] = []
        for left in clusters(sorted(own), n):
            while left:  # a cluster may hold several matches
                n_left = len(left)
                for some in tries(left, n):
                    low, high = max(0, some[0][0] - n - BAND), some[-1][0] + n + BAND
                    # words in common, wherever they stand: no alignment matches more
                    here = Counter(w for w in words[low:high] if w in need)
                    if sum(min(c, here[w]) for w, c in need.items()) < MIN_COVERAGE * n:
                        continue
                    m, first, last = align(template, words, band(n, chain(some)))
                    if m >= MIN_COVERAGE * n:
                        if not any(first <= b and a <= last for a, b in seen):
                            seen.append((first, last))
                            spans = spans or [x.span() for x in WORD.finditer(text)]
                            out.append((index.names[t], m / n, m, spans[first][0], spans[last][1]))
                        left = [h for h in left if not first <= h[0] <= last]
                        break
                if len(left) == n_left:
                    break
    # of overlapping matches, that of the most words stays
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(out, key=lambda m: (-m[2], -m[1], m[0], m[3])):
        if all(m[4] <= k[3] or k[4] <= m[3] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched_words, start, end: a row for each match in each row of docs."""
    tune(spark)
    index = Index(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                for m in matches(index, t.as_py()):
                    at.append(i)
                    rows.append(m)
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long")
