"""License scans by patience alignment.

Words of a text and a template are compared after lower-casing and without marks around them. In texts
with enough of a template's words, the words of the template are looked at in order and all others left
out, however many there are. A window of them is aligned with the template: words unique to both the
window and the template are anchors, the longest increasing subsequence of them is kept, and the gaps
between anchors are aligned in the same way; the window then moves to where the alignment began. Aligned
words with more than a template's length (``LEAST_GAP`` at least) of other words between them belong to
different findings. The coverage is the part of the template's words that are aligned.

Edge cases: null and empty texts have no finding; a text may hold several templates, or one several
times; a finding inside a longer one of another template is kept. Rows keep their multiplicity; only
the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text
from skyloom.llm.langid import trimmed_words

#: Least coverage of a finding.
COVERAGE = 0.8
#: Words between aligned ones of one finding, for templates shorter than that.
LEAST_GAP = 8
# Notices and passages of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY": "Licensed under CC BY 4.0",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(raws: list[bytes]):
    """Hashes of the words with something between their marks, their byte spans, and the bounds of texts."""
    low, starts, ends, bounds = trimmed_words(raws)
    real = ends > starts
    kept = np.concatenate([[0], np.cumsum(real)])
    return _text.span_hashes(low, starts[real], ends[real]), starts[real], ends[real], kept[bounds]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(last[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        # equal words at the ends of a gap belong together
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        places: dict[int, list[int]] = {}
        for side, text, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(lo, hi):
                places.setdefault(text[i], [0, 0, -1, -1])
                places[text[i]][side] += 1
                places[text[i]][2 + side] = i
        unique = sorted((p[2], p[3]) for p in places.values() if p[0] == 1 and p[1] == 1)
        if not unique:
            continue
        chain = [unique[i] for i in longest_increasing([y for _, y in unique])]
        out += chain
        x, y = a0, b0
        for p, q in [*chain, (a1, b1)]:
            if x < p and y < q:
                work.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(out)


def findings(hits: list[int], at: list[int], words: list[int], has: np.ndarray, need: int):
    """(first, last, number) of the aligned words of every finding; ``hits``: the template's words in a text, ``at``: their places there."""
    width, gap = 2 * len(words), max(len(words), LEAST_GAP)
    # words of a window that the template can take, kept up to date as the window moves
    held = np.zeros(len(has), np.int64)
    shared = begin = end = 0

    def best(lo):
        pairs = patience(hits[lo : lo + width], words)
        runs: list[list[int]] = [[]]
        for i, _ in pairs:
            if runs[-1] and at[lo + i] - at[lo + runs[-1][-1]] - 1 > gap:
                runs.append([])
            runs[-1].append(i)
        run = max(runs, key=len)
        return (len(run), lo + run[0], lo + run[-1]) if run else (0, lo, lo)

    while begin < len(hits):
        while end < min(len(hits), begin + width):
            shared += held[hits[end]] < has[hits[end]]
            held[hits[end]] += 1
            end += 1
        move = begin + 1
        if shared >= need:
            found = best(begin)
            # from where the alignment begins the window reaches further
            while found[0] and (again := best(found[1]))[0] > found[0]:
                found = again
            if found[0] >= need:
                yield at[found[1]], at[found[2]], found[0]
                move = found[2] + 1
        for i in range(begin, min(move, end)):
            held[hits[i]] -= 1
            shared -= held[hits[i]] < has[hits[i]]
        begin, end = move, max(move, end)


#: Bytes of all templates that are read from a folder.
TEMPLATE_BYTES = 8 << 20


class Scanner:
    """Templates in hashed form; one for each worker."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names, self.coverage = list(templates), coverage
        self.words = [words_of([t.encode()])[0] for t in templates.values()]
        self.table = np.unique(np.concatenate(self.words))
        # how often each word of the table is in each template
        self.has = [np.bincount(np.searchsorted(self.table, w), minlength=len(self.table)) for w in self.words]
        self.words = [np.searchsorted(self.table, w).tolist() for w in self.words]

    def scan(self, raws: list[bytes]):
        """(text, template, coverage, aligned words, start byte, end byte) of every finding."""
        keys, starts, ends, bounds = words_of(raws)
        if not len(keys):
            return []
        place = np.minimum(np.searchsorted(self.table, keys), len(self.table) - 1)
        spots = np.flatnonzero(self.table[place] == keys)
        place = place[spots]
        text = np.searchsorted(bounds, spots, side="right") - 1
        pairs, counts = np.unique(text * len(self.table) + place, return_counts=True)
        holder, word = pairs // len(self.table), pairs % len(self.table)
        offset = np.cumsum([0] + [len(r) + 1 for r in raws])
        out = []
        for name, words, has in zip(self.names, self.words, self.has, strict=True):
            need = int(np.ceil(self.coverage * len(words) - 1e-9))
            shared = np.bincount(holder, np.minimum(counts, has[word]), len(raws))
            for d in np.flatnonzero(shared >= need).tolist():
                own = slice(*np.searchsorted(text, [d, d + 1]))
                mine = spots[own][has[place[own]] > 0]
                for first, last, n in findings(place[own][has[place[own]] > 0].tolist(), mine.tolist(), words, has, need):
                    out.append((d, name, n / len(words), n, int(starts[first] - offset[d]), int(ends[last] - offset[d])))
        by_text: dict[int, list] = {}
        for x in out:
            by_text.setdefault(x[0], []).append(x)
        # a near variant gives way to the template that fits the place better
        return [x for own in by_text.values() for x in own if not any(y[2] > x[2] and y[3] >= x[3] and y[4] < x[5] and x[4] < y[5] for y in own)]


def read_templates(spark, folder: str, pattern: str = "*") -> dict[str, str]:
    """Templates from a folder of texts, a file each under its name: whole licences, as long as they like.

    They go to every task, so texts of over ``TEMPLATE_BYTES`` in all are refused.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > TEMPLATE_BYTES:
        raise ValueError(f"templates of {total} bytes: at most {TEMPLATE_BYTES} go to every task")
    return {r.path.rsplit("/", 1)[-1]: bytes(r.content).decode("utf-8", "replace") for r in files.orderBy("path").collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, n_words (aligned), start_char and end_char (code points) of every finding; one pass, no shuffle."""
    chosen = TEMPLATES if templates is None else templates
    names = ["doc_id", "license", "coverage", "n_words", "start_char", "end_char"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, _, raws in _text.blocks(batch.column("text").to_pylist()):
                rows = []
                for d, name, part, n, a, b in scanner.scan(raws):
                    before = len(raws[d][:a].decode("utf-8", "replace"))
                    rows.append((ids[lo + d], name, part, n, before, before + len(raws[d][a:b].decode("utf-8", "replace"))))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, license string, coverage double, n_words long, start_char long, end_char long")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
