"""License scans by patience alignment.

A text is compared with each license template of whose words it holds enough, around the template's rarest words: one
more than a match may lack, so every match holds one. A neighbourhood, widened until no more words align, and the
template are aligned: equal ends first, then the words that occur once in either, thinned to a longest increasing run of
positions, then the gaps between these, recursively. Coverage is the share of the template's words that are aligned;
matches of ``min_coverage`` or more are reported, the longest first, and no two overlap. Of matches that are equally long
the one of higher coverage is first, then the tighter one, then the earlier one, then the one whose name is less.

Words are runs of letters and digits, lower-cased. Defined results: null and empty texts match nothing; very long texts
are scanned whole, a part of an Arrow batch at a time; rows stay apart even if they agree; a null id is carried along; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

WORD = re.compile(r"[^\W_]+")
#: Opening notices of public licenses, and the sentences that name them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "MIT-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
}
#: Words that seed a comparison first, the rarest in ordinary text first; longer words come next.
ANCHORS = ("sublicense", "unencumbered", "mozilla", "redistributions", "redistribute", "apache", "gnu", "mit", "hereby", "licensed", "license", "permission", "copyright")


def words_of(text: str) -> list[str]:
    return [m[0].lower() for m in WORD.finditer(text)]


def increasing(places: list[int]) -> list[int]:
    """Positions in ``places`` of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, x in enumerate(places):
        pile = bisect_left(tops, x)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            ends.append(k)
        else:
            tops[pile], ends[pile] = x, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


#: Words of one side times words of the other, in gaps whose words repeat, that are aligned in full.
SMALL = 4096


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two short lists."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        above = table[-1]
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def align(a: list[str], b: list[str], full: bool = False) -> list[tuple[int, int]]:
    """Pairs of positions of equal words of ``a`` and ``b``, increasing in both. full: small gaps without words that are unique to both are aligned too."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        common = [k for k in range(a0, a1) if in_a[a[k]] == 1 and a[k] in at]
        anchors = [(common[k], at[a[common[k]]]) for k in increasing([at[a[k]] for k in common])]
        pairs += anchors
        if anchors:
            for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                todo.append((p + 1, r, q + 1, s))
        elif full and (a1 - a0) * (b1 - b0) <= SMALL:
            pairs += [(a0 + i, b0 + j) for i, j in longest(a[a0:a1], b[b0:b1])]
    return sorted(pairs)


def tightened(words: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words of the template, aligned as close to the middle one as the text allows."""
    out = [p for p, _ in pairs]
    middle = len(out) // 2
    for k in range(middle - 1, -1, -1):
        out[k] = next(i for i in range(out[k + 1] - 1, out[k] - 1, -1) if words[i] == words[out[k]])
    for k in range(middle + 1, len(out)):
        out[k] = next(i for i in range(out[k - 1] + 1, out[k] + 1) if words[i] == words[out[k]])
    return [(i, j) for i, (_, j) in zip(out, pairs, strict=True)]


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.min_coverage = min_coverage
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.vocabulary = frozenset(w for words in self.templates.values() for w in words)
        self.seeds: dict[str, dict[str, list[int]]] = {}  # by template and word: places in the template
        for name, words in self.templates.items():
            spare = len(words) - math.ceil(min_coverage * len(words) - 1e-9)  # words a match may lack
            rare = sorted(range(len(words)), key=lambda k: (self.counts[name][words[k]], ANCHORS.index(words[k]) if words[k] in ANCHORS else len(ANCHORS), -len(words[k]), k))  # noqa: B023
            chosen = {words[k] for k in rare[: spare + 1]}
            self.seeds[name] = {w: [k for k, x in enumerate(words) if x == w] for w in chosen}

    def possible(self, words: set[str]) -> list[str]:
        """Templates of whose words a text with these words holds enough."""
        words = words & self.vocabulary
        return [name for name, counts in self.counts.items() if sum(n for w, n in counts.items() if w in words) >= self.min_coverage * len(self.templates[name])] if words else []

    def grown(self, words: list[str], template: list[str], at: int) -> tuple[int, list[tuple[int, int]]]:
        """The alignment around where the template would begin, its window widened until that aligns no more words."""
        slack, best, low = max(2, len(template) // 4), [], 0
        while True:
            a, b = max(0, at - slack), at + len(template) + slack
            pairs = align(words[a:b], template)
            if 2 * len(pairs) >= self.min_coverage * len(template):  # worth a closer look
                pairs = max(pairs, align(words[a:b], template, full=True), key=len)
            if len(pairs) <= len(best):
                return low, best
            low, best = a, pairs
            if len(pairs) == len(template) or a == 0 and b >= len(words):
                return low, best
            slack *= 2

    def settled(self, words: list[str], template: list[str], at: int) -> tuple[int, list[tuple[int, int]]]:
        """``grown``, again from where the alignment says that the template begins, as long as that aligns more words; then drawn together."""
        low, pairs = self.grown(words, template, at)
        while 2 * len(pairs) >= self.min_coverage * len(template):
            middle = pairs[len(pairs) // 2]
            again, better = self.grown(words, template, low + middle[0] - middle[1])
            if len(better) <= len(pairs):
                break
            low, pairs = again, better
        return 0, tightened(words, [(low + i, j) for i, j in pairs])

    def scan(self, text: str) -> list[dict]:
        possible = self.possible({w.lower() for w in WORD.findall(text)})
        if not possible:
            return []
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in at]
        found = []
        for name in possible:
            template, seeds, begun = self.templates[name], self.seeds[name], set()
            whole = -1  # where the last match ends: what begins within it overlaps it, and one of them is left
            tried: set[tuple[int, int]] = set()  # words of the text and of the template that an alignment has put together
            for p, w in enumerate(words):
                for offset in seeds.get(w, ()) if p >= whole else ():
                    if p - offset in begun or (p, offset) in tried:
                        continue
                    begun.add(p - offset)
                    low, pairs = self.settled(words, template, p - offset)
                    tried.update((low + i, j) for i, j in pairs if template[j] in seeds)
                    if pairs and len(pairs) >= self.min_coverage * len(template):
                        found.append((len(pairs), len(pairs) / len(template), low + pairs[0][0], low + pairs[-1][0] + 1, name))
                        if found[-1][2] <= p:
                            whole = max(whole, found[-1][3])
        return [{"license": x[4], "coverage": x[1], "start": at[x[2]][0], "end": at[x[3] - 1][1]} for x in disjoint(found)]


def disjoint(found: list[tuple[int, float, int, int, str]]) -> list[tuple[int, float, int, int, str]]:
    """Of (words aligned, coverage, start, end, name) the best that don't overlap a better one, by start."""
    kept: list[tuple] = []
    starts: list[int] = []
    for x in sorted(set(found), key=lambda x: (-x[0], -x[1], x[3] - x[2], x[2], x[4])):
        k = bisect_left(starts, x[3])  # those from here on begin at or after its end
        if not k or kept[k - 1][3] <= x[2]:
            kept.insert(k, x)
            starts.insert(k, x[2])
    return kept


def scan(docs: DataFrame, min_coverage: float = 0.8, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<license, coverage, start, end>>), a row a document."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    scanner = Scanner(templates, min_coverage)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<license: string, coverage: double, start: int, end: int>>")


def summary(found: DataFrame) -> DataFrame:
    best = F.try_element_at(F.array_sort("found", lambda a, b: F.when(a["coverage"] != b["coverage"], F.when(a["coverage"] > b["coverage"], -1).otherwise(1)).otherwise(a["start"] - b["start"])), F.lit(1))
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), best["license"].alias("license"), F.round(best["coverage"], 6).alias("coverage"), text.alias("spans"))
