"""License scans: an exact set-similarity join of text blocks with license templates.

A template fits a text if some block of it holds at least the share ``threshold``
of the template's distinct words; a block is any run of consecutive words that is
half as long again as the template. Every block counts, wherever it begins.

The templates' words are counted over all documents first. Sorted from the
rarest on, a template that fits must share one of its first
``size - needed + 1`` words with the block (prefix filter), so only templates of
which a text has such a word are looked at; texts with too few distinct words are
out (length filter), and while the template's words are looked up in order, it is
left as soon as the words still to come cannot make up the number needed
(positional filter). For what is left the blocks are swept once, from each place
of a template word to the next. Phrases that must stand word for word go the same
way with a threshold of one and are then compared in place.

Templates are taken in chunks of bounded size, so their index has a bounded size
on every worker; more templates mean more passes.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())
#: Words of templates in one pass.
CHUNK_WORDS = 200_000

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Public license texts and notices, with the label that a near match adds.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this work is licensed under a creative commons attribution noncommercial international license", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
        "zlib",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "gpl",
    ),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. You should have received a copy of the GNU Lesser General Public License along with this library.",
        "lgpl",
    ),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at https://www.boost.org/LICENSE_1_0.txt", "boost"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", "cc-by-nc"),
)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    needed: int  # distinct words that a block must share
    exact: bool = False

    @property
    def span(self) -> int:
        """Words of a block."""
        return len(self.words) if self.exact else -(-3 * len(self.words) // 2)


def templates(texts: list[tuple[str, str]], threshold: float, exact: bool = False) -> list[Template]:
    out = []
    for text, label in texts:
        w = tuple(words(text))
        if w:
            out.append(Template(w, label, len(set(w)) if exact else math.ceil(threshold * len(set(w)) - 1e-9), exact))
    return out


def word_counts(docs: DataFrame, vocabulary: frozenset[str], text_col: str = "text") -> dict[str, int]:
    """Occurrences of the templates' words over all documents; at most one row a word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    seen.update(filter(vocabulary.__contains__, words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return {r.word: r.n for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates by the words of their prefixes, rarest first."""

    def __init__(self, items: list[Template], counts: dict[str, int]):
        self.items = items
        rank = {w: i for i, w in enumerate(sorted({w for t in items for w in t.words}, key=lambda w: (counts.get(w, 0), w)))}
        self.ordered = [sorted(set(t.words), key=rank.__getitem__) for t in items]
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for i, (t, o) in enumerate(zip(items, self.ordered, strict=True)):
            for w in o[: len(o) - t.needed + 1]:
                self.by_word[w].append(i)
        self.by_word = dict(self.by_word)

    def promising(self, i: int, there: set[str]) -> bool:
        """Whether the text has enough of the template's words at all."""
        need, left, n = self.items[i].needed, len(self.ordered[i]), 0
        if len(there) < need:
            return False
        for w in self.ordered[i]:
            if n + left < need:
                return False
            n += w in there
            left -= 1
        return n >= need

    def shared(self, i: int, text_words: list[str]) -> int:
        """Most distinct words of template ``i`` in any block of the text."""
        own, span = set(self.ordered[i]), self.items[i].span
        places = [(p, w) for p, w in enumerate(text_words) if w in own]
        inside: Counter[str] = Counter()
        best = first = 0
        for p, w in places:
            inside[w] += 1
            while places[first][0] <= p - span:
                out = places[first][1]
                inside[out] -= 1
                if not inside[out]:
                    del inside[out]
                first += 1
            best = max(best, len(inside))
        return best

    def scan(self, text_words: list[str]) -> tuple[list[tuple[int, int]], dict[int, float]]:
        """Exact places ``(start, template)`` and the best containment by template that fits some block."""
        index, places, best, looked, there = self.by_word, set(), {}, set(), None
        for at in [i for i, w in enumerate(text_words) if w in index]:
            for i in index[text_words[at]]:
                t = self.items[i]
                if t.exact:
                    for off, w in enumerate(t.words):
                        if w == text_words[at] and at >= off and tuple(text_words[at - off : at - off + len(t.words)]) == t.words:
                            places.add((at - off, i))
                elif i not in looked:
                    looked.add(i)
                    there = set(text_words) if there is None else there
                    if self.promising(i, there) and (n := self.shared(i, text_words)) >= t.needed:
                        best[i] = n / len(self.ordered[i])
        return sorted(places), best


def scan(docs: DataFrame, phrases: list[tuple[str, str]], texts: list[tuple[str, str]], threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of ``phrases``, first and last are their
    smallest and largest starts. ``labels`` adds those of the templates that fit
    a block; ``score`` is the largest containment (one for a phrase). A null
    text counts as empty. Rows keep their number; an empty table gives an empty
    result; without templates nothing is found; further columns are ignored.
    """
    items = templates(phrases, 1.0, exact=True) + templates(texts, threshold)
    if len(items) > 1 and sum(len(t.words) for t in items) > CHUNK_WORDS:
        return _in_chunks(docs, phrases, texts, threshold, id_col, text_col)
    index = Index(items, word_counts(docs, frozenset(w for t in items for w in t.words), text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                w = words(t.as_py())
                places, best = index.scan(w)
                base = {items[i].label for _, i in places}
                more = base | {items[i].label for i in best}
                rows.append((len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(more)), 1.0 if places else max(best.values(), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _in_chunks(docs: DataFrame, phrases: list, texts: list, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One pass per chunk of templates; results of equal rows are put together."""
    both = [(p, True) for p in phrases] + [(t, False) for t in texts]
    chunks, size = [[]], 0
    for item, exact in both:
        n = len(words(item[0]))
        if size + n > CHUNK_WORDS and chunks[-1]:
            chunks.append([])
            size = 0
        chunks[-1].append((item, exact))
        size += n
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    numbered = rows.withColumn("doc_id", F.struct(F.col("_id").alias("id"), F.xxhash64("text").alias("h"), F.hash("text").alias("g")))
    parts = None
    for chunk in chunks:
        found = scan(numbered, [p for p, e in chunk if e], [t for t, e in chunk if not e], threshold)
        found = found.groupBy("doc_id", *NAMES).agg(F.count(F.lit(1)).alias("copies"))
        parts = found if parts is None else parts.unionByName(found)
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(c, ","), lambda x: x != ""))))), ",").alias(c)
    one = parts.groupBy("doc_id", "copies").agg(F.max("n_words").alias("n_words"), F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), join("base_labels"), join("labels"), F.max("score").alias("score"))
    return one.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(F.col("doc_id.id").alias("doc_id"), *NAMES)
