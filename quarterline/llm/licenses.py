"""Licence scans: matching statistics against a suffix automaton of licence texts.

1. The words of all licence templates, and of short phrases, go into one generalised suffix
   automaton (a state per set of equal end positions). It depends on the templates alone, is
   built on the driver from a parameter and broadcast.
2. A text is read as a stream of pieces of PIECE bytes, cut at a separator. For every word the
   automaton gives the matching statistic: the length of the longest run of words ending there
   that occurs in some template. Memory doesn't grow with the text, but for its matches.
3. A phrase ends at a word if its state is the current one or above it by suffix links, and
   the current match is as long as the phrase.
4. Where a match cannot be made longer and has at least LEAST words, it becomes a box: its place
   in the text and all its places in templates. Per template the boxes are cut apart where more
   than GAP words lie between them, and in each part the chain of boxes, in order in the text
   and in the template, that covers most template words is found (sparse dynamic programming
   over a Fenwick tree). Its share of the template's words is the span's coverage.
5. A span covering COVERED or more of a template gives the template's label. The score is the
   greatest coverage of any span; a text with a phrase but no such span scores at least
   PHRASE_SCORE.

Cases: a null or empty text has no words, no places and score 0; words are counted from 0 over
the whole text; equal coverages of a label keep the first span; repeated rows are scanned each;
an empty table gives an empty result; extra columns pass through ``scan_licenses`` untouched,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import fresh, query, table

# ---- Fixed values: base phrases with their labels, and the wording of public licences ----
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see"
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details. You should have received a copy of the GNU Lesser General Public License along with this "
        "library"
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, "
        "visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software."
    ),
}
#: One-line grants, with the label of the licence they name.
GRANTS = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Licensed under the GNU General Public License, version 2": "gpl-2.0",
    "Licensed under the GNU General Public License, version 3": "gpl-3.0",
    "Licensed under the GNU Affero General Public License, version 3": "agpl-3.0",
    "Licensed under the GNU Lesser General Public License": "lgpl",
    "Licensed under CC BY 4.0": "cc-by-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0",
    "Licensed under CC BY-ND 4.0": "cc-by-nd-4.0",
    "Licensed under the MIT License": "mit",
    "Licensed under the BSD 3-Clause License": "bsd",
    "Licensed under the Mozilla Public License, version 2.0": "mpl",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: GPL-2.0": "gpl-2.0",
    "SPDX-License-Identifier: GPL-3.0": "gpl-3.0",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd",
}

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Least words of a match that may belong to a span, share of a template that gives its label.
LEAST, COVERED = 4, 0.5
#: A grant counts when all of its words are found in order.
GRANT_COVERED = 1.0
#: Most words between two matches of one span.
GAP = 60
PHRASE_SCORE = 0.5
PIECE = 1 << 20


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers; state 0 is the empty run."""

    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    #: Places (template, end) of every state, and phrase numbers with lengths at or above a state.
    places: list[list[tuple[int, int]]]
    phrases: list[list[tuple[int, int]]]
    vocabulary: dict[bytes, int]
    #: Words, label and least coverage of every template.
    templates: list[tuple[int, str, float]]
    labels: list[str]


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower())


def build(templates: Iterable[tuple[str, str, float]], phrases: dict[str, str]) -> Automaton:
    """The automaton of ``(label, text, least coverage)`` templates and of phrases with labels."""
    vocabulary: dict[bytes, int] = {}
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    places: list[list[tuple[int, int]]] = [[]]

    def state(size: int) -> int:
        nxt.append({})
        link.append(0)
        length.append(size)
        places.append([])
        return len(nxt) - 1

    def split(p: int, w: int, q: int) -> int:
        """A copy of q for the runs that also end elsewhere."""
        copy = state(length[p] + 1)
        nxt[copy] = dict(nxt[q])
        link[copy], link[q] = link[q], copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def extend(last: int, w: int) -> int:
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else split(last, w, q)
        now = state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[now] = q if length[q] == length[p] + 1 else split(p, w, q)
        return now

    def add(text: str) -> list[int]:
        numbers = [vocabulary.setdefault(x, len(vocabulary)) for x in words_of(text)]
        last = 0
        for w in numbers:
            last = extend(last, w)
        return numbers

    facts, texts = [], []
    for label, text, least in templates:
        texts.append(add(text))
        facts.append((len(texts[-1]), label, least))
    named = [(add(p), label) for p, label in phrases.items()]

    def walk(numbers: list[int]) -> Iterator[int]:
        s = 0
        for w in numbers:
            s = nxt[s][w]
            yield s

    for t, numbers in enumerate(texts):  # the state of a prefix ends there; states above it too
        for end, s in enumerate(walk(numbers)):
            while s > 0 and length[s] >= LEAST:
                places[s].append((t, end))
                s = link[s]
    own: dict[int, list[tuple[int, int]]] = {}
    for i, (numbers, _) in enumerate(named):
        own.setdefault([0, *walk(numbers)][-1], []).append((i, len(numbers)))
    marked: list[list[tuple[int, int]]] = [[] for _ in nxt]
    for s in sorted(range(1, len(nxt)), key=length.__getitem__):
        marked[s] = [*own.get(s, []), *marked[link[s]]]
    return Automaton(nxt, link, length, places, marked, vocabulary, facts, [label for _, label in named])


def default_automaton() -> Automaton:
    whole = [(label, text, COVERED) for label, text in TEMPLATES.items()]
    return build([*whole, *((label, text, GRANT_COVERED) for text, label in GRANTS.items())], PHRASES)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Cuts at separators, so that no word is cut."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            cut = SEPARATOR.search(raw, end)
            end = cut.start() if cut else len(raw)
        yield raw[at:end].lower()
        at = end


def statistics(a: Automaton, raw: bytes, size: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """``(word, state, length)`` of every word with a match; then ``(words in all, 0, 0)``."""
    nxt, link, length, known = a.next, a.link, a.length, a.vocabulary.get
    n, s, k = 0, 0, 0
    for piece in pieces(raw, size):
        for n, w in enumerate(map(known, WORDS.findall(piece)), n):
            if w is None:
                s = k = 0
                continue
            while s and w not in nxt[s]:
                s = link[s]
                k = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                k += 1
                yield n, s, k
            else:
                k = 0
        n += 1 if WORDS.search(piece) else 0
    yield n, 0, 0


def best_chain(boxes: list[tuple[int, int, int]], words: int) -> tuple[int, int, int]:
    """``(covered words, first, last)`` of the best chain of ``(text start, template start, length)``.

    Boxes of a chain follow each other without overlap in text and template. The best chain so far
    that ends before a template place is kept in a Fenwick tree of maxima; a box enters it when the
    scan of the text has passed its end.
    """
    tree = [(0, 0, 0)] * (words + 1)

    def upto(i: int) -> tuple[int, int, int]:
        best = (0, 0, 0)
        while i > 0:
            best = max(best, tree[i])
            i &= i - 1
        return best

    def put(i: int, value: tuple[int, int, int]) -> None:
        while i <= words:
            tree[i] = max(tree[i], value)
            i += i & -i

    boxes = sorted(boxes)
    ends = sorted(range(len(boxes)), key=lambda i: boxes[i][0] + boxes[i][2])
    value: list[tuple[int, int, int]] = [(0, 0, 0)] * len(boxes)  # covered, -first, -last
    best, waiting = (0, 0, 0), 0
    for i, (x, t, k) in enumerate(boxes):
        while waiting < len(ends) and boxes[ends[waiting]][0] + boxes[ends[waiting]][2] <= x:
            j = ends[waiting]
            put(boxes[j][1] + boxes[j][2], value[j])
            waiting += 1
        covered, first, _ = upto(t)
        value[i] = (covered + k, first if covered else -x, -(x + k - 1))
        best = max(best, value[i])
    return best[0], -best[1], -best[2]


@dataclass
class Scan:
    n_words: int
    #: Phrase number and first word of every place.
    phrases: list[tuple[int, int]]
    #: Label, first word, last word and coverage.
    spans: list[tuple[str, int, int, float]]
    #: Greatest coverage, of spans too small for a label as well.
    best: float


def scan(a: Automaton, raw: bytes, size: int = PIECE) -> Scan:
    """One text (UTF-8) against the automaton."""
    phrases: list[tuple[int, int]] = []
    spans: list[tuple[str, int, int, float]] = []
    best = 0.0
    open_boxes: dict[int, list[tuple[int, int, int]]] = {}
    reach: dict[int, int] = {}

    def close(t: int) -> None:
        nonlocal best
        words, label, least = a.templates[t]
        covered, first, last = best_chain(open_boxes.pop(t), words)
        best = max(best, covered / words)
        if covered >= least * words:
            spans.append((label, first, last, covered / words))

    def box(n: int, s: int, k: int) -> None:
        for t, end in a.places[s]:
            start = n - k + 1
            if t in open_boxes and start - reach[t] > GAP:
                close(t)
            open_boxes.setdefault(t, []).append((start, end - k + 1, k))
            reach[t] = n

    n_words = before = state = held = 0
    for n, s, k in statistics(a, raw, size):
        if held >= LEAST and (n != before + 1 or k != held + 1):
            box(before, state, held)  # the match that ended there could not grow
        if not s:
            n_words = n
            break
        for i, words in a.phrases[s]:
            if k >= words:
                phrases.append((i, n - words + 1))
        before, state, held = n, s, k
    for t in list(open_boxes):
        close(t)
    return Scan(n_words, phrases, sorted(spans, key=lambda x: (x[1], x[2], x[0])), best)


_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()), T.StructField("coverage", T.DoubleType()),
        ]))),
    ]
)


def verdict(a: Automaton, found: Scan) -> tuple:
    base = sorted({a.labels[i] for i, _ in found.phrases})
    starts = [at for _, at in found.phrases]
    labels = sorted({*base, *(s[0] for s in found.spans)})
    score = max(found.best, PHRASE_SCORE if base else 0.0)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return found.n_words, len(starts), first, last, ",".join(base), ",".join(labels), min(1.0, score), found.spans


def scan_licenses(docs: DataFrame, text: str = "text", automaton: Automaton | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one struct column (its name is returned): counts, labels, score and spans.

    A batch sent to Python holds 500 texts or 8 MB, whichever is less.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    sent = spark.sparkContext.broadcast(automaton or default_automaton())

    def find(texts: pd.Series) -> pd.DataFrame:
        a = sent.value
        rows = [verdict(a, scan(a, x.encode("utf-8", "surrogatepass") if x else b"")) for x in texts]
        out = pd.DataFrame(rows, columns=_RESULT.names)
        for c in ("n_words", "n_base", "first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        out["spans"] = [[dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in x] for x in out["spans"]]
        return out

    name = fresh(docs, "licenses")[0]
    return docs.withColumn(name, F.pandas_udf(find, _RESULT).asNondeterministic()(F.col(f"`{text}`"))), name


@query("op11_license_scans")
def op11_license_scans(spark, sf_dir):
    found, s = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"{s}.{c}").alias(c) for c in _RESULT.names])
