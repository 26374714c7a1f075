"""Licence scans by patience alignment of documents with licence texts.

Text and template are aligned on words that are unique on both sides: the longest chain
of them in the same order holds, and each gap between two is aligned the same way. The
share of a template's words that is aligned is its coverage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.line_dedup import patience
from hrefsieve.llm.tables import slices

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: share of a template that has to be aligned, and of the words between the first and the
#: last aligned word of the text
COVERAGE, DENSITY = 0.8, 0.5
#: fixed values: wording of public licence notices
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
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
    "mit-notice": "Released under the MIT License.",
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}


def words_in(text: str) -> list[str]:
    """Lower-case words of a text."""
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    """Aligns texts with a set of templates."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words_in(t) for name, t in sorted(templates.items())}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        self.known = frozenset(w for t in self.templates.values() for w in t)

    def scan(self, words: list[str]) -> list[tuple[str, int, float, int, int]]:
        """(template, aligned words, coverage, first and last aligned word) of every template found.

        A text may hold a template more than once or among other text. At most m words of
        a template that is found are not aligned, so of any m + 1 of its words one is. The
        m + 1 that are rarest in the text say where to look, missing ones first, so a text
        that lacks more than m of them is done: the text is aligned around each of their
        places, a template's length and a half to both sides of where the template would
        then lie. Words that the template repeats count with each of their places.
        """
        seen = self.known.intersection(words)
        counts = {name: sum(n for w, n in c.items() if w in seen) for name, c in self.counts.items()}
        if all(n < COVERAGE * len(self.templates[name]) or not n for name, n in counts.items()):
            return []
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.known:
                places.setdefault(w, []).append(i)
        out = []
        for name, template in self.templates.items():
            if counts[name] < COVERAGE * len(template) or not counts[name]:
                continue
            missed = len(template) - math.ceil(COVERAGE * len(template))
            rare = sorted(range(len(template)), key=lambda k: (len(places.get(template[k], ())), k))[: missed + 1]
            slack = len(template) // 2 + 2
            best = None
            for lo in sorted({p - k for k in rare for p in places.get(template[k], ())}):
                start = max(0, lo - slack)
                aligned = patience(words[start : lo + len(template) + slack], template)
                if len(aligned) >= COVERAGE * len(template):
                    first, last = start + aligned[0][0], start + aligned[-1][0]
                    if len(aligned) >= DENSITY * (last - first + 1):
                        best = max(best or (0, 0, 0), (len(aligned), -first, -last))
            if best:
                out.append((name, best[0], best[0] / len(template), -best[1], -best[2]))
        return out


def _scanned(templates: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("aligned", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                rows = scanner.scan(words_in(text or ""))
                places = [m.span() for m in WORD.finditer(text)] if rows else []
                found.append([{"licence": n, "aligned": a, "coverage": c, "start": places[i][0], "end": places[j][1]} for n, a, c, i, j in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: the template with most aligned words, and all that were found.

    doc_id, licence, aligned (words), coverage, start and end (characters of the whole
    text), licences (names of all found, in order). Ties go to the larger coverage, then
    the first name. Empty and null texts, and texts without a licence, have null and an
    empty list. Nothing moves between tasks. Other columns are not read.
    """
    schema = "doc_id long, found array<struct<licence: string, aligned: int, coverage: double, start: int, end: int>>"
    rows = docs.select("doc_id", "text").mapInArrow(_scanned(templates), schema)
    order = F.transform("found", lambda x: F.struct((-x["aligned"]).alias("a"), (-x["coverage"]).alias("c"), x["licence"].alias("n"), x.alias("x")))
    best = F.get(F.sort_array(order), F.lit(0))["x"]
    return rows.select(
        "doc_id", *[best[c].alias(c) for c in ("licence", "aligned", "coverage", "start", "end")],
        F.transform("found", lambda x: x["licence"]).alias("licences"),
    )
