"""License scans: winnowed template fingerprints pick candidates, banded
alignment of words reports matched coverage and spans.

An inverted index holds, for each winnowed hash of word k-grams, the templates
and positions it comes from. It is as large as the templates and goes to every
task. A document's k-grams are looked up in it; hits on one template and nearby
diagonals make a candidate, whose words are aligned with the template's within a
band around that diagonal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import rolling

K, WINDOW, BAND = 3, 3, 6
COVERAGE = 0.7  # the share of a template's words that must match in order

# The usual notices, and whole texts of the shorter ones, of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}

_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their spans in code points."""
    found = [(m.group().lower(), m.span()) for m in _WORDS.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def _hash(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def winnowed(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window, the rightmost of equals."""
    n = len(h)
    if n <= window:
        return np.array([n - 1 - int(h[::-1].argmin())]) if n else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


class Index:
    """The templates' words and the inverted index of their winnowed k-grams: each
    that winnowing selects is listed under its hash, and may start a candidate
    where a text, all of whose k-grams are looked up, has it too."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        self.words = [words_of(t)[0] for t in templates.values()]
        keys, places = [], []
        for t, words in enumerate(self.words):
            h = rolling(_hash(words), min(K, max(len(words), 1))) if words else np.empty(0, np.uint64)
            for p in winnowed(h).tolist():
                keys.append(int(h[p]))
                places.append((t, p, min(K, len(words))))
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.places = [places[i] for i in order.tolist()]

    def starts(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """By template the (diagonal, word) of its k-grams in the text, in order."""
        h = _hash(words)
        hits: dict[int, list[tuple[int, int]]] = {}
        for size in {p[2] for p in self.places}:
            r = rolling(h, size)
            at = np.searchsorted(self.keys, r)
            at[at == len(self.keys)] = 0
            for d in np.flatnonzero(self.keys[at] == r).tolist() if len(self.keys) else []:
                k = int(at[d])
                while k < len(self.keys) and self.keys[k] == r[d]:
                    t, p, n = self.places[k]
                    if n == size:
                        hits.setdefault(t, []).append((d - p, d))
                    k += 1
        return {t: sorted(some) for t, some in hits.items()}

    def matches(self, t: int, words: list[str], starts: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches of one template around the given diagonals, apart from each other."""
        out = []
        low, tried = 0, None  # words before low belong to matches
        for s, at in starts:
            if at < low or (s, low) == tried:
                continue
            tried = (s, low)
            found = self._match(t, words, s, low, len(words))
            # a match takes the last of equally good starts: there may be others before it
            some = []
            while found:
                some.insert(0, (t, *found))
                found = self._match(t, words, s, low, found[0])
            if some:
                out += some
                low = some[-1][2]
        return out

    def find(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word + 1, matched words) of the matches."""
        return [m for t, starts in self.starts(words).items() for m in self.matches(t, words, starts)]

    def _match(self, t: int, words: list[str], diagonal: int, low: int, high: int) -> tuple[int, int, int] | None:
        found = align(self.words[t], words, diagonal, low=low, high=high)
        return found if found and found[2] >= COVERAGE * len(self.words[t]) else None


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND, low: int = 0, high: int | None = None) -> tuple[int, int, int] | None:
    """(first, last + 1, matched): the longest common subsequence of the template
    and the words from low to before high, word j only against template words i
    with |j - i - diagonal| within the band; first and last bound the matched words, of alignments as
    good the one that ends first and is shortest."""
    width = 2 * band + 1
    high = len(words) if high is None else high
    # best[b] = (matched, -start): of equal counts the later start
    best = [(0, 0)] * width
    top: tuple[int, int, int] | None = None
    for i, w in enumerate(template):
        row = [(0, 0)] * width
        for b in range(width):
            j = diagonal + i + b - band
            choice = max(best[b + 1] if b + 1 < width else (0, 0), row[b - 1] if b else (0, 0))
            if low <= j < high and words[j] == w:
                n, start = best[b]
                choice = max(choice, (n + 1, start if n else j))
                if choice[0] == n + 1 and (top is None or n + 1 > top[0]):
                    top = (n + 1, choice[1], j + 1)
            row[b] = choice
        best = row
    return None if top is None else (top[1], top[2], top[0])


TEMPLATE_CHARS = 64 << 20  # of all templates, which every task holds


def read_templates(table: DataFrame, name_col: str = "name", text_col: str = "text") -> dict[str, str]:
    """Templates for ``scan`` from a table of any other licenses. Rows without a name
    or words are left out; of two texts of one name the second one, in order of the
    text, gets its number behind the name. A table of over TEMPLATE_CHARS is an error."""
    rows = table.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("name IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters: every task holds them, {TEMPLATE_CHARS} at most")
    out: dict[str, str] = {}
    seen: dict[str, int] = {}
    for row in rows.orderBy("name", "text").toLocalIterator():
        if words_of(row["text"])[0]:
            n = seen[row["name"]] = seen.get(row["name"], 0) + 1
            out[row["name"] if n == 1 else f"{row['name']} ({n})"] = row["text"]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage double, start int, end int): one row a match of a
    whole text, with spans in code points, coverage the share of the template's
    words matched in order. Null and empty texts match nothing; a notice that
    occurs twice gives two rows, and rows that repeat have theirs each. Templates
    match independently, so a whole license also gives its notice. No templates
    match nothing. No row moves."""
    index = Index(TEMPLATES if templates is None else templates)

    @F.pandas_udf("array<struct<license:string,coverage:double,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words, spans = words_of(t or "")
            out.append([(index.names[k], n / len(index.words[k]), spans[a][0], spans[b - 1][1]) for k, a, b, n in index.find(words)] if words else [])
        return pd.Series(out)

    found = docs.select(F.col(id_col).alias("id"), F.explode(run(F.col(text_col))).alias("m"))
    return found.select("id", "m.*")
