"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

Templates are a fixed list of notices and whole licenses. Their words have numbers; a document's words are looked up, and
three-word runs of known words have fingerprints, of which winnowing keeps the least of every two neighbours: so any four
common words share one, and the shortest notices, of five words, are always candidates. The inverted index gives a
template and a diagonal for each kept fingerprint; around each bucket of diagonals, a banded local alignment finds the
template's words that the document has in order, then aligns again left and right of what it found. Of overlapping matches
the one with most words stays.

Defined results: null, empty and wordless texts have no match; a notice that occurs twice is reported twice; ties go to
the first template by name; repeated rows are answered singly; other columns are ignored. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: License notices by name (fixed values: the usual public wording).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights": "All rights reserved. No part of this work may be reproduced without permission.",
}
WORD = re.compile(r"[^\W_]+")
GRAM, BAND = 3, 6


@lru_cache(2)
def index(templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], list[tuple[str, np.ndarray]], dict[int, list[tuple[int, int]]]]:
    """Word numbers from 1, the templates as numbers, and fingerprint -> [(template, position)]."""
    ids: dict[str, int] = {}
    seqs = [(name, np.array([ids.setdefault(w, len(ids) + 1) for w in WORD.findall(text.lower())])) for name, text in templates]
    inverted = defaultdict(list)
    for t, (_, seq) in enumerate(seqs):
        h = fingerprints(seq)
        for p in winnow(h):
            inverted[int(h[p])].append((t, int(p)))
    return ids, seqs, dict(inverted)


NONE = np.iinfo(np.int64).max


def fingerprints(seq: np.ndarray) -> np.ndarray:
    """Hash of each three-word run; NONE where a word is unknown."""
    if len(seq) < GRAM:
        return np.zeros(0, np.int64)
    parts = [seq[i : len(seq) - GRAM + 1 + i].astype(np.int64) for i in range(GRAM)]
    h = (parts[0] * 1_000_003 + parts[1]) * 1_000_003 + parts[2]
    h = (h * 2_654_435_761) % ((1 << 61) - 1)
    return np.where(np.minimum.reduce(parts) > 0, h, NONE)


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the least fingerprint of every two neighbours."""
    if len(h) < 2:
        return np.flatnonzero(h != NONE)
    left = h[:-1] <= h[1:]
    keep = np.zeros(len(h), bool)
    keep[:-1] |= left
    keep[1:] |= ~left
    return np.flatnonzero(keep & (h != NONE))


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, lo: int, hi: int) -> tuple[int, int, int]:
    """Matched words, first and last document word of the best local alignment within the band and the words lo to hi."""
    best, prev = (0, 0, -1, -1), {}
    for i in range(len(template)):
        cur = {}
        for j in range(max(lo, i + diagonal - BAND), min(hi, i + diagonal + BAND + 1)):
            same = template[i] == doc[j]
            s, m, a = prev.get(j - 1, (0, 0, j))
            options = [(s + (1 if same else -1), m + same, a if m else j)]
            for s, m, a in (prev.get(j, (0, 0, j)), cur.get(j - 1, (0, 0, j))):
                options.append((s - 1, m, a))
            x = max(options, key=lambda o: (o[0], o[1]))
            if x[0] > 0:
                cur[j] = x
                if same and (x[0], x[1]) > best[:2]:
                    best = (x[0], x[1], x[2], j)
        prev = cur
    return best[1], best[2], best[3]


def alignments(template: np.ndarray, doc: np.ndarray, diagonal: int, least: float) -> Iterator[tuple[int, int, int]]:
    """All alignments within the band that cover enough of the template, apart from each other: the best, then what lies left and right of it."""
    parts = [(max(0, diagonal - BAND), min(len(doc), diagonal + BAND + len(template)))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least * len(template):
            continue
        m, a, b = align(template, doc, diagonal, lo, hi)
        if m:
            parts += [(lo, a), (b + 1, hi)]
            if m >= least * len(template):
                yield m, a, b


def scan(text: str | None, templates: tuple[tuple[str, str], ...], least: float) -> list[tuple[str, float, int, int]]:
    """(name, coverage, start, end) of each notice."""
    ids, seqs, inverted = index(templates)
    low = text.lower() if text else ""
    if text and len(low) != len(text):  # a letter whose lower case is longer stays as it is, so that positions hold
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    words = WORD.findall(low)
    doc = np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words))
    h = fingerprints(doc)
    diagonals = defaultdict(set)
    for p in winnow(h).tolist():
        for t, q in inverted.get(int(h[p]), ()):
            diagonals[t].add((p - q) // BAND)
    found = set()
    for t, ds in diagonals.items():
        name, seq = seqs[t]
        for d in ds:
            found.update((name, m / len(seq), a, b, m) for m, a, b in alignments(seq, doc, d * BAND + BAND // 2, least))
    if not found:
        return []
    at = [(m.start(), m.end()) for m in WORD.finditer(low)]
    out, taken = [], np.zeros(len(doc), bool)
    for f in sorted(found, key=lambda f: (-f[4], -f[1], f[0], f[3] - f[2], f[2])):
        if not taken[f[2] : f[3] + 1].any():
            taken[f[2] : f[3] + 1] = True
            out.append(f)
    return sorted(((n, c, at[a][0], at[b][1]) for n, c, a, b, _ in out), key=lambda x: x[2])


def find(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, start, end: one row per notice found."""
    fixed = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["doc_id"], b["text"], strict=True) for x in scan(t, fixed, least)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, license string, coverage double, start long, end long")
