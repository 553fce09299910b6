"""License scans: winnowed fingerprints pick candidates, banded alignment reports matched coverage and spans.

Templates are reduced to words; the hashes of their k-word runs are winnowed (the least of each window
of them is kept), so that any shared run of ``GRAM + WINDOW - 1`` words shares a fingerprint. An
inverted index leads from fingerprints to (template, place). Each run of words of a text is looked up;
the words around each hit are aligned with its template inside a band of diagonals, then those on both
sides of what was found, until no hit is left: each occurrence is reported. A match counts if it covers enough of its
template; of matches that overlap the one with more matching words stays.

The templates are a parameter of bounded size and go to the workers with the code.

Cases: null and empty texts have no match and so no row; a null doc_id is passed through; repeated
rows are reported each; an empty table, and no templates, give an empty result; other columns are ignored. Texts of any
length are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.columns import Texts, pieces, windows
from leafmill.llm.decontam import WORD

GRAM, WINDOW = 3, 3
#: Diagonals beside those of the hits that an alignment may use.
BAND = 12
#: Least share of a template's words that a match covers.
COVERAGE = 0.8

#: Notices and texts of public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

SCHEMA = "license string, template int, template_words int, matched_words int, coverage double, start_word bigint, end_word bigint, start_byte bigint, end_byte bigint"


def winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the least hash, the rightmost of equals, of each window of ``WINDOW`` hashes; of fewer hashes, of the least."""
    if not len(h):
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, min(WINDOW, len(h)))
    k = view.shape[1] - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(np.arange(len(view)) + k)


class Templates:
    """Words of the templates and the inverted index of their fingerprints."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        t = Texts(pa.array([x for _, x in templates], pa.string()), lower=True)
        t.words(WORD)
        h = t.word_hash()
        self.names = [n for n, _ in templates]
        self.words = [h[a:b] for a, b in zip(t.w_first[:-1], t.w_first[1:], strict=True)]
        marks = [(int(x), k, int(p)) for k, w in enumerate(self.words) for g in [windows(w, GRAM)] for p, x in [(p, g[p]) for p in winnowed(g)]]
        marks.sort()
        self.hash = np.array([x for x, _, _ in marks], np.uint64)
        self.template = np.array([k for _, k, _ in marks], np.int64)
        self.place = np.array([p for _, _, p in marks], np.int64)


@cache
def index(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


#: Fields of a cell: score, matching words, and how far before the end of the run it starts.
_SCORE, _WORD, _START = 1 << 42, 1 << 22, (1 << 22) - 1


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Aligns template ``a`` with a run of words ``b``: (matching words, start, end) of the best local alignment.

    Only cells with low <= j - i <= high are looked at, a row of them at a time. A matching word scores 2, a
    different or missing one -1; of alignments of one score the one with more matching words, then the earliest.
    """
    wide = high - low + 1
    step = np.arange(wide) * _SCORE
    row, best = np.zeros(wide + 1, np.int64), (0, 0)
    for i in range(len(a)):
        j = np.arange(i + low, i + high + 1)
        inside = (j >= 0) & (j < len(b))
        fresh = _START - j
        from_ = np.where(row[:-1] >= _SCORE, row[:-1], fresh)
        same = inside & (b[np.clip(j, 0, len(b) - 1)] == a[i])
        cell = np.maximum(np.where(same, from_ + 2 * _SCORE + _WORD, from_ - _SCORE), row[1:] - _SCORE)
        cell = np.where(inside, cell, 0)
        cell = np.maximum.accumulate(cell + step) - step  # words of the text that are left out
        cell = np.where(inside & (cell >= _SCORE), cell, 0)
        k = int(cell.argmax())
        if cell[k] > best[0]:
            best = (int(cell[k]), int(j[k]) + 1)
        row[:-1] = cell
    return (best[0] % _SCORE // _WORD, _START - best[0] % _WORD, best[1]) if best[0] else (0, 0, 0)


def matches(words: np.ndarray, t: Templates, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matching words, start, end) in the words of one text.

    Each hit that no match of its template holds yet is aligned inside its band, with the words between the
    matches on both sides; what is found there is taken out and the hit is tried again.
    """
    h = windows(words, GRAM)
    first, last = np.searchsorted(t.hash, h, "left"), np.searchsorted(t.hash, h, "right")
    hits = sorted((int(t.template[k]), int(p), int(p - t.place[k])) for p in np.flatnonzero(last > first) for k in range(first[p], last[p]))
    found: list[tuple[int, int, int, int]] = []
    name, taken, failed = -1, [], set()
    for own, at, diagonal in hits:
        if own != name:
            name, taken, failed = own, [], set()  # ``taken``: (start, end) in order
        size = len(t.words[name])
        while diagonal not in failed:
            k = bisect_left(taken, at + 1, key=lambda x: x[0])
            if k and taken[k - 1][1] > at:
                break  # inside a match
            a = max(0, diagonal - BAND, taken[k - 1][1] if k else 0)
            b = min(len(words), diagonal + size + BAND, taken[k][0] if k < len(taken) else len(words))
            n, start, stop = align(t.words[name], words[a:b], diagonal - BAND - a, diagonal + BAND - a) if b - a >= coverage * size else (0, 0, 0)
            if not n or n < coverage * size:
                failed.add(diagonal)
                break
            failed.clear()
            taken.insert(k, (a + start, a + stop))
            found.append((name, n, a + start, a + stop))
    out: list[tuple[int, int, int, int]] = []  # by start
    for m in sorted(found, key=lambda x: (-x[1], len(t.words[x[0]]), x[3] - x[2], x[2], x[0])):
        at = bisect_left(out, m[2], key=lambda x: x[2])
        if (not at or out[at - 1][3] <= m[2]) and (at == len(out) or m[3] <= out[at][2]):
            out.insert(at, m)
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, template, its words, matched words, coverage, and the span in words and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = index(templates)
        for whole in batches if len(t.hash) else ():
            for batch in pieces(whole):
                x = Texts(batch.column("text"), lower=True)
                x.words(WORD)
                h = x.word_hash()
                grams = windows(h, GRAM)
                at = np.minimum(np.searchsorted(t.hash, grams), len(t.hash) - 1)
                rows, who = [], []
                for i in np.unique(x.w_text[np.flatnonzero(t.hash[at] == grams)]).tolist():
                    a, b = x.w_first[i], x.w_first[i + 1]
                    for k, n, s, e in matches(h[a:b], t, coverage):
                        size = len(t.words[k])
                        who.append(i)
                        rows.append((t.names[k], k, size, n, n / size, s, e, int(x.w_start[a + s] - x.starts[i]), int(x.w_end[a + e - 1] - x.starts[i])))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(who, pa.int64())), *columns], names=["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
