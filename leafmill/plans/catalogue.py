"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from leafmill.plans import inputs, library, pages, reads, searches, structures, texts

PARTS = (reads, texts, library, structures, searches, pages, inputs)
QUERIES = {k: q for p in PARTS for k, q in p.QUERIES.items()}
ORACLES = {k: q for p in PARTS for k, q in p.ORACLES.items()}

#: Operators that are another's under a second name.
for second, first in {
    "n02_whitespace": "f04_whitespace", "n01_unicode": "f03_unicode_clean", "g14_language_share": "f16_lang", "v03_windows": "w14_windows", "e05_identity": "j10_identity", "o08_encodings": "src08_decode", "c05_info": "a05_info",
}.items():
    QUERIES[second] = QUERIES[first]
    if first in ORACLES:
        ORACLES[second] = ORACLES[first]
