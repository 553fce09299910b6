"""Bytes to text: byte order marks, declarations, UTF-8, then the single-byte encoding whose Cyrillic is most plausible."""

from __future__ import annotations

import re

#: Encodings tried beside UTF-8, in order of preference: fixed values.
CANDIDATES = ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "latin-1")
VOWELS, CONSONANTS = frozenset("аеёиоуыэюя"), frozenset("бвгджзйклмнпрстфхцчшщъь")


def vowel_score(text: str) -> float:
    """How near the share of vowels among Cyrillic letters is to 0.40; lower-case text in the middle of words counts for itself."""
    low = text.lower()
    v, c = sum(ch in VOWELS for ch in low), sum(ch in CONSONANTS for ch in low)
    return 1 - abs(v / (v + c) - 0.40) if v + c else -1.0


def _plausible(text: str) -> float:
    """Vowel score less what speaks against the encoding: capitals inside words and symbols among letters."""
    words = re.findall(r"[^\W\d_]{2,}", text)
    odd = sum(not (w.islower() or w.isupper() or w.istitle()) for w in words)
    strange = sum(ch in "¤¦§©®±µ¶·«»№╔╗╚╝║═─│┌┐└┘├┤░▒▓█ЂЃ‚ѓ„…†‡€‰" for ch in text)
    return vowel_score(text) - odd / max(1, len(words)) - strange / max(1, len(text))


def decoded(raw: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    tried = [(name, raw.decode(name, "replace")) for name in CANDIDATES]
    cyrillic = [(n, t) for n, t in tried if len(re.findall("[а-яё]", t, re.I)) * 2 >= len(re.findall(r"[^\W\d_]", t))]
    return max(cyrillic, key=lambda x: _plausible(x[1]))[1] if cyrillic else raw.decode("latin-1")


def decoded_markup(raw: bytes) -> str:
    """Markup: a mark, then a declared encoding, then UTF-8, then a guess."""
    m = re.search(rb"(?:encoding|charset)\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", raw[:2048])
    if m and not raw.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        try:
            return raw.decode(m[1].decode())
        except (LookupError, UnicodeDecodeError):
            pass
    return decoded(raw)


def texty(text: str) -> bool:
    """Under one percent of control characters."""
    bad = sum(ord(c) < 32 and c not in "\t\n\r\f" or 127 <= ord(c) < 160 for c in text)
    return bad * 100 < max(1, len(text))
