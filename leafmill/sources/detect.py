"""Format of a source by content: PDF mark, zip contents, first tag, then suffix and texture."""

from __future__ import annotations

import re

from leafmill.sources.archive import Broken, opened
from leafmill.sources.decode import decoded_markup, texty

FORMATS = ("fb2", "epub", "docx", "html", "txt", "md", "pdf")
#: Largest source that is read.
MOST_BYTES = 256 << 20


class Unknown(ValueError):
    """Not a format that can be read."""


def first_tag(head: bytes) -> str:
    """Name of the first element, after white space, instructions, declarations and comments."""
    text = re.sub(r"^(?:\s+|<\?.*?\?>|<!--.*?-->)+", "", decoded_markup(head), flags=re.S)
    m = re.match(r"<(!doctype\s+)?([A-Za-z][\w:.-]*)", text, re.I)
    return m[2].lower() if m else ""


def detect(name: str, raw: bytes) -> str:
    if b"%PDF" in raw[:1024]:
        return "pdf"
    if raw.startswith(b"PK"):
        names = opened(raw).namelist()
        if "mimetype" in names:
            return "epub"
        if "word/document.xml" in names:
            return "docx"
        books = [n for n in names if n.lower().endswith(".fb2")]
        if len(books) == 1:
            return "fb2"
        raise Broken("several books in one container") if books else Unknown("unknown zip container")
    tag = first_tag(raw[:4096])
    if tag.rpartition(":")[2] == "fictionbook":
        return "fb2"
    if tag in ("html", "head", "body"):
        return "html"
    suffix = name.rpartition(".")[2].lower()
    if suffix in ("htm", "html") and tag:
        return "html"
    if texty(decoded_markup(raw[:65536])) and raw:
        return "md" if suffix in ("md", "markdown") else "txt"
    raise Unknown(f"unknown format: {name}")
