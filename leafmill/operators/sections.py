"""Chapter passes: imprint pages, printed contents, tiny and giant chapters.

Chapters have doc, n, title, text (blocks joined by blank lines), tokens. The passes that depend on
the chapters before fold over one document's chapters in a grouped function; the others are plans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.batches import pieces
from leafmill.functions.text import canon_key, casefold, word_count

# Limits in tokens, ratios, and marks of imprint pages.
META_MOST, TOC_MOST, TINY, GIANT, PART = 150, 2000, 30, 8000, 6000
TOC_NUMERIC, TOC_REPEATED = 0.60, 0.80
META_MARKS = ("ISBN", "©", "Все права защищены", "All rights reserved", "Литагент")


def is_meta(text: Column, tokens: Column) -> Column:
    """Short and with a mark of an imprint page."""
    marks = F.lit(False)
    for m in META_MARKS:
        marks = marks | F.contains(casefold(text), casefold(F.lit(m)))
    return (tokens < META_MOST) & marks


def toc_flags(chapters: DataFrame) -> DataFrame:
    """Chapters with ``is_toc``: most lines end in a digit, or repeat the titles of other chapters."""
    titles = chapters.select("doc", canon_key(F.col("title")).alias("key")).distinct()
    lines = chapters.select("doc", "n", F.col("title").alias("own"), F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line")).withColumn("key", canon_key(F.col("line")))
    marked = lines.join(titles.withColumn("hit", F.lit(True)), ["doc", "key"], "left")
    own = F.exists(F.split("own", " · "), lambda s: canon_key(s) == F.col("key"))
    ratio = marked.groupBy("doc", "n").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(r"[0-9]\s*$")).alias("numeric"), F.count_if(F.col("hit").isNotNull() & ~own).alias("repeated"))
    toc = (F.col("tokens") <= TOC_MOST) & ((F.col("numeric") / F.col("lines") > TOC_NUMERIC) | (F.col("repeated") / F.col("lines") >= TOC_REPEATED))
    return chapters.join(ratio, ["doc", "n"], "left").withColumn("is_toc", F.coalesce(toc, F.lit(False))).drop("lines", "numeric", "repeated")


def _merge_tiny(rows: pd.DataFrame, tiny: int) -> pd.DataFrame:
    left = rows.sort_values("n").to_dict("records")
    done: list[dict] = []
    while left:
        c = left.pop(0)
        if c["tokens"] >= tiny or not (done or left):
            done.append(c)
            continue
        demoted = f"{c['title']}\n\n{c['text']}" if c["text"] else c["title"]
        size = c["tokens"] + len(c["title"].split())
        if left:  # goes before the next one's text, which may thereby stop being tiny
            left[0] = left[0] | {"text": f"{demoted}\n\n{left[0]['text']}", "tokens": left[0]["tokens"] + size}
        else:
            done[-1] = done[-1] | {"text": f"{done[-1]['text']}\n\n{demoted}", "tokens": done[-1]["tokens"] + size}
    return pd.DataFrame(done, columns=rows.columns)


def merged_tiny(chapters: DataFrame, tiny: int = TINY) -> DataFrame:
    """Tiny chapters become the beginning of the next one, the last one the end of the one before; only documents that have some go through Python."""
    doc = Window.partitionBy("doc")
    flagged = chapters.withColumn("has_tiny", (F.min("tokens").over(doc) < tiny) & (F.count("*").over(doc) > 1))
    rest = flagged.filter(~F.col("has_tiny")).drop("has_tiny")
    return rest.unionByName(flagged.filter("has_tiny").drop("has_tiny").groupBy("doc").applyInPandas(lambda rows: _merge_tiny(rows, tiny), chapters.schema))


def _pieces(text: str, most: int) -> list[str]:
    """Blocks, then sentences, then words, put into parts of at most ``most`` words where units allow."""
    units: list[tuple[str, str]] = []
    for block in text.split("\n\n"):
        if len(block.split()) <= most:
            units.append((block, "\n\n"))
            continue
        cut = re.split(r"(?<=[.!?])\s+", block)
        cut = block.split() if len(cut) == 1 else cut
        units += [(u, "\n\n" if k == 0 else " ") for k, u in enumerate(cut)]
    out: list[str] = []
    size = 0
    for unit, glue in units:
        n = len(unit.split())
        if out and size + n <= most:
            out[-1] += glue + unit
            size += n
        else:
            out.append(unit)
            size = n
    return out


def _headed(text: str) -> list[tuple[int, str, str]]:
    """(depth, heading, text below it) of a Markdown text, what is before the first heading at depth 0; code is not looked into."""
    out, fence = [[0, "", []]], ""
    for block in text.split("\n\n"):
        m = None if fence else re.fullmatch(r"(#{2,6}) (.*)", block)
        if m:
            out.append([len(m[1]) - 1, m[2], []])
            continue
        out[-1][2].append(block)
        for line in block.split("\n"):
            marks = re.match(r"`{3,}", line)
            fence = "" if fence and line.strip() == fence else fence or (marks[0] if marks else "")
    return [(d, h, "\n\n".join(t)) for d, h, t in out]


def _by_headings(title: str, text: str, most: int) -> list[tuple[str, str]]:
    """(title, text) of a chapter cut at its inner headings, no deeper than it takes for all to have ``most`` words."""
    units = _headed(text)
    found = [(title, text)]
    for depth in sorted({d for d, _, _ in units[1:]}):
        found = [(title, [])]
        for d, head, body in units:
            if 0 < d <= depth:
                found.append((f"{title} · {head}", []))
            elif d:
                found[-1][1].append(f"{'#' * (d - depth + 1)} {head}")
            if body:
                found[-1][1].append(body)
        found = [(t, "\n\n".join(b)) for t, b in found if b]
        if all(len(b.split()) <= most for _, b in found):
            break
    return found


def _cut(title: str, text: str, giant: int, part: int) -> list[dict]:
    """The parts of a giant chapter: by inner headings, and what is still too long by size, titled ``(i/k)``."""
    out = []
    for own, body in _by_headings(title, text, giant):
        pieces = _pieces(body, part) if len(body.split()) > giant else [body]
        out += [{"title": f"{own} ({i}/{len(pieces)})" if len(pieces) > 1 else own, "text": p, "part": i if len(pieces) > 1 else None} for i, p in enumerate(pieces, 1)]
    return out


def split_giants(chapters: DataFrame, giant: int = GIANT, part: int = PART, limit: Column | None = None) -> DataFrame:
    """Chapters above ``giant`` tokens (or ``limit``, if given) in parts; only those go through Python. ``i`` is a part's place in its chapter."""
    limit = F.lit(giant) if limit is None else limit
    large = F.col("tokens") > limit

    rest = [c for c in chapters.columns if c not in ("title", "text", "tokens")]
    types = {f.name: f.dataType.simpleString() for f in chapters.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            cuts = [_cut(title.as_py(), text.as_py(), most.as_py(), part) for title, text, most in zip(b.column("title"), b.column("text"), b.column("_most"), strict=True)]
            at = pa.array([k for k, own in enumerate(cuts) for _ in own], pa.int64())
            own = [pa.array([p[c] for x in cuts for p in x], t) for c, t in (("title", pa.string()), ("text", pa.string()), ("part", pa.int32()))]
            del cuts
            place = pa.array([i for _, group in groupby(at.to_pylist()) for i, _ in enumerate(group)], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in rest], *own, place], [*rest, "title", "text", "part", "i"])

    whole = chapters.filter(~large).withColumn("part", F.lit(None).cast("int")).withColumn("i", F.lit(0))
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in rest], "title string, text string, part int, i int"])
    parts = chapters.filter(large).select(*rest, "title", "text", limit.cast("int").alias("_most")).mapInArrow(cut, schema)
    return whole.unionByName(parts.withColumn("tokens", word_count(F.col("text"))))


def not_empty(chapters: DataFrame) -> DataFrame:
    return chapters.filter("text IS NOT NULL AND text <> ''")
