"""Extraction of many files in one Arrow pass: a row per source, never an exception.

``files`` are rows of the binaryFile source (path, content, length) or like them. A file over the size
limit isn't read; a reader that takes longer than the limit ends with an error of its own row.
"""

from __future__ import annotations

import signal
import threading
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.batches import pieces
from leafmill.sources.detect import MOST_BYTES, Unknown, detect
from leafmill.sources.readers import READERS

SECONDS = 120
SCHEMA = (
    "path string, sha256 string, fmt string, status string, error string, title string, author string, lang string, ref_text string, "
    "unknown_tags map<string,int>, blocks array<struct<pos:int,kind:string,level:int,text:string>>"
)


@contextmanager
def limited(seconds: int) -> Iterator[None]:
    """Ends the block by an exception after so long, where signals are to be had."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TimeoutError(f"extraction took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def _one(path: str, content: bytes | None, sha: str) -> dict:
    row = dict.fromkeys(("fmt", "error", "title", "author", "lang", "ref_text", "unknown_tags"), None) | {"path": path, "sha256": sha, "status": "failed", "blocks": []}
    try:
        if content is None:
            raise ValueError("source over the size limit")
        row["fmt"] = detect(path, content)
        if row["fmt"] not in READERS:
            raise ValueError(f"no reader for {row['fmt']}; give its text layer as spans")
        with limited(SECONDS):
            raw = READERS[row["fmt"]](content)
        row |= {"status": "read", "title": raw.title, "author": raw.author, "lang": raw.lang, "ref_text": raw.ref_text, "unknown_tags": raw.unknown_tags}
        composed = lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x)
        row |= {"title": composed(raw.title), "author": composed(raw.author)}
        row["blocks"] = [{"pos": k, "kind": b.kind, "level": b.level, "text": composed(b.text)} for k, b in enumerate(raw.blocks)]
    except Unknown as e:
        row |= {"status": "skipped", "error": f"Unknown: {e}"}
    except Exception as e:  # one bad file never ends a batch
        row |= {"error": f"{type(e).__name__}: {e}"}
    return row


FIELDS = [(n, pa.string()) for n in ("path", "sha256", "fmt", "status", "error", "title", "author", "lang", "ref_text")]
FIELDS += [("unknown_tags", pa.map_(pa.string(), pa.int32())), ("blocks", pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())])))]


def _all(batches: Iterator[pa.RecordBatch], content: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*FIELDS, *[("content", pa.binary())] * content])
    for piece in pieces(batches, "content"):
        rows = []
        for path, raw, sha in zip(*(piece.column(c) for c in ("path", "content", "sha256")), strict=True):  # one source at a time
            row = _one(path.as_py(), raw.as_py(), sha.as_py())
            rows.append(row | {"unknown_tags": None if row["unknown_tags"] is None else list(row["unknown_tags"].items())})
        columns = [pa.array([r[n] for r in rows], t) for n, t in FIELDS]
        del rows
        yield pa.RecordBatch.from_arrays([*columns, *[piece.column("content")] * content], schema=schema)


def extract(files: DataFrame, content: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """One row per file, with its bytes if asked for; files of more than ``most`` bytes aren't read. Blocks, titles and authors are in composed form (NFC)."""
    small = F.when(F.octet_length("content") <= most, F.col("content"))
    rows = files.select("path", small.alias("content"), F.sha2("content", 256).alias("sha256"))
    return rows.mapInArrow(lambda batches: _all(batches, content), SCHEMA + ", content binary" * content)


def files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths))


def blocks(extracted: DataFrame) -> DataFrame:
    """doc, pos, kind, level, text of what was read."""
    return extracted.filter("status = 'read'").select(F.col("sha256").alias("doc"), F.explode("blocks").alias("b")).select("doc", "b.*")
