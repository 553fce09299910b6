"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive is a skippable frame that holds the dictionary, then one Zstandard frame a record, the
first of them a warcinfo record. Archives travel as rows (archive, n_records, content), so any store that
Spark writes will do; ``export`` lets the workers write them as .warc.zst files.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a
response, the others are revisits of it.

Cases: page_id is a number or a string; null html is an empty payload, null url an empty target; a row with a null page_id is always
a response and is never referred to; repeated rows with the largest page_id are all responses; an
empty table gives no archives; other columns are ignored. Payloads of any length are kept whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import stored

#: Frame type of the dictionary, and the WARC profile of revisits: fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Raw bytes of the records in one archive, bytes of its dictionary, and the compression level.
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 8_000_000, 64 << 10, 3
SALTS = 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(kind: str, name: str, fields: list[str], block: bytes) -> bytes:
    """A record; ``name``: archive and place, so that no two records have one id."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(name: str, page_id: str | None, url: str, payload: bytes, refers_to: str | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, with the payload's length, but not the payload."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    plain = lambda x: "".join(x.split())
    lines = [f"WARC-Target-URI: {plain(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {quote(page_id)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {plain(refers_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {quote(refers_to)}"]
    lines.append("Content-Type: application/http; msgtype=response")
    return _head("response" if refers_to is None else "revisit", f"{name} {page_id} {url} {sha}", lines, http if refers_to is not None else http + payload)


def info(name: str) -> bytes:
    """The record that opens an archive."""
    return _head("warcinfo", name, [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: leafmill\r\nformat: WARC File Format 1.1\r\n")


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of all the records of an archive; of a few small ones, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(words.as_bytes())
    to = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(to.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends: its blocks are skipped by their sizes."""
    checksum = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * checksum


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    data, at = memoryview(content), 8 + n
    raw = zstandard.ZstdDecompressor().decompress(content[8:at])
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    while at < len(data):
        end = frame_end(data, at)
        yield back.decompress(data[at:end])
        at = end


def parsed(raw: bytes) -> dict:
    """Headers and payload of a record; the digest of a response is checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (digest(payload) != sha or len(payload) != size):
        raise ValueError(f"record {h['WARC-Record-ID']} does not hold the payload it names")
    own = lambda k: unquote(h[k]) if k in h else None
    return {"page_id": own("X-Page-ID"), "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": sha, "record_type": h["WARC-Type"], "refers_to": own("X-Refers-To-Page-ID"), "payload": payload}


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, and refers_to and refers_url: the page that a revisit refers to, else null."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    ids = p.filter(F.col("page_id").isNotNull() & (F.col("size") >= least)).groupBy("sha", "page_id").agg(F.max("url").alias("url"))
    last = ids.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("to"), F.count("*").alias("n")).filter("n > 1").select("sha", F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # a payload that a third of the pages share is dealt out over the salts; only revisits come out
    own = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = own.drop("url").join(last, ["sha", "salt"]).filter(F.col("page_id") < F.col("refers_to")).select("page_id", "sha", "refers_to", "refers_url")
    return p.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to", "refers_url")


def archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """The archives of all pages: archive, n_records, content."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        name = lambda: f"part-{part:05d}-{k:05d}.warc.zst"

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name()], "n_records": [len(held)], "content": [archive([info(name()), *held])]})

        for batch in batches:
            for page_id, url, html, to, to_url in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                held.append(record(f"{name()} {len(held)}", page_id.as_py(), url.as_py(), html.as_py().encode(), to.as_py(), to_url.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    k, held, size = k + 1, [], 0
        if held:
            yield out()

    text = lambda c: F.col(c).cast("string").alias(c)
    return with_roles(pages, least).select(text("page_id"), "url", "html", text("refers_to"), "refers_url").mapInArrow(write, "archive string, n_records bigint, content binary")


def read(archived: DataFrame, payloads: bool = False, id_type: str = "bigint") -> DataFrame:
    """One row per archived page record, with its payload if asked for; ``id_type``: the type of the page ids."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    kinds = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), *[("payload", pa.binary())] * payloads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = ([x[n] for n in names] for x in map(parsed, islice(records(content.as_py()), 1, None)))  # after the archive's own record
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)), kinds, strict=True)], schema=kinds)

    back = archived.mapInArrow(run, schema)
    return back.select(*[F.col(c).cast(id_type).alias(c) if c in ("page_id", "refers_to") else c for c in names])


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives of all pages to the shared folder and reads them back: one row per page."""
    return read(stored(archives(pages, least), "warc"), id_type=pages.schema["page_id"].dataType.simpleString())


def export(archived: DataFrame, folder: str) -> DataFrame:
    """Writes the archives to ``folder``, a path or URI that all workers can write to; archive and bytes of each. A task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pc.binary_length(batch.column("content")).cast(pa.int64())], names=["archive", "bytes"])

    return stored(archived.select("archive", "content").mapInArrow(write, "archive string, bytes bigint"), "exported")
