"""Corpus-wide questions about hashes, asked in packed form.

Documents are dealt into chunks by a hash of the row. A chunk asks about its distinct hashes: sorted,
cut by hash range into buckets, one binary row for each bucket it has hashes in. A bucket sees all
chunks' questions about its hashes and answers each row in the order of its hashes; answers go back
to the chunk. Whatever is repeated inside a chunk is sent once, so that a hash that a third of the
corpus shares costs its bucket one entry a chunk. Chunks and buckets are of bounded size and their
number follows the input.

A key holds its bucket in the top 16 bits, so that sorted keys stand by bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField

from leafmill.llm.columns import U64
from leafmill.session import stored

#: Bytes and rows of a chunk, about.
CHUNK_BYTES, CHUNK_ROWS = 2_000_000, 50_000
MOST_BUCKETS = 1 << 16
LOW = U64((1 << 48) - 1)
#: Bucket of what a chunk sent for itself.
OWN = -1
QUESTION = "bucket int, chunk int, data binary"
ANSWER = "chunk int, bucket int, data binary"


class Chunked:
    """``docs`` dealt into chunks: ``rows`` has the columns as c0, c1, ..., then rh (a hash of the row) and chunk.

    The number of chunks follows the bytes of all columns and the number of rows. A row's chunk follows from
    its doc_id and text, so that any reading of the table gives the same. Only where the rows of one doc_id and
    text are more than a chunk holds, the table is first written with a number for each row, which deals them out.
    """

    def __init__(self, docs: DataFrame, columns: list[str] | None = None, chunk_bytes: int | None = None, chunk_rows: int | None = None):
        chunk_bytes, chunk_rows = chunk_bytes or CHUNK_BYTES, chunk_rows or CHUNK_ROWS
        self.columns = columns or docs.columns
        self.schema = docs.select(*[F.col(f"`{c}`") for c in self.columns]).schema
        spark = docs.sparkSession
        rh = F.xxhash64("doc_id", "text")
        row = sum((_bytes_of(f) for f in self.schema.fields), F.lit(0).cast("bigint"))
        alike = docs.groupBy(rh.alias("rh")).agg(F.count("*").alias("n"), F.sum(row).alias("b"), F.sum(F.octet_length("text")).alias("t"))
        size, rows, text, most, largest = alike.agg(F.sum("b"), F.sum("n"), F.sum("t"), F.max("n"), F.max(F.when(F.col("n") > 1, F.col("b")))).first()
        self.bytes = text or 0
        self.n = max(-(-(size or 0) // chunk_bytes), -(-(rows or 0) // chunk_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
        own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(self.columns)], rh.alias("rh"))
        place = F.col("rh")
        if (most or 0) > chunk_rows or (largest or 0) > chunk_bytes:
            own = stored(own.withColumn("number", F.monotonically_increasing_id()), "dealt")
            place = F.xxhash64("rh", "number")
        self.rows = own.select(*[f"c{k}" for k in range(len(self.columns))], "rh", F.pmod(place, F.lit(self.n)).cast("int").alias("chunk"))
        self.text, self.id = self.columns.index("text"), self.columns.index("doc_id")

    def buckets(self, entries: float, each: int) -> int:
        """Number of buckets for so many entries; at least as many as make all cores busy."""
        return int(min(MOST_BUCKETS, max(entries // each + 1, self.n // 8 + 1)))


def _bytes_of(field: StructField) -> Column:
    """Bytes of a column's value, about."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    return F.coalesce(F.size(c), F.lit(0)) * 16 + 8 if isinstance(kind, (ArrayType, MapType)) else F.lit(8)


def ordered(t: pa.Table) -> pa.Table:
    """A chunk's rows in an order that any reading of it gives: by their hash."""
    return t.take(pa.array(np.argsort(t.column("rh").to_numpy(), kind="stable")))


def keyed(h: np.ndarray, buckets: int, flag_bits: int = 0, width: int = 6) -> np.ndarray:
    """Keys of hashes, ``width`` bytes beside the bucket, with room for flags in the lowest bits."""
    bucket = (h >> U64(48)) * U64(buckets) >> U64(16)
    return bucket << U64(48) | (h << U64(flag_bits) & U64((1 << 8 * width) - 1))


def low_bytes(a: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(a, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(buckets, dtype=U64) << U64(48)).tolist() + [len(keys)]


def questions(chunk: int, keys: np.ndarray, buckets: int, planes: list[tuple[np.ndarray, int]] = (), own: bytes | None = None, width: int = 6) -> pa.Table:
    """Rows for the buckets that sorted ``keys`` fall in; ``planes``: further arrays and their widths in bytes; ``own``: data that come back to the chunk as they are."""
    flat = [(low_bytes(keys, width), width), *[(low_bytes(a, w), w) for a, w in planes]]
    cuts = bounds(keys, buckets)
    rows = [(b, b"".join(a[i:j].tobytes() for a, _ in flat)) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return question_rows(chunk, rows, own, chunk % buckets)


def question_rows(chunk: int, rows: list[tuple[int, bytes]], own: bytes | None, via: int) -> pa.Table:
    """(bucket, data) rows of a chunk, and its own data by way of bucket ``via``, known by a negative chunk."""
    buckets, chunks, data = [b for b, _ in rows], [chunk] * len(rows), [d for _, d in rows]
    if own is not None:
        buckets, chunks, data = [*buckets, via], [*chunks, -1 - chunk], [*data, own]
    return pa.table([pa.array(buckets, pa.int32()), pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"])


def answers(chunks: list[int], buckets: list[int], data: list[bytes]) -> pa.Table:
    return pa.table([pa.array(chunks, pa.int32()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"])


def unpacked(blobs: list[bytes], widths: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entries in each blob, and the planes of all blobs one after another."""
    total = sum(widths)
    sizes = np.fromiter((len(b) // total for b in blobs), np.int64, len(blobs))
    out, at = [], 0
    for w in widths:
        plane = np.zeros((int(sizes.sum()), 8), np.uint8)
        raw = b"".join(b[at * n : (at + w) * n] for b, n in zip(blobs, sizes.tolist(), strict=True))
        plane[:, :w] = np.frombuffer(raw, np.uint8).reshape(-1, w)
        out.append(plane.view("<u8").ravel())
        at += w
    return sizes, out


def groups(keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, group): sorting order of the keys, where groups of equals start in it, and each key's group."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def bits(sizes: np.ndarray, flags: np.ndarray) -> list[bytes]:
    """Packed bits of the entries of each row."""
    cuts = np.cumsum(sizes)
    return [np.packbits(flags[b - n : b]).tobytes() for b, n in zip(cuts.tolist(), sizes.tolist(), strict=True)]


def by_bucket(t: pa.Table) -> tuple[list[int], list[bytes]]:
    """Buckets and data of a chunk's answers, in the order of the buckets."""
    pairs = sorted(zip(t.column("bucket").to_pylist(), t.column("data").to_pylist(), strict=True), key=lambda x: x[0])
    return [b for b, _ in pairs], [d for _, d in pairs]


def answered(t: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answer bits of the chunk's sorted keys."""
    cuts = bounds(keys, buckets)
    data = dict(zip(*by_bucket(t), strict=True))
    parts = []
    for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if j > i:
            parts.append(np.unpackbits(np.frombuffer(data[b], np.uint8), count=j - i).astype(bool))
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def column_arrays(t: pa.Table, n: int) -> list[pa.ChunkedArray]:
    return [t.column(f"c{k}") for k in range(n)]


def ask(rows: DataFrame, f) -> DataFrame:
    """Questions of each chunk; f(chunk, table)."""
    return rows.groupBy("chunk").applyInArrow(lambda key, t: f(key[0].as_py(), ordered(t)), QUESTION)


def answer(asked: DataFrame, f) -> DataFrame:
    """Answers of each bucket; f(bucket, chunks, blobs) gives a table. What chunks sent for themselves goes back under bucket ``OWN``."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_numpy()
        own, asked = t.filter(pa.array(chunk < 0)), t.filter(pa.array(chunk >= 0))
        back = answers((-1 - chunk[chunk < 0]).tolist(), [OWN] * own.num_rows, own.column("data").to_pylist())
        if not asked.num_rows:
            return back
        return pa.concat_tables([f(key[0].as_py(), asked.column("chunk").to_pylist(), asked.column("data").to_pylist()), back])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def tell(rows: DataFrame, told: DataFrame, f, schema: str) -> DataFrame:
    """Each chunk's rows with its answers; f(chunk, table, answers)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return f(key[0].as_py(), ordered(left), right)

    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)
