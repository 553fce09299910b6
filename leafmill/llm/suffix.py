"""Suffix-array dedup: bytes covered by a string of ``length`` bytes found twice are removed.

Each window of ``length`` bytes is known by its minimizer, the k-gram of least hash in it, so equal
windows share an anchor. An anchor found once has no repeated window. The contexts of all others meet
by anchor (``repeats``): the suffixes that start at the anchors, and the reversed prefixes that end
there, are sorted by a mergesort that compares prefix polynomial hashes by binary search; common
extensions are verified byte by byte, and decide about every window.

Cases: null and empty texts have no bytes; a null doc_id is a document like others; repeated rows are
repeats of each other; matches never cross documents; texts of any length are judged whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm import packed, repeats
from leafmill.llm.columns import U64, Texts, grams, mixed, per_text, ragged, slices
from leafmill.llm.packed import Chunked, bounds, by_bucket, groups, keyed, unpacked
from leafmill.llm.repeats import CROWDED, Contexts

LENGTH = 200
#: Bytes of an anchor, at most half of the length.
GRAM = 64
BUCKET_ENTRIES = 100_000
#: States of an anchor: found once, or its contexts are compared, or its windows are counted.
ALONE, MIXED, HOT = range(3)


def contexts(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each context as byte offsets, and the anchor's hash."""
    data, w = texts.data, length - gram + 1
    n = len(data) - gram + 1
    if n < w:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    h = grams(data, gram)
    rows = -(-n // w)
    # the low bits hold the place in a block of w hashes, whatever the length of the data: the leftmost of equals
    bits = U64(max(1, (w - 1).bit_length()))
    place = (U64(1) << bits) - U64(1)
    key = np.full((rows + 1) * w, np.iinfo(U64).max, U64)
    key[:n] = h & ~place | np.arange(n, dtype=U64) % U64(w)
    block = key.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    one, two = back[:m], ahead[w - 1 : w - 1 + m]  # of the window's first block, and of its last
    first = one >> bits <= two >> bits
    start = np.arange(m) + np.where(first, 0, w - 1)
    least = start - start % w + (np.where(first, one, two) & place).astype(np.int64)
    inside = np.zeros(m + 1, np.int8)
    room = texts.ends - texts.starts >= length
    inside[texts.starts[room]] = 1
    stop = texts.ends[room] - length + 1
    np.add.at(inside, stop, -1)
    ok = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    end = ok.copy()
    end[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(end)
    a = least[lo]
    return lo, hi, a, mixed(h[a])  # mixed anew: the least hashes crowd the low end


class Anchors:
    """A chunk's contexts by anchor: one entry for each distinct anchor."""

    def __init__(self, t: pa.Table, text: int, length: int, gram: int, buckets: int):
        self.texts = Texts(t.column(f"c{text}"))
        self.lo, self.hi, self.at, self.hash = contexts(self.texts, length, gram)
        order, first, self.group = groups(keyed(self.hash, buckets))
        self.keys = keyed(self.hash[order[first]], buckets)
        self.n = np.minimum(np.diff(np.append(first, len(order))), 65535).astype(U64)

    def states(self, told: pa.Table, buckets: int) -> np.ndarray:
        cuts = bounds(self.keys, buckets)
        data = dict(zip(*by_bucket(told), strict=True))
        parts = [np.frombuffer(data[b], np.uint8) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint8))[self.group]


def _states(bucket: int, chunks: list[int], blobs: list[bytes], crowded: int) -> pa.Table:
    sizes, (keys, n) = unpacked(blobs, [6, 2])
    order, first, group = groups(keys)
    total = np.add.reduceat(n[order].astype(np.int64), first)
    state = np.where(total < 2, ALONE, np.where(total > crowded, HOT, MIXED)).astype(np.uint8)[group]
    cuts = np.cumsum(sizes)
    return packed.answers(chunks, [bucket] * len(chunks), [state[b - k : b].tobytes() for b, k in zip(cuts.tolist(), sizes.tolist(), strict=True)])


def removed_bytes(chunked: Chunked, length: int, gram: int, crowded: int, out, schema: str) -> DataFrame:
    """out(table, texts, removed bytes) for each chunk of documents."""
    text, most = chunked.text, length - gram
    # three kinds of buckets: anchors, contexts (from n on), windows of crowded anchors (from 2n on)
    n = chunked.buckets(chunked.bytes / 70, BUCKET_ENTRIES)

    def anchors(chunk: int, t: pa.Table) -> pa.Table:
        a = Anchors(t, text, length, gram, n)
        return packed.questions(chunk, a.keys, n, [(a.n, 2)])

    def compare(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        a = Anchors(t, text, length, gram, n)
        state = a.states(told, n)
        at = np.flatnonzero(state != ALONE)
        lo, hi, where, data = a.lo[at], a.hi[at], a.at[at], a.texts.data
        place = ((where - lo) << 16 | (hi - lo)).astype(U64)
        c = Contexts(lo, hi, where, a.hash[at], state[at] == HOT, mixed(slices_of(data, lo, hi + length) ^ mixed(place)))
        return repeats.send(chunk, n, data, length, c, lambda start, size: (data[ragged(start, size)].tobytes(), np.cumsum(size)))

    def answer(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.Table:
        return repeats.compared(bucket, chunks, blobs, n, length, most, lambda raw: np.frombuffer(raw, np.uint8))

    def remove(_: int, t: pa.Table, told: pa.Table) -> pa.Table:
        texts = Texts(t.column(f"c{text}"))
        return out(t, texts, repeats.repeated(told, n, length, most, len(texts.data)))

    def states(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.Table:
        return _states(bucket, chunks, blobs, crowded)

    asked = packed.ask(chunked.rows, anchors)
    second = packed.tell(chunked.rows, packed.answer(asked, states), compare, packed.QUESTION)
    return packed.tell(chunked.rows, packed.answer(second, answer), remove, schema)


def slices_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte strings of some hundred bytes, 64 at a time."""
    size = ends - starts
    h = size.astype(U64)
    for k in range(0, int(size.max(initial=0)), 64):
        a = np.minimum(starts + k, ends)
        h = mixed(h ^ slices(data, a, np.minimum(a + 64, ends)))
    return h


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and the SHA-256 of the bytes that are kept."""
    chunked = Chunked(docs, ["doc_id", "text"])

    def out(t: pa.Table, x: Texts, gone: np.ndarray) -> pa.Table:
        gone = gone.copy()
        gone[x.ends] = False
        spans = gone & ~np.append(False, gone[:-1])
        cuts = np.append(x.starts, len(x.data))
        removed = per_text(gone, cuts)
        kept = x.data[~gone]
        stop = np.cumsum(x.ends - x.starts + 1 - removed)
        shas = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(np.append(0, stop[:-1]).tolist(), (stop - 1).tolist(), strict=True)]
        return pa.table([t.column("c0"), pa.array(x.ends - x.starts), pa.array(removed), pa.array(per_text(spans, cuts)), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_bytes(chunked, length, gram, crowded, out, f"doc_id {chunked.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
