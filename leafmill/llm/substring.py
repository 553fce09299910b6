"""Substring dedup by fixed-block anchors: words covered by a run of ``window`` words found twice.

With blocks of b = (window + 1) // 2 words from the start of each document, any run of ``window``
words holds a whole block of its own document. So of two equal runs each holds a block of its own
that stands in the other at some place, not always at a block bound there. The non-overlapping blocks
are the index, every rolling window of b words probes it; a hit is a probe that equals a block at
another place. Equal runs have the same hits, so the hit of least hash in a run is an anchor that both
share. The words around each anchor are brought together with those around the same block elsewhere,
and extended in both directions, word by word, to maximal exact repeats (``repeats``). Probes are told
apart by 28 bits beside the bucket: what they find too much is sorted out by the extension.

Cases: null and empty texts have no words; a null doc_id is a document like others; repeated rows
are repeats of each other; texts of any length are judged whole; an empty table gives an empty
result; other columns are ignored, or carried by ``removed``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm import packed, repeats
from leafmill.llm.columns import U64, Texts, mixed, numbered, per_text, ragged, windows
from leafmill.llm.packed import Chunked, bounds, by_bucket, groups, keyed, questions, unpacked
from leafmill.llm.repeats import CROWDED, Contexts

WINDOW = 35
#: Entries of a bucket, about, of probes and of contexts.
PROBES, BUCKET_ENTRIES = 500_000, 100_000
#: Bytes of a probe: a block bit, three bits for how often a chunk has it (the least number of each code below), and a hash.
PROBE_BYTES, TIMES = 4, np.array([1, 2, 8, 32, 128, 512, 2048, 8192])


class Probes:
    """A chunk's words, its rolling hashes and its distinct probe keys."""

    def __init__(self, t: pa.Table, text: int, block: int, buckets: int):
        self.texts = t_ = Texts(t.column(f"c{text}"))
        t_.words()
        self.hash = t_.word_hash()
        self.valid = np.flatnonzero(t_.whole(block))
        self.roll = windows(self.hash, block)
        keys = keyed(self.roll[self.valid], buckets, 4, PROBE_BYTES)
        order, first, self.group = groups(keys)
        self.keys = keys[order[first]]
        place = self.valid - t_.w_first[:-1][t_.w_text[self.valid]] if len(self.valid) else self.valid
        count = np.diff(np.append(first, len(keys)))
        is_block = np.zeros(len(self.keys), bool)
        is_block[self.group[place % block == 0]] = True
        self.asked = self.keys | (np.searchsorted(TIMES, count, "right") - 1).astype(U64) << U64(1) | is_block.astype(U64)

    def hits(self, told: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each rolling window is a hit, and a crowded one."""
        cuts = bounds(self.keys, buckets)
        data = dict(zip(*by_bucket(told), strict=True))
        bits = [np.unpackbits(np.frombuffer(data[b], np.uint8), count=2 * (j - i)).reshape(2, -1) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        out = np.zeros((2, len(self.roll)), bool)
        if bits:
            out[:, self.valid] = np.concatenate(bits, 1).astype(bool)[:, self.group]
        return out[0], out[1]


def _hits(bucket: int, chunks: list[int], blobs: list[bytes], crowded: int) -> pa.Table:
    """A probe is a hit if its hash stands at two places or more and a block is among them; crowded if at more than ``crowded``."""
    sizes, (keys,) = unpacked(blobs, [PROBE_BYTES])
    order, first, group = groups(keys >> U64(4))
    own = keys[order]
    times = np.add.reduceat(TIMES[(own >> U64(1) & U64(7)).astype(np.int64)], first)
    hit = ((times > 1) & (np.bitwise_or.reduceat(own, first) & U64(1)).astype(bool))[group]
    hot = (times > crowded)[group]
    cuts = np.cumsum(sizes).tolist()
    return packed.answers(chunks, [bucket] * len(chunks), [np.packbits(np.concatenate([hit[b - k : b], hot[b - k : b]])).tobytes() for b, k in zip(cuts, sizes.tolist(), strict=True)])


def contexts(p: Probes, hit: np.ndarray, hot: np.ndarray, window: int, block: int) -> Contexts:
    """Runs of windows that share an anchor: of a window's hits the one of least hash, the leftmost of equals, and a crowded one only if all are."""
    whole, span = p.texts.whole(window), window - block + 1
    if not len(whole):
        none = np.zeros(0, np.int64)
        return Contexts(none, none, none, none.astype(U64), none.astype(bool), none.astype(U64))
    rank = np.where(hit, p.roll >> U64(2) | hot.astype(U64) << U64(62), U64(2**63))
    least, at, size = rank, np.arange(len(rank)), 1
    while size < span:
        step = min(size, span - size)
        left = least[:-step] <= least[step:]
        least, at, size = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:]), size + step
    least, at = least[: len(whole)], at[: len(whole)]
    ok = whole & (least < U64(2**63))
    change = np.append(True, at[1:] != at[:-1])
    lo = np.flatnonzero(ok & (change | ~np.append(False, ok[:-1])))
    hi = np.flatnonzero(ok & np.append(change[1:] | ~ok[1:], True))
    a = at[lo]
    n = hi - lo + window
    kind = mixed(mixed(p.roll[a]) ^ ((a - lo) << 16 | (hi - lo)).astype(U64))
    for k in range(int(n.max(initial=0))):
        kind = np.where(k < n, mixed(kind ^ p.hash[np.minimum(lo + k, len(p.hash) - 1)]), kind)
    return Contexts(lo, hi, a, mixed(p.roll[a]), hot[a], kind)


def covered(chunked: Chunked, window: int, out, schema: str, crowded: int = CROWDED) -> DataFrame:
    """out(table, texts, removed words) for each chunk of documents, in the order of ``packed.ordered``."""
    block, text = (window + 1) // 2, chunked.text
    most = window - block
    n1, n2 = chunked.buckets(chunked.bytes / 6, PROBES), chunked.buckets(chunked.bytes / 70, BUCKET_ENTRIES)

    def probe(chunk: int, t: pa.Table) -> pa.Table:
        return questions(chunk, Probes(t, text, block, n1).asked, n1, width=PROBE_BYTES)

    def extend(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        p = Probes(t, text, block, n1)
        x, c = p.texts, contexts(p, *p.hits(told, n1), window, block)

        def body(start: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
            word = ragged(start, size)
            n = x.w_end[word] - x.w_start[word] + 1  # with the white space after it, which becomes one space
            data = x.data[ragged(x.w_start[word], n)]
            stop = np.cumsum(n)
            data[stop - 1] = 32
            return data.tobytes(), np.append(0, stop)[np.cumsum(size)]

        return repeats.send(chunk, n2, x.word_numbers(), window, c, body)

    def units(raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        stop = np.flatnonzero(data == 32)
        return numbered(data, np.diff(stop, prepend=-1))

    def hits(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.Table:
        return _hits(bucket, chunks, blobs, crowded)

    def answer(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.Table:
        return repeats.compared(bucket, chunks, blobs, n2, window, most, units)

    def remove(_: int, t: pa.Table, told: pa.Table) -> pa.Table:
        texts = Texts(t.column(f"c{text}"))
        texts.words()
        return out(t, texts, repeats.repeated(told, n2, window, most, len(texts.w_text)))

    asked = packed.ask(chunked.rows, probe)
    runs = packed.tell(chunked.rows, packed.answer(asked, hits), extend, packed.QUESTION)
    return packed.tell(chunked.rows, packed.answer(runs, answer), remove, schema)


def digests(docs: DataFrame, window: int = WINDOW, crowded: int = CROWDED) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by one space."""
    chunked = Chunked(docs, ["doc_id", "text"])

    def out(t: pa.Table, x: Texts, gone: np.ndarray) -> pa.Table:
        data = x.data.copy()
        size = x.w_end - x.w_start
        word = np.zeros(len(x.data) + 1, np.int8)
        word[x.w_start[~gone]] = 1
        word[x.w_end[~gone]] = -1
        kept = np.cumsum(word[:-1], dtype=np.int8).astype(bool)
        # the white space after each kept word becomes its separator; the last one of a text is left off
        after = x.w_end[~gone]
        kept[after], data[after] = True, 32
        flat = data[kept]
        n = per_text(np.where(gone, 0, size + 1), x.w_first)
        stop = np.cumsum(n)
        shas = [hashlib.sha256(flat[b - k : max(b - 1, b - k)]).hexdigest() for b, k in zip(stop.tolist(), n.tolist(), strict=True)]
        return pa.table([t.column("c0"), pa.array(np.diff(x.w_first)), pa.array(per_text(gone, x.w_first)), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return covered(chunked, window, out, f"doc_id {chunked.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string", crowded)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated runs; documents that are left without a word, having had one, are dropped.

    Texts without a repeat stay as they are; n_chars, if there, follows the text.
    """
    chunked = Chunked(docs)
    names, text, schema = chunked.columns, chunked.text, chunked.schema

    def out(t: pa.Table, x: Texts, gone: np.ndarray) -> pa.Table:
        lost, n = per_text(gone, x.w_first), np.diff(x.w_first)
        columns = packed.column_arrays(t, len(names))
        texts = columns[text].to_pylist()
        for i in np.flatnonzero(lost).tolist():
            a, b = x.w_first[i], x.w_first[i + 1]
            edge = a + np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=0, append=0))
            cut = np.stack([x.w_start[edge[0::2]], x.w_end[edge[1::2] - 1]], 1).ravel().tolist()
            parts = zip([x.starts[i], *cut[1::2]], [*cut[0::2], x.ends[i]], strict=True)
            texts[i] = b"".join(x.data[p:q].tobytes() for p, q in parts).decode()
        columns[text] = pa.array(texts, pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([None if s is None else len(s) for s in texts], columns[k].type)
        return pa.table(columns, names=names).filter(pa.array((lost == 0) | (lost < n)))

    return covered(chunked, window, out, schema)
