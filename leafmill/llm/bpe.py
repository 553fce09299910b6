"""Byte-level BPE without regular expressions: boundaries by a parallel scan, merges by cached numpy rounds.

Pre-tokenisation: every code point has a class; with a look at its neighbours it becomes one of nine
symbols, each a transition function on eight states. Composition of functions is associative, so a
scan over the table of all compositions gives the state before every character, and from it the
boundaries of the pieces. Pieces are merged once per distinct piece; the ids of a batch are gathered
from that cache. The bytes of the ids are compared with the text, piece by piece, so a hash that two pieces
share changes no result. Each piece's byte offset is kept, and decoding returns the bytes of the ids.

Cases: a null text is an empty text with no tokens; a null doc_id is passed through; repeated rows
are encoded alike; other columns are ignored, or carried by ``with_ids``; texts of any length are
encoded whole; text that isn't valid UTF-8 is first decoded with replacement characters.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.columns import U64, pieces, ragged, slices

#: Character classes.
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points of White_Space, and marks of contractions after an apostrophe: fixed values of the pattern.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Symbols: letter, number, other, apostrophe of a contraction of one or of two letters, a blank before
#: a piece, any other white space before a piece, other white space, end of text.
L, N, O, Q1, Q2, P, X, W, E = range(9)
#: States: at a boundary, inside a letter, number, other or white run, after a blank that goes with
#: what follows, and inside a contraction with one or two letters to come.
AT, IN_L, IN_N, IN_O, IN_W, GLUE, C1, C2 = range(8)
#: Entries of a worker's cache of pieces; it starts anew beyond that.
CACHE = 600_000
#: Pieces of more bytes than this are merged with a heap.
LONG_PIECE = 192


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece starts with it."""
    if state == C2:
        return C1, False
    if state == C1:
        return AT, False
    if symbol in (L, N, O):
        run = (IN_L, IN_N, IN_O)[symbol]
        return run, state not in (run, GLUE)
    if symbol in (Q1, Q2):
        return (IN_O, False) if state in (IN_O, GLUE) else ((C1, C2)[symbol - Q1], True)
    if symbol == P:
        return GLUE, True
    if symbol == X:
        return IN_W, True
    if symbol == W:
        return IN_W, state != IN_W
    return AT, True


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, the table of compositions, each function's value at AT, and starts[state, symbol]."""
    functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(8)), *functions]))}
    grown = list(known)
    for f in grown:  # grows while it is read
        for g in functions:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                grown.append(h)
    n = len(grown)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in grown] for f in grown], np.int16)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    assert n < 2**15
    return np.array([known[f] for f in functions], np.int16), compose, np.array([f[AT] for f in grown], np.int8), starts


def scan(x: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Exclusive prefix compositions of the functions x: pairs are composed, scanned, and spread again."""
    if len(x) <= 1:
        return np.zeros(len(x), np.int16)  # 0: the identity
    flat, n = compose.ravel(), np.int32(len(compose))
    even, odd = x[0::2], x[1::2]
    above = scan(flat[even[: len(odd)].astype(np.int32) * n + odd], compose) if len(odd) else x[:0]
    out = np.empty(len(x), np.int16)
    out[1::2] = flat[above.astype(np.int32) * n + even[: len(odd)]]
    out[0 : 2 * len(odd) : 2] = above
    if len(x) % 2:
        out[-1] = flat[np.int32(out[-2]) * n + x[-2]]
    return out


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE)] = SPACE
    return out


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start among code points; ``ends`` are the places of the separators between texts, each a piece of its own."""
    functions, compose, at, starts = machine()
    kind = classes()[points]
    kind[ends] = 9
    symbol = kind.astype(np.int8)
    after = np.append(kind[1:], np.uint8(9))
    white = kind == SPACE
    symbol[white] = W
    last = white & (after < SPACE)
    symbol[last] = X
    symbol[last & (points == 0x20)] = P
    quote = np.flatnonzero((points == 0x27) & (kind == OTHER))
    one, two = points[np.minimum(quote + 1, len(points) - 1)], points[np.minimum(quote + 2, len(points) - 1)]
    symbol[quote[np.isin(one, [ord(c) for c in SHORT])]] = Q1
    for pair in LONG:
        symbol[quote[(one == ord(pair[0])) & (two == ord(pair[1]))]] = Q2
    symbol[ends] = E
    state = at[scan(functions[symbol], compose)]
    return np.flatnonzero(starts.ravel()[state * np.int16(9) + symbol])


class Ranks:
    """The vocabulary: ranks of byte strings, the rank of each mergeable pair, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        by_id = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            by_id[rank] = token
        self.sizes = np.fromiter(map(len, by_id), np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        # pieces seen so far: sorted hashes, and for each the place and number of its ids
        self.clear()

    def clear(self) -> None:
        self.seen, self.at, self.count, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, one piece after another, and their numbers: in each round every piece merges its lowest pair."""
        out: list[np.ndarray | None] = [None] * len(parts)
        rest = []
        for k, part in enumerate(parts):
            rank = self.rank.get(part)
            if rank is not None:
                out[k] = np.array([rank])
            elif len(part) > LONG_PIECE:
                out[k] = np.array(self.merge_long(part))
            else:
                rest.append(k)
        if rest:
            sizes = np.fromiter((len(parts[k]) for k in rest), np.int64)
            ids = self.byte[np.frombuffer(b"".join(parts[k] for k in rest), np.uint8)]
            owner = np.repeat(np.arange(len(rest)), sizes)
            while len(ids) > 1:
                key = ids[:-1] << 32 | ids[1:]
                i = np.searchsorted(self.pair_keys, key)
                i[i == len(self.pair_keys)] = 0
                ok = (self.pair_keys[i] == key) & (owner[1:] == owner[:-1])
                place = np.flatnonzero(ok)
                if not len(place):
                    for k, part in zip(rest_of(owner), np.split(ids, np.flatnonzero(np.diff(owner)) + 1), strict=True):
                        out[rest[k]] = part
                    break
                rank, own = self.pair_ranks[i[place]], owner[place]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                lowest = np.minimum.reduceat(rank, first)
                mine = np.repeat(lowest, np.diff(np.append(first, len(own)))) == rank
                own, place = own[mine], place[mine]
                left = np.diff(own, prepend=-1) != 0
                chosen = place[left]
                ids[chosen] = lowest
                keep = np.ones(len(ids), bool)
                keep[chosen + 1] = False
                active = np.zeros(len(rest), bool)
                active[own] = True
                done = ~active[owner]
                if done.any():  # pieces without a pair are finished
                    for k, part in zip(rest_of(owner[done]), np.split(ids[done], np.flatnonzero(np.diff(owner[done])) + 1), strict=True):
                        out[rest[k]] = part
                    keep &= ~done
                ids, owner = ids[keep], owner[keep]
            else:
                if len(ids):
                    out[rest[owner[0]]] = ids
        return (np.concatenate(out) if out else np.zeros(0, np.int64)).astype(np.int32), np.fromiter(map(len, out), np.int64, len(out))

    def merge_long(self, part: bytes) -> list[int]:
        """The same merges for one long piece: lowest rank first, the leftmost of equals, by a heap."""
        ids, n = self.byte[np.frombuffer(part, np.uint8)].tolist(), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := self.pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the number of them in each, and for each id its piece's byte offset and text."""
        joined = "\n".join([*texts, ""])
        data = np.frombuffer(joined.encode(), np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each code point
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        first = boundaries(points, ends)
        text = np.searchsorted(ends, first)
        stop = np.append(lead[first[1:]], len(data))
        start, whole = lead[first], ends[np.minimum(text, len(texts) - 1)] != first
        start, stop, text = start[whole], stop[whole], text[whole]
        h = slices(data, start, stop)
        kinds, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        i = np.searchsorted(self.seen, kinds)
        new = np.ones(len(kinds), bool)
        inner = i < len(self.seen)
        new[inner] = self.seen[i[inner]] != kinds[inner]
        if len(self.seen) + new.sum() > CACHE:
            self.clear()
            new[:] = True
        if new.any():
            raw, at = data.tobytes(), where[new]
            ids, count = self.merge([raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
            order = np.argsort(seen := np.concatenate([self.seen, kinds[new]]), kind="stable")
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])[order]
            self.count = np.concatenate([self.count, count])[order]
            self.seen, self.ids = seen[order], np.concatenate([self.ids, ids])
        found = np.searchsorted(self.seen, kinds)[inverse]
        n = self.count[found]
        out = self.ids[ragged(self.at[found], n)]
        if not self.spells(out, n, data, start, stop):
            # hashes of two pieces fell together: these texts are encoded by the bytes themselves, and the cache starts anew
            self.clear()
            out, n = self.by_bytes(data.tobytes(), start, stop)
        return out, np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)[: len(texts)], np.repeat(start, n), np.repeat(text, n)

    def spells(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bool:
        """Whether the ids of each piece decode to just its bytes."""
        raw, sizes = self.decode(ids)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(count))]
        return np.array_equal(np.diff(ends), stop - start) and np.array_equal(raw, data[ragged(start, stop - start)])

    def by_bytes(self, raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and their numbers, equal pieces found by their bytes."""
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
        ids, count = self.merge(list(number))
        at = np.cumsum(count) - count
        return ids[ragged(at[which], count[which])], count[which]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and each id's number of them."""
        sizes = self.sizes[ids]
        return self.bytes[ragged(self.offsets[ids], sizes)], sizes


def rest_of(owner: np.ndarray) -> list[int]:
    """The distinct values of a sorted array."""
    return owner[np.flatnonzero(np.diff(owner, prepend=-1))].tolist()


@cache
def ranks(path: str) -> Ranks:
    """The vocabulary of a rank file, once per Python worker."""
    return Ranks(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode(errors="replace") for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids (unsigned 32-bit, little-endian) and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks(path)
        for whole in batches:
            for batch in pieces(whole):
                ids, count, _, _ = words.encode(_texts(batch))
                data, _ = words.decode(ids)
                ids = ids.astype("<u4")
                stop = np.cumsum(count)
                ends = np.append(0, np.cumsum(words.sizes[ids]))[stop]
                sha = lambda a, cuts: [hashlib.sha256(a[i:j]).hexdigest() for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(sha(ids, stop)), pa.array(sha(data, ends))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (and, if asked for, the byte offset of each id's piece as ``offsets``); a column that has the name of one of these is replaced."""
    more = ["ids", *["offsets"] * offsets]
    names = [c for c in docs.columns if c not in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks(path)
        for whole in batches:
            for batch in pieces(whole):
                texts = _texts(batch)
                ids, count, piece, text = words.encode(texts)
                stop = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                out = [pa.ListArray.from_arrays(stop, pa.array(ids, pa.int32()))]
                if offsets:
                    sizes = np.fromiter((len(x.encode()) + 1 for x in texts), np.int64, len(texts))
                    out.append(pa.ListArray.from_arrays(stop, pa.array((piece - (np.cumsum(sizes) - sizes)[text]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*names, *more])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, kinds + "".join(f", {c} array<int>" for c in more))


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row's ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks(path)
        for batch in batches:
            texts = [words.decode(np.array(x or [], np.int64))[0].tobytes().decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
