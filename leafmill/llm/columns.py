"""Text columns as flat numpy arrays: word bounds, hashes of slices and of runs, ragged gathers.

A batch of texts is one byte buffer with a line feed after each text, so that nothing crosses
texts. Three hashes, by use:

* ``slices``: of byte strings. Eight bytes at a time are mixed in by a bijection that is not linear
  in any ring, so that patterns of the text (Thue-Morse words and the like) don't cancel; strings
  over ``LONG`` bytes are hashed by BLAKE2b. Two seeds make two independent hashes.
* ``windows``: of all runs of k numbers, put together from runs of 1, 2, 4, ... by the same mixing.
* ``grams``: of all runs of k bytes, by rolling polynomials modulo 2**64. They only choose anchors;
  no verdict follows from them.

Prefix polynomials for comparisons are modulo the prime 2**61 - 1 (``Prefixes``): two strings of n
bytes that differ agree with a chance of at most n / 2**61.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at a time; arrays of eight bytes each are made of them.
PIECE_BYTES = 2_000_000
#: Byte strings longer than this are hashed one by one.
LONG = 64
PRIME = U64(2**61 - 1)
_SEEDS = (U64(0x8C62F8A3D0B7E915), U64(0x3D9A41C7E5F0286B))
_ODD = U64(0xA24BAED4963EE407)
_BASE = 0x9E3779B97F4A7C15 * 8 + 5
#: Bases of the prefix polynomials modulo the prime, drawn at random once.
_BASES = (1_487_243_918_223_907_411, 2_018_734_455_019_663_237)
_BYTE = np.random.default_rng(20240).integers(0, 2**64, 256, dtype=U64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_powers: dict[object, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U64(29))) * U64(0x9E3779B97F4A7C15)
        return h ^ (h >> U64(32))


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the byte strings data[start:end]."""
    size = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mixed(size.astype(U64) ^ _SEEDS[which])
    live = np.flatnonzero(size <= LONG)
    at, left, own = starts[live], size[live], h[live]
    while len(live):
        own = mixed(own ^ (lanes[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        if not more.all():
            h[live[~more]] = own[~more]
            live, at, left, own = live[more], at[more], left[more], own[more]
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        h[i] = U64(int.from_bytes(digest[8 * which : 8 * which + 8], "little"))
    return h


def windows(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of k values, in order."""
    if len(values) < k:
        return np.zeros(0, U64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(a ^ (b * _ODD + _SEEDS[which]))

    run, size, out, done = mixed(values ^ _SEEDS[which]), 1, None, 0
    while True:
        if k & size:
            out = run if out is None else joined(out[: len(run) - done], run[done:])
            done += size
        if 2 * size > k:
            return out[: len(values) - k + 1]
        run = joined(run[: len(run) - size], run[size:])
        size *= 2


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k bytes, modulo 2**64."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if len(_powers.get("roll", ())) < len(data):
        for name, base in (("roll", _BASE % 2**64), ("back", pow(_BASE % 2**64, -1, 2**64))):
            step = np.full(max(len(data), 1 << 16), base, U64)
            step[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(step, dtype=U64)
    with np.errstate(over="ignore"):
        sums = np.append(U64(0), np.cumsum(_BYTE[data] * _powers["roll"][: len(data)]))
        return mixed((sums[k:] - sums[:-k]) * _powers["back"][:n])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it."""
    low = U64(2**31 - 1)
    ah, al, bh, bl = a >> U64(31), a & low, b >> U64(31), b & low
    mid = ah * bl + al * bh
    return reduced((ah * bh << U64(1)) + (mid >> U64(30)) + ((mid & U64(2**30 - 1)) << U64(31)) + al * bl)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def prime_powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base modulo the prime, kept for later calls."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base, p = _BASES[which], int(PRIME)
        base = pow(base, -1, p) if inverse else base
        have = np.ones(1, U64)
        while len(have) < max(n, 1 << 12):
            have = np.append(have, times(have, U64(pow(base, len(have), p))))
        _powers[which, inverse] = have
    return have[:n]


class Prefixes:
    """Prefix polynomials of a row of numbers modulo the prime."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        term = times(reduced(mixed(values.astype(U64) + U64(1))), prime_powers(n, which))
        low, high = np.cumsum(term & U64(2**31 - 1)), np.cumsum(term >> U64(31))
        self.sums = np.append(U64(0), reduced(low + reduced((high >> U64(30)) + ((high & U64(2**30 - 1)) << U64(31)))))
        self.back = prime_powers(n + 1, which, True)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the slices [a, b)."""
        return times(reduced(self.sums[b] + PRIME - self.sums[a]), self.back[a])


def class_table(pattern_chars: bytes) -> np.ndarray:
    """True for the bytes that are not in ``pattern_chars``."""
    out = np.ones(256, bool)
    out[np.frombuffer(pattern_chars, np.uint8)] = False
    return out


#: Words are maximal runs of bytes other than space and TAB..CR.
WORD_BYTES = class_table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """A batch of texts: ``data`` bytes, text i being data[starts[i]:ends[i]]."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        raw = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
        self.n = len(raw)
        raw.append(b"")
        self.data = np.frombuffer(b"\n".join(raw), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        sizes = np.fromiter(map(len, raw[:-1]), np.int64, self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def words(self, inside: np.ndarray = WORD_BYTES) -> None:
        """Sets w_start, w_end, w_text (the text of each word), w_first (first word of each text, one more at the end)."""
        mask = inside[self.data]
        edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
        self.w_start, self.w_end = edge[0::2], edge[1::2]
        self.w_first = np.append(np.searchsorted(self.w_start, self.starts), len(self.w_start))
        self.w_text = np.repeat(np.arange(self.n), np.diff(self.w_first))

    def word_hash(self, which: int = 0) -> np.ndarray:
        return slices(self.data, self.w_start, self.w_end, which)

    def word_numbers(self) -> np.ndarray:
        """A number for each word: the same for equal words, told apart by their bytes."""
        return numbered(self.data[ragged(self.w_start, self.w_end - self.w_start)], self.w_end - self.w_start)

    def whole(self, k: int) -> np.ndarray:
        """For each run of k words whether it lies in one text."""
        n = len(self.w_text) - k + 1
        return self.w_text[k - 1 :] == self.w_text[:n] if n > 0 else np.zeros(0, bool)


def numbered(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each of the byte strings that ``data`` is made of, the same for equal strings."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    cuts = np.append(0, np.cumsum(sizes)).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def pieces(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in slices of about ``most`` bytes of text (at least one row each)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).to_numpy())
    group = np.cumsum(sizes) // most
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each slice, one slice after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive entries of ``first``."""
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[first[1:]] - sums[first[:-1]]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """For each i whether data[a:a + size] equals other[b:b + size], byte by byte; ``other``: the same data if not given."""
    other = data if other is None else other
    out = np.ones(len(a), bool)
    part = np.cumsum(size) // PIECE_BYTES
    for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(part)) + 1) if len(a) else ():
        n = size[own]
        differ = np.append(0, np.cumsum(data[ragged(a[own], n)] != other[ragged(b[own], n)]))
        stop = np.cumsum(n)
        out[own] = differ[stop] == differ[stop - n]
    return out
