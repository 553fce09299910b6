"""Exact repeats around shared anchors: contexts of one anchor meet, extensions decide, bytes or words verify.

A text is a row of units (bytes, or words). A window of ``length`` units is repeated if it stands at two
places. The caller gives each window an anchor, a run of units inside it that equal windows share, and
says whether that anchor is crowded. Neighbouring windows of one anchor make a context.

* Contexts of an anchor are brought together, each different one of a chunk once. What starts at the
  anchors, and what ends there read backwards, is sorted by a mergesort whose comparisons find the common
  extension by binary search over prefix polynomial hashes. Windows are equal exactly if their contexts
  extend in common far enough to the right and to the left. Extensions of neighbours are verified unit by
  unit; after a collision they are sorted by their units.
* Crowded anchors are not brought together, as one task could not hold them: their windows are counted
  by two prefix polynomials modulo a prime, over 100 bits, dealt out by these, each once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from leafmill.llm import packed
from leafmill.llm.columns import U64, Prefixes, mixed, ragged, same_bytes
from leafmill.llm.packed import bounds, by_bucket, groups, keyed, low_bytes, unpacked

#: Contexts of an anchor, above which its windows are counted by hash.
CROWDED = 4000
#: Units of contexts that are sorted at once.
PART_UNITS = 1_000_000
_EMPTY = np.zeros(0, np.int64)


class Contexts(NamedTuple):
    """First window, last window and anchor of each context as places, the anchor's hash, whether it is crowded, and a hash of the whole context."""

    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    crowded: np.ndarray
    kind: np.ndarray

    def take(self, which: np.ndarray) -> Contexts:
        return Contexts(*(x[which] for x in self))


class Suffixes:
    """Suffixes of a row of units, compared by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes
        self.prefixes = Prefixes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, by binary search."""
        a, b = self.starts[i], self.starts[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefixes.of(a, a + mid) == self.prefixes.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; the shorter of two that agree is first."""
        k = self.common(i, j)
        done = k == np.minimum(self.sizes[i], self.sizes[j])
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.starts[i] + k, last)], self.data[np.minimum(self.starts[j] + k, last)]
        return np.where(done, self.sizes[i] < self.sizes[j], x < y)

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their groups (sorted numbers) and inside a group by mergesort; and the common extension with the one before, -1 at the head of a group."""
        n = len(group)
        order = np.arange(n)
        head = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(head, n))
        begin, most = np.repeat(head, size), int(size.max(initial=0))
        end, place = begin + np.repeat(size, size), np.arange(n) - begin
        width = 1
        while width < most:
            run = place // width
            other = begin + (run ^ 1) * width  # the run that this one is merged with
            stop = np.minimum(other + width, end)
            live = np.flatnonzero(other < end)
            low, high = other[live], stop[live].copy()
            me, right = order[live], (run[live] & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                it, mine, after = order[mid], me[open_], right[open_]
                # equal suffixes: those of the left run first; one comparison of (mine, it) or (it, mine)
                lower = self.less(np.where(after, mine, it), np.where(after, it, mine))
                before = lower ^ after
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = np.arange(n)
            pair = begin[live] + (run[live] & ~1) * width
            to[live] = pair + (place[live] - run[live] * width) + (low - other[live])
            new = np.empty(n, np.int64)
            new[to] = order
            order, width = new, width * 2
        near = np.full(n, -1, np.int64)
        inner = np.flatnonzero(place > 0)
        if len(inner):
            i, j = order[inner - 1], order[inner]
            near[inner] = self.common(i, j)
            if not same_bytes(self.data, self.starts[i], self.starts[j], near[inner]).all():
                return self.by_units(group)
        return order, near

    def by_units(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the units themselves, after a collision of hashes."""
        parts = [self.data[s : s + k].tolist() for s, k in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]
        order = sorted(range(len(parts)), key=lambda x: (group[x], parts[x]))
        near = [-1] * len(order)
        for p in range(1, len(order)):
            if group[order[p]] == group[order[p - 1]]:
                x, y = parts[order[p - 1]], parts[order[p]]
                near[p] = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
        return np.array(order, np.int64), np.array(near, np.int64)


def repeated_windows(hashes: np.ndarray, before: np.ndarray, span: np.ndarray, more: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """covered[context, k]: whether the k-th window of a context stands elsewhere too.

    ``before``: units of a context before its anchor; ``span``: its windows less one; ``more``: whether there are several such contexts.
    """
    n = len(hashes)
    _, first, group = groups(hashes)
    by = np.argsort(group, kind="stable")
    hashes, before, span, more, starts, group = hashes[by], before[by], span[by], more[by], starts[by], group[by]
    right = Suffixes(data, starts + before, length + span - before)
    order, near = right.sorted(group)
    del right
    flipped = Suffixes(data[::-1].copy(), len(data) - (starts + before), before)
    order_left, near_left = flipped.sorted(group)
    del flipped
    covered = np.zeros((n, int(span.max(initial=0)) + 1), bool)
    covered[more] = np.arange(covered.shape[1]) <= span[more, None]
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(int(before.max(initial=0)) + 1):  # windows that start x units before the anchor
        at = np.flatnonzero((before >= x) & (before - span <= x))
        if len(at) < 2:
            continue
        rank_right[order] = np.cumsum(near < length - x)
        rank_left[order_left] = np.cumsum(near_left < x)
        same = rank_right[at] * (n + 1) + rank_left[at]
        o = np.argsort(same, kind="stable")
        s = same[o]
        eq = s[1:] == s[:-1]
        twice = np.zeros(len(o), bool)
        twice[1:] |= eq
        twice[:-1] |= eq
        hit = at[o[twice]]
        covered[hit, before[hit] - x] = True
    out = np.empty_like(covered)
    out[by] = covered
    return out


def whole_anchors(hashes: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The contexts in parts of about ``PART_UNITS`` that hold all contexts of their anchors."""
    order = np.argsort(hashes, kind="stable")
    head = np.flatnonzero(np.append(True, hashes[order[1:]] != hashes[order[:-1]]))
    part = (np.cumsum(size[order]) // PART_UNITS)[head]
    return np.split(order, head[np.flatnonzero(np.diff(part)) + 1])


def different(c: Contexts, units: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, group, times): one of each different context, each context's number among them, and how often each is there. Equal ones are compared unit by unit."""
    order, first, group = groups(c.kind)
    head = order[first]
    mine = head[group]
    rest = np.flatnonzero(mine != np.arange(len(group)))
    size = c.hi - c.lo + length
    same = (size[rest] == size[mine[rest]]) & (c.at[rest] - c.lo[rest] == c.at[mine[rest]] - c.lo[mine[rest]])
    if not same.all() or not same_bytes(units, c.lo[rest], c.lo[mine[rest]], size[rest]).all():
        number: dict[tuple, int] = {}
        group = np.array([number.setdefault((a - i, units[i : i + k].tobytes()), len(number)) for i, a, k in zip(c.lo.tolist(), c.at.tolist(), size.tolist(), strict=True)], np.int64)
        _, head = np.unique(group, return_index=True)
    return head, group, np.bincount(group, minlength=len(head))


def window_keys(units: np.ndarray, c: Contexts, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, key and second key of every window of the contexts."""
    if not len(c.lo):
        return _EMPTY, np.zeros(0, U64), np.zeros(0, U64)
    size, n = c.hi - c.lo + length, c.hi - c.lo + 1
    own = units[ragged(c.lo, size)]
    at = ragged(np.cumsum(size) - size, n)
    one, two = (mixed(Prefixes(own, k).of(at, at + length)) for k in (0, 1))
    return ragged(c.lo, n), keyed(one, buckets), two & ~U64(1)


def send(chunk: int, n: int, units: np.ndarray, length: int, c: Contexts, body: Callable[[np.ndarray, np.ndarray], tuple[bytes, np.ndarray]]) -> pa.Table:
    """Questions about the contexts (buckets n to 2n) and the windows of crowded anchors (from 2n on), and what the chunk needs to read the answers.

    ``body``: bytes of the contexts that start at given places with given numbers of units, and where each ends.
    """
    calm, hot = c.take(np.flatnonzero(~c.crowded)), c.take(np.flatnonzero(c.crowded))
    head, group, times = different(calm, units, length)
    bucket = keyed(calm.hash[head], n) >> U64(48)
    order = np.argsort(bucket, kind="stable")
    head, times, bucket = head[order], times[order], bucket[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    cuts = np.searchsorted(bucket, np.arange(n + 1, dtype=U64)).tolist()
    before, span = calm.at[head] - calm.lo[head], calm.hi[head] - calm.lo[head]
    flat, stop = body(calm.lo[head], span + length)
    stop = [0, *stop.tolist()]
    planes = [low_bytes(calm.hash[head], 8), low_bytes(before.astype(U64), 2), low_bytes(span.astype(U64), 2), low_bytes((times > 1).astype(U64), 1)]
    squeeze = zstandard.ZstdCompressor(level=1)
    rows = []
    for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if j > i:
            raw = b"".join(p[i:j].tobytes() for p in planes) + flat[stop[i] : stop[j]]
            rows.append((n + b, np.array([j - i], "<u4").tobytes() + squeeze.compress(raw)))
    own = [np.stack([number[group], calm.lo, calm.hi - calm.lo]).astype("<i4")]
    w, keys, second = window_keys(units, hot, length, n)
    order, first, same = groups(keys, second)
    count = np.diff(np.append(first, len(keys)))
    h = order[first]
    cuts = bounds(keys[h], n)
    k_, s_ = low_bytes(keys[h], 6), low_bytes(second[h] | (count > 1).astype(U64), 8)
    rows += [(2 * n + b, k_[i:j].tobytes() + s_[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    own += [np.stack([same, w]).astype("<i4"), np.array(cuts, "<i4")]
    back = b"".join(np.array([x.size], "<u4").tobytes() + x.tobytes() for x in own)
    return packed.question_rows(chunk, rows, back, n + chunk % n)


def compared(bucket: int, chunks: list[int], blobs: list[bytes], n: int, length: int, most: int, units_of: Callable[[bytes], np.ndarray]) -> pa.Table:
    """Answers of a bucket: for each context the bits of its windows (``most`` + 1 at most), for each window of a crowded anchor one bit."""
    if bucket >= 2 * n:
        sizes, (keys, second) = unpacked(blobs, [6, 8])
        _, first, group = groups(keys, second >> U64(1))
        twice = np.diff(np.append(first, len(keys))) > 1
        twice[group[(second & U64(1)).astype(bool)]] = True
        return packed.answers(chunks, [bucket] * len(chunks), packed.bits(sizes, twice[group]))
    counts = [int.from_bytes(b[:4], "little") for b in blobs]
    open_ = zstandard.ZstdDecompressor()
    raw = [open_.decompress(b[4:]) for b in blobs]
    hashes, before, span, more = (np.concatenate(x) for x in zip(*(_planes(b, k) for b, k in zip(raw, counts, strict=True)), strict=True))
    units = units_of(b"".join(b[13 * k :] for b, k in zip(raw, counts, strict=True)))
    del raw
    size = span + length
    start, more = np.cumsum(size) - size, more.astype(bool)
    rows = np.zeros((len(hashes), (most + 8) // 8), np.uint8)
    for part in whole_anchors(hashes, size):
        own = units[ragged(start[part], size[part])]
        covered = repeated_windows(hashes[part], before[part], span[part], more[part], own, np.cumsum(size[part]) - size[part], length)
        full = np.zeros((len(part), most + 1), bool)
        full[:, : covered.shape[1]] = covered
        rows[part] = np.packbits(full, axis=1)
    stop = np.cumsum(counts).tolist()
    return packed.answers(chunks, [bucket] * len(chunks), [rows[b - k : b].tobytes() for b, k in zip(stop, counts, strict=True)])


def repeated(told: pa.Table, n: int, length: int, most: int, total: int) -> np.ndarray:
    """For each of the chunk's ``total`` units whether a repeated window covers it."""
    buckets, data = by_bucket(told)
    own, at = [], 0
    raw = data[buckets.index(packed.OWN)]
    while at < len(raw):
        k = int.from_bytes(raw[at : at + 4], "little")
        own.append(np.frombuffer(raw, "<i4", k, at + 4).astype(np.int64))
        at += 4 + 4 * k
    starts = [_EMPTY]
    number, lo, _ = own[0].reshape(3, -1)
    if len(number):
        bits = b"".join(d for b, d in zip(buckets, data, strict=True) if n <= b < 2 * n)
        hit = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, (most + 8) // 8), axis=1).astype(bool)
        some = np.flatnonzero(hit.any(1)[number])
        for i in range(0, len(some), 100_000):
            who, k = np.nonzero(hit[number[some[i : i + 100_000]]])
            starts.append(lo[some[i : i + 100_000]][who] + k)
    group, w = own[1].reshape(2, -1)
    if len(w):
        cuts, by = own[2].tolist(), dict(zip(buckets, data, strict=True))
        flags = np.concatenate([np.unpackbits(np.frombuffer(by[2 * n + b], np.uint8), count=j - i) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]).astype(bool)
        starts.append(w[flags[group]])
    start = np.concatenate(starts)
    edge = np.bincount(start, minlength=total + 1) - np.bincount(start + length, minlength=total + 1)
    return np.cumsum(edge[:total]) > 0


def _planes(blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(blob, "<u8", k),
        np.frombuffer(blob, "<u2", k, 8 * k).astype(np.int64),
        np.frombuffer(blob, "<u2", k, 10 * k).astype(np.int64),
        np.frombuffer(blob, np.uint8, k, 12 * k),
    )
