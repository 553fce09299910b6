"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items form one automaton; training words are streamed through it and
the longest matching length at each word is tracked. A word is hit if it lies in an occurrence of
a window: ``window`` consecutive words of an item, or the whole of a shorter item. ``removed``
deletes hit spans and drops documents that consist of them.

The items are the broadcast side. They are taken in blocks of about ``BLOCK_BYTES`` of text, one
automaton of plain arrays each, built by a task; a worker holds one at a time, so that memory is bounded
whatever the number of items. Words are found by hash and then compared byte by byte.

Cases: null and empty texts have no words and are never contaminated; a null doc_id is passed
through; items that are null, empty or have a null item_id give no windows; items with the same id
count as one; repeated documents are judged alike; an empty items table hits nothing; other columns
are ignored, or carried by ``removed``.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.columns import Texts, class_table, per_text, pieces, ragged, same_bytes

WINDOW = 10
#: Text of the items in one automaton, a bound on what is broadcast at once.
BLOCK_BYTES = 2_000_000
#: Words of a strip.
STRIP = 64
#: Documents with at least this share of hit words are dropped by ``removed``; others lose their hit spans.
COVERAGE = 0.5
#: Words are runs of bytes other than 00-2F, 3A-60 and 7B-7F, after A-Z are lower-cased.
WORD = class_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class Automaton:
    """Generalised suffix automaton over word numbers, in arrays; words are found by their hashes and compared byte by byte."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        t = Texts(pa.array([x for _, x in items], pa.string()), lower=True)
        t.words(WORD)
        hashes, size = t.word_hash(), t.w_end - t.w_start
        self.window = window
        # words are numbered by their bytes; where two have one hash, the hash is kept for the first and such words have no number
        exact = t.word_numbers()
        _, one = np.unique(exact, return_index=True)
        self.vocabulary, pick, times = np.unique(hashes[one], return_index=True, return_counts=True)
        self.twins = self.vocabulary[times > 1]
        numbers = np.searchsorted(self.vocabulary, hashes)
        clash = np.isin(hashes, self.twins)
        numbers[clash] = len(self.vocabulary) + exact[clash]
        self.word_start, self.word_size = t.w_start[one[pick]], size[one[pick]]
        self.data = t.data
        by_bytes = np.unique(exact[clash], return_index=True)[1]
        self.by_bytes = {t.data[t.w_start[k] : t.w_end[k]].tobytes(): int(numbers[k]) for k in np.flatnonzero(clash)[by_bytes].tolist()}
        self.names = sorted({n for n, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        self._build([(number[n], numbers[t.w_first[k] : t.w_first[k + 1]].tolist()) for k, (n, _) in enumerate(items)], window)

    def _build(self, items: list[tuple[int, list[int]]], window: int) -> None:
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        self.shortest = window

        def state(n: int, up: int, own: dict[int, int]) -> int:
            length.append(n)
            link.append(up)
            go.append(own)
            return len(link) - 1

        def clone(p: int, q: int, w: int) -> int:
            """Splits state q so that the strings reached from p by w have a state of their own."""
            c = state(length[p] + 1, link[q], dict(go[q]))
            while p >= 0 and go[p].get(w) == q:
                go[p][w] = c
                p = link[p]
            link[q] = c
            return c

        def extend(last: int, w: int) -> int:
            q = go[last].get(w)
            if q is not None:
                return q if length[q] == length[last] + 1 else clone(last, q, w)
            new = state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in go[p]:
                go[p][w] = new
                p = link[p]
            if p >= 0:
                q = go[p][w]
                link[new] = q if length[q] == length[p] + 1 else clone(p, q, w)
            return new

        for _, words in items:
            at = 0
            for w in words:
                at = extend(at, w)
        # which items have a window that ends in a state, and which are one that does
        long_items: set[tuple[int, int]] = set()
        whole: set[tuple[int, int, int]] = set()
        for item, words in items:
            at = 0
            for k, w in enumerate(words):
                at = go[at][w]
                if k + 1 >= window:
                    top = at
                    while length[link[top]] >= window:
                        top = link[top]
                    long_items.add((top, item))
            if words and len(words) < window:
                whole.add((at, len(words), item))
                self.shortest = min(self.shortest, len(words))
        keys = [(s << 32 | w, q) for s, own in enumerate(go) for w, q in own.items()]
        keys.sort()
        self.keys, self.to = np.array([k for k, _ in keys], np.int64), np.array([q for _, q in keys], np.int32)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        # the shortest suffix of a state that still holds a window, and the nearest suffix that is a whole item
        order = np.argsort(self.length, kind="stable")[1:]
        self.top, self.near = np.full(len(link), -1, np.int32), np.full(len(link), -1, np.int32)
        ends = {s for s, _, _ in whole}
        for v in order.tolist():
            up = link[v]
            self.near[v] = v if v in ends else self.near[up]
            if length[v] >= window:
                self.top[v] = v if length[up] < window else self.top[up]
        rows = sorted(long_items)
        self.item_state, self.item = np.array([s for s, _ in rows], np.int64), np.array([i for _, i in rows], np.int64)
        ends_ = sorted(whole)
        self.whole_state, self.whole_size, self.whole_item = (np.array(x, np.int64) for x in zip(*ends_, strict=True)) if ends_ else (np.zeros(0, np.int64),) * 3

    def numbers(self, t: Texts, hashes: np.ndarray) -> np.ndarray:
        """The number of each word of the batch that stands where a window may, else -1."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        out = np.where(self.vocabulary[at] == hashes, at, -1)
        for k in np.flatnonzero(np.isin(hashes, self.twins)).tolist() if len(self.twins) else ():
            out[k] = self.by_bytes.get(t.data[t.w_start[k] : t.w_end[k]].tobytes(), -1)
        place = self.runs(out, t)[0]
        plain = place[out[place] < len(self.vocabulary)]
        size, own = t.w_end[plain] - t.w_start[plain], out[plain]
        alike = size == self.word_size[own]
        alike[alike] = same_bytes(t.data, t.w_start[plain[alike]], self.word_start[own[alike]], size[alike], self.data)
        out[plain[~alike]] = -1
        return out

    def runs(self, numbers: np.ndarray, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in runs of known words inside one text that are long enough to hold a window, and the runs' begins and ends."""
        known = numbers >= 0
        same = known[1:] & known[:-1] & (t.w_text[1:] == t.w_text[:-1])
        a = np.flatnonzero(known & ~np.append(False, same))
        b = np.flatnonzero(known & ~np.append(same, False)) + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        return ragged(a, b - a), a, b

    def hits(self, t: Texts, hashes: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks the hit words of the batch; (text, item) of what occurs.

        Runs are cut into strips that begin ``window`` - 1 words early, and all strips are streamed at once:
        at each word the longest match inside the strip is tracked.
        """
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary) or not len(hashes):
            return none, none
        words = self.numbers(t, hashes)
        _, a, b = self.runs(words, t)
        n = -(-(b - a) // STRIP)
        own = np.repeat(a, n) + STRIP * ragged(np.zeros(len(a), np.int64), n)
        stop = np.minimum(np.repeat(b, n), own + STRIP)
        at = np.maximum(np.repeat(a, n), own - self.window + 1)
        state, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        edge = np.zeros(len(hit) + 1, np.int64)
        pairs = []
        while len(at):
            open_, w = np.arange(len(at)), words[at]
            while len(open_):
                key = state[open_] << 32 | w[open_]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[k] == key
                state[open_[ok]], size[open_[ok]] = self.to[k[ok]], size[open_[ok]] + 1
                open_ = open_[~ok]
                size[open_[state[open_] == 0]] = 0
                open_ = open_[state[open_] > 0]
                state[open_] = self.link[state[open_]]
                size[open_] = self.length[state[open_]]
            full = np.flatnonzero(size >= self.window)
            np.add.at(edge, at[full] + 1 - size[full], 1)
            np.add.at(edge, at[full] + 1, -1)
            pairs.append(self._items(t.w_text[at[full]], self.top[state[full]], self.item_state, self.item))
            near, who = self.near[state], np.arange(len(at))
            while (near >= 0).any():
                who, near = who[near >= 0], near[near >= 0]
                row, entry = _spread(near, self.whole_state)
                fits = self.whole_size[entry] <= size[who[row]]
                row, entry = row[fits], entry[fits]
                np.add.at(edge, at[who[row]] + 1 - self.whole_size[entry], 1)
                np.add.at(edge, at[who[row]] + 1, -1)
                pairs.append((t.w_text[at[who[row]]], self.whole_item[entry]))
                near = self.near[self.link[near]]
            at = at + 1
            live = at < stop
            at, stop, state, size = at[live], stop[live], state[live], size[live]
        hit |= np.cumsum(edge[:-1]) > 0
        return tuple(np.concatenate([p[k] for p in pairs]) for k in (0, 1)) if pairs else (none, none)

    @staticmethod
    def _items(text: np.ndarray, state: np.ndarray, states: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, entry = _spread(state, states)
        return text[row], items[entry]


def _spread(state: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry): for each state all entries of it in the sorted ``states``."""
    first, last = np.searchsorted(states, state, "left"), np.searchsorted(states, state, "right")
    return np.repeat(np.arange(len(state)), last - first), ragged(first, last - first)


def automata(items: DataFrame, window: int = WINDOW) -> list:
    """Broadcast automata of the items, a block of them each. They are built by tasks, one a block; the driver passes on one after another."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)

    def build(t: pa.Table) -> pa.Table:
        return pa.table([pa.array([pickle.dumps(Automaton(sorted(zip(t.column("item").to_pylist(), t.column("text").to_pylist(), strict=True)), window), 5)], pa.binary())], names=["data"])

    if not blocks:
        return []
    built = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).groupBy("block").applyInArrow(build, "data binary")
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(r.data))) for r in built.toLocalIterator()]


def _loaded(block: tuple) -> Automaton:
    """The automaton of a block; the last one used is kept."""
    name, data = block
    if _kept["id"] != name:
        _kept.update(id=None, automaton=None)
        _kept.update(id=name, automaton=pickle.loads(data.value))
        vars(data).pop("_value", None)
    return _kept["automaton"]


_kept: dict = {"id": None, "automaton": None}


def _judged(batch: pa.RecordBatch, blocks: list) -> tuple[Texts, np.ndarray, list[list[str]]]:
    """The batch's words, which of them are hit, and the sorted items of each text."""
    t = Texts(batch.column("text"), lower=True)
    t.words(WORD)
    hashes, hit, found = t.word_hash(), np.zeros(len(t.w_text), bool), [set() for _ in range(t.n)]
    for block in blocks:
        a = _loaded(block)
        text, item = a.hits(t, hashes, hit)
        pairs = np.unique(text * len(a.names) + item)
        for i, k in zip((pairs // len(a.names)).tolist(), (pairs % len(a.names)).tolist(), strict=True):
            found[i].add(a.names[k])
    return t, hit, [sorted(x) for x in found]


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (byte offsets of the hit runs)."""
    blocks = automata(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                t, hit, found = _judged(batch, blocks)
                n_hit = per_text(hit, t.w_first)
                joined = [",".join(x).encode() for x in found]
                spans = [_spans(t, hit, i) if n_hit[i] else [] for i in range(t.n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(t.w_first)), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined]), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<bigint>")


def _spans(t: Texts, hit: np.ndarray, i: int) -> list[int]:
    """start, end, start, end, ... of the hit runs of text i, in bytes from its start."""
    a, b = t.w_first[i], t.w_first[i + 1]
    edge = np.flatnonzero(np.diff(hit[a:b].view(np.int8), prepend=0, append=0))
    out = np.empty(len(edge), np.int64)
    out[0::2] = t.w_start[a + edge[0::2]] - t.starts[i]
    out[1::2] = t.w_end[a + edge[1::2] - 1] - t.starts[i]
    return out.tolist()


def removed(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without hit spans; documents whose hit words make ``coverage`` of their words or more are dropped.

    Documents without a hit are returned as they are; n_chars, if there, follows the text.
    """
    blocks, names = automata(items, window), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                t, hit, _ = _judged(batch, blocks)
                n_hit, n = per_text(hit, t.w_first), np.diff(t.w_first)
                texts = batch.column("text").to_pylist()
                for i in np.flatnonzero(n_hit).tolist():
                    raw, cut = texts[i].encode(), _spans(t, hit, i)
                    parts = [raw[a:b] for a, b in zip([0, *cut[1::2]], [*cut[0::2], len(raw)], strict=True)]
                    texts[i] = b"".join(parts).decode()
                columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(k) for k, c in enumerate(names)]
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([None if x is None else len(x) for x in texts], columns[k].type)
                keep = pa.array((n_hit == 0) | (n_hit < coverage * n))
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return docs.mapInArrow(run, docs.schema)
