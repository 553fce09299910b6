"""N-gram Jaccard self-join by T-occurrence search, and the groups of documents it links.

A document is its set of 5-word shingles; two link at a Jaccard similarity of 80 % or more. Documents
of one set are one class. A partner of a set of n shingles shares at least T = ceil(0.8 n) of them:

1. Shingles are counted over all classes (packed, each once a chunk). A class with fewer than T
   shingles that any other class has can't link and is done.
2. The others, with their shingles from rare to frequent: of any n - T + 1 shingles a partner has one.
   Classes that share one of their rarest ones are brought together; what can link is together then.
3. Inside such a family, T-occurrence search with inverted lists (DivideSkip): of a set's lists the L
   longest are set aside, the short ones are merged, and documents on T - L of them or more are looked up
   in the long ones by binary search and kept at the overlap that the similarity asks for. Documents
   linked to a group leave the index: copies by the thousand are linked once each, not pair by pair, and
   no link between groups is lost.

A family of more than ``FAMILY`` shingles is searched by parts, so that no task holds it whole: by its rare
shingles, all sets that have one of those dealt to a task; or, if a single shingle is shared by too many for
that, in pairs of blocks.

Cases: null and empty texts have no set, no link, and are their own group; fewer than five words are
one shingle; a row with a null doc_id links with nothing and its group is null; rows that repeat, or
have the same doc_id with other texts, take part each with its own set; an empty table gives an empty
result; other columns are ignored, or carried by ``one_of_each``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import packed
from leafmill.llm.columns import U64, Texts, mixed, pieces, ragged, windows
from leafmill.llm.components import components
from leafmill.llm.packed import Chunked, bounds, by_bucket, groups, keyed, unpacked
from leafmill.session import stored

SHINGLE = 5
BUCKET_ENTRIES = 500_000
#: Shingles of a family, or of a batch of families, in one task.
FAMILY, BATCH = 1_000_000, 500_000
#: Postings up to which short lists are merged with a heap; longer ones by sorting. And how soon a list counts as long.
HEAP, SKIP = 512, 0.0085
#: Families are dealt out over so many salts.
SALTS = 32


def needed(n: np.ndarray) -> np.ndarray:
    """T: the shingles that a partner of a set of n shares at least."""
    return (4 * n + 4) // 5


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order, and where each text's begin."""
    texts.words()
    h, n = texts.word_hash(), np.diff(texts.w_first)
    whole = texts.whole(SHINGLE)
    own = [windows(h, SHINGLE)[whole]]
    who = [texts.w_text[: len(whole)][whole]]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        a, size = texts.w_first[short], n[short]
        whole_text = size.astype(U64)
        for k in range(SHINGLE - 1):  # words in order, as far as a text has them
            whole_text = np.where(k < size, mixed(whole_text ^ h[np.minimum(a + k, len(h) - 1)]), whole_text)
        own.append(whole_text)
        who.append(short)
    h, who = np.concatenate(own), np.concatenate(who)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[new], who[new]
    return who, h, np.searchsorted(who, np.arange(texts.n + 1))


def profiles(chunked: Chunked) -> DataFrame:
    """doc_id, n_shingles, key (128 bits of the set; null if empty), rh and chunk of each row."""
    text, id_ = f"c{chunked.text}", f"c{chunked.id}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                _, h, first = shingles(Texts(batch.column(text), lower=True))
                with np.errstate(over="ignore"):
                    one = np.append(U64(0), np.cumsum(mixed(h ^ U64(0x5851F42D4C957F2D))))
                    two = np.append(U64(0), np.cumsum(mixed(h ^ U64(0x14057B7EF767814F))))
                    one, two = one[first[1:]] - one[first[:-1]], two[first[1:]] - two[first[:-1]]
                n = np.diff(first)
                keys = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(one.tolist(), two.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(n), pa.array(keys, pa.string()), batch.column("rh"), batch.column("chunk")], names=["doc_id", "n_shingles", "key", "rh", "chunk"])

    kind = chunked.schema["doc_id"].dataType.simpleString()
    return chunked.rows.select(text, id_, "rh", "chunk").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, key string, rh bigint, chunk int")


class Sets:
    """The shingle sets of a chunk's class representatives."""

    def __init__(self, t: pa.Table, text: int, rows: np.ndarray, buckets: int):
        rh = t.column("rh").to_numpy()
        at = np.searchsorted(rh, np.unique(rows))  # a row that repeats stands for itself once
        self.texts = Texts(t.column(f"c{text}").take(pa.array(at)), lower=True)
        self.rh = rh[at]
        self.who, self.hash, self.first = shingles(self.texts)
        keys = keyed(self.hash, buckets, 4)
        order, first, self.group = groups(keys)
        self.keys = keys[order[first]]
        self.count = np.diff(np.append(first, len(keys)))


def candidates(chunked: Chunked, rows: DataFrame) -> DataFrame:
    """Classes that may link: key, n, tokens (their hashes, from rare to frequent) and rare (the shared ones among the rarest).

    ``rows``: profiles.
    """
    text = chunked.text
    n_buckets = chunked.buckets(chunked.bytes / 6, BUCKET_ENTRIES)
    first = rows.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("chunk", "rh")).alias("r")).select("key", "r.chunk", "r.rh")
    # of each chunk: the rows that stand for their classes, with the keys
    named = first.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("rh", "key"))).alias("x"))

    def ask(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return packed.questions(chunk, np.zeros(0, U64), n_buckets)
        x = told.column("x").combine_chunks().values if hasattr(told.column("x"), "combine_chunks") else told.column("x").values
        rh, keys = x.field("rh").to_numpy(), x.field("key").to_pylist()
        s = Sets(t, text, rh, n_buckets)
        own = rh.astype("<i8").tobytes() + "".join(keys).encode()
        return packed.questions(chunk, s.keys | np.minimum(s.count, 15).astype(U64), n_buckets, own=own)

    def count(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.Table:
        sizes, (keys,) = unpacked(blobs, [6])
        order, first, group = groups(keys >> U64(4))
        total = np.minimum(np.add.reduceat((keys[order] & U64(15)).astype(np.int64), first), 255).astype(np.uint8)[group]
        stop = np.cumsum(sizes)
        return packed.answers(chunks, [bucket] * len(chunks), [total[b - k : b].tobytes() for b, k in zip(stop.tolist(), sizes.tolist(), strict=True)])

    def keep(_: int, t: pa.Table, told: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if told.num_rows:
            buckets, data = by_bucket(told)
            by = dict(zip(buckets, data, strict=True))
            own = by[packed.OWN]
            m = len(own) // 40
            rh, keys = np.frombuffer(own, "<i8", m), own[8 * m :].decode()
            s = Sets(t, text, rh, n_buckets)
            cuts = bounds(s.keys, n_buckets)
            df = np.concatenate([np.frombuffer(by[b], np.uint8) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i])[s.group]
            sums = np.append(0, np.cumsum(df > 1))
            n = np.diff(s.first)
            # rh is sorted in both, and distinct: two rows of one hash are one row
            for i in np.flatnonzero(sums[s.first[1:]] - sums[s.first[:-1]] >= needed(n)).tolist():
                a, b = s.first[i], s.first[i + 1]
                order = np.lexsort((s.hash[a:b], df[a:b]))
                h, f = s.hash[a:b][order], df[a:b][order]
                rare = int(n[i] - needed(n[i]) + 1)
                out[0].append(keys[32 * i : 32 * i + 32])
                out[1].append(int(n[i]))
                out[2].append(h.astype("<u8").tobytes())
                out[3].append(h[:rare][f[:rare] > 1].astype(np.int64))
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["key", "n", "tokens", "rare"])

    asked = packed.tell(chunked.rows, named, ask, packed.QUESTION)
    return packed.tell(chunked.rows, packed.answer(asked, count), keep, "key string, n bigint, tokens binary, rare array<bigint>")


class Index:
    """Inverted lists of the sets that have not been linked yet: one sorted array of (shingle, document)."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.doc = np.repeat(np.arange(len(sets)), self.size)
        _, self.token = np.unique(np.concatenate(sets), return_inverse=True)
        self.n_tokens = int(self.token.max(initial=-1)) + 1
        self.first = np.append(0, np.cumsum(self.size))
        self.alive = np.ones(len(sets), bool)
        self.build()

    def build(self) -> None:
        live = self.alive[self.doc]
        self.lists = np.sort(self.token[live] * len(self.alive) + self.doc[live])
        self.count = np.bincount(self.token[live], minlength=self.n_tokens)
        self.start = np.cumsum(self.count) - self.count
        self.built = int(self.alive.sum())

    def occurring(self, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Live documents on at least ``least`` of the tokens' lists, and on how many: the lists are merged and equal documents counted."""
        n = self.count[tokens]
        if n.sum() <= HEAP:
            runs = [(self.lists[a : a + k] % len(self.alive)).tolist() for a, k in zip(self.start[tokens].tolist(), n.tolist(), strict=True) if k]
            found = [(d, k) for d, g in groupby(heapq.merge(*runs)) if (k := sum(1 for _ in g)) >= least]
            docs, times = np.array([d for d, _ in found], np.int64), np.array([k for _, k in found], np.int64)
        else:  # the same count, by sorting: a heap in Python is slow for long lists
            docs, times = np.unique(self.lists[ragged(self.start[tokens], n)] % len(self.alive), return_counts=True)
        keep = (times >= least) & self.alive[docs]
        return docs[keep], times[keep]

    def partners(self, r: int) -> np.ndarray:
        """Live documents that link with r, by DivideSkip: short lists are merged, what occurs on enough of them is looked up in the long ones by binary search."""
        own = self.token[self.first[r] : self.first[r + 1]]
        own = own[np.argsort(self.count[own], kind="stable")]
        n = len(own)
        least = int(needed(np.int64(n)))
        long = min(least - 1, int(least / (SKIP * np.log2(max(2, self.count[own[-1]])) + 1)))
        docs, overlap = self.occurring(own[: n - long], least - long)
        m = self.size[docs]
        fits = (5 * m >= 4 * n) & (5 * n >= 4 * m)
        docs, overlap = docs[fits], overlap[fits]
        step = max(1, 400_000 // n)
        for a in range(0, len(docs) if long else 0, step):
            want = own[None, n - long :] * len(self.alive) + docs[a : a + step, None]
            at = np.minimum(np.searchsorted(self.lists, want), len(self.lists) - 1)
            overlap[a : a + step] += (self.lists[at] == want).sum(1)
        return docs[100 * overlap >= 80 * (n + self.size[docs] - overlap)]


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(root, member) for each set that is linked with others, directly or through others."""
    index, out = Index(sets), []
    for seed in range(len(sets)):
        if not index.alive[seed]:
            continue
        index.alive[seed] = False
        queue = [seed]
        while queue:
            found = index.partners(queue.pop())
            index.alive[found] = False
            queue += found.tolist()
            out += [(seed, s) for s in found.tolist()]
            left = int(index.alive.sum()) if len(found) > 16 else index.built
            if 2 * left < index.built:
                index.build()
        if index.built > 64 and seed % 256 == 255 and 2 * int(index.alive.sum()) < index.built:
            index.build()
    return out


def _search(t: pa.Table) -> pa.Table:
    t = t.sort_by("key")
    keys = t.column("key").to_pylist()
    pairs = linked([np.frombuffer(x, "<u8") for x in t.column("tokens").to_pylist()])
    return pa.table([pa.array([keys[m] for _, m in pairs], pa.string()), pa.array([keys[r] for r, _ in pairs], pa.string())], names=["a", "b"])


def links(found: DataFrame, family: int = FAMILY) -> DataFrame:
    """Stars (a, b) of the linked classes among candidates."""
    rare = found.select("key", F.explode("rare").alias("token"))
    head = rare.groupBy("token").agg(F.min("key").alias("b"), F.count("*").alias("n")).filter("n > 1").select("token", "b")
    families = components(rare.join(head, "token").filter("key <> b").select(F.col("key").alias("a"), "b").distinct())
    named = families.select(F.col("a").alias("key"), F.col("b").alias("family")).unionByName(families.select(F.col("b").alias("key"), F.col("b").alias("family")).distinct())
    sized = named.join(found.select("key", "n"), "key")
    size = sized.groupBy("family").agg(F.sum("n").alias("size")).withColumn("blocks", F.ceil(F.col("size") / (family // 2)).cast("int"))
    size = size.withColumn("blocks", F.when(F.col("size") <= family, 1).otherwise(F.greatest("blocks", F.lit(2))))
    total, most = size.agg(F.sum("size"), F.max("blocks")).first()
    batches = (total or 0) // BATCH + 1
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    small = F.format_string("batch %d", F.pmod(F.xxhash64("family"), F.lit(batches)))
    # a family may hold a third of the classes
    one = named.withColumn("salt", salt).join(size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["family", "salt"])
    parts = one.filter("blocks = 1").select("key", small.alias("task"))
    if (most or 1) > 1:
        many = one.filter("blocks > 1").select("key", "family", "blocks", "salt")
        held = rare.join(many, "key").join(found.select("key", "n"), "key")
        weight = held.groupBy("family", "token").agg(F.sum("n").alias("w")).groupBy("family").agg(F.max("w").alias("most"), F.sum("w").alias("all"))
        tasks = weight.select("family", F.when(F.col("most") <= family // 2, F.ceil(F.col("all") / (family // 2)).cast("int")).alias("tasks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        # without a shingle that too many share: what shares a rare one meets in its task, however large the family
        dealt = held.join(tasks.filter("tasks IS NOT NULL"), ["family", "salt"])
        parts = parts.unionByName(dealt.select("key", F.format_string("%s shingle %d", "family", F.pmod(F.xxhash64("token"), F.col("tasks"))).alias("task")).distinct())
        # else in pairs of blocks
        paired = many.join(tasks.filter("tasks IS NULL").select("family", "salt"), ["family", "salt"]).withColumn("i", block).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).filter("i <> j")
        parts = parts.unionByName(paired.select("key", F.format_string("%s %d %d", "family", F.least("i", "j"), F.greatest("i", "j")).alias("task")))
    stars = parts.join(found.select("key", "tokens"), "key").groupBy("task").applyInArrow(_search, "a string, b string")
    return components(stars) if (most or 1) > 1 else stored(stars, "links")


def grouped(docs: DataFrame, family: int = FAMILY) -> tuple[Chunked, DataFrame]:
    """The chunked documents, and their profiles with component_id: the least doc_id that links reach."""
    chunked = Chunked(docs)
    rows = stored(profiles(chunked), "profiles")
    stars = links(stored(candidates(chunked, rows), "candidates"), family)
    least = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    roots = stars.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
    own = roots.join(least, "key")
    # a group or a class may hold a third of the rows: groups are dealt out over salts, classes written so that the join may split them
    group = own.groupBy("root").agg(F.min("least").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    in_groups = own.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(group, ["root", "salt"]).select("key", "component")
    classes = stored(least.join(in_groups, "key", "left").select("key", F.coalesce("component", "least").alias("component")), "classes")
    out = rows.join(classes, "key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return chunked, out.select("doc_id", "n_shingles", "component_id", "rh", "chunk")


def groups_of(docs: DataFrame, family: int = FAMILY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return grouped(docs.select("doc_id", "text"), family)[1].select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, family: int = FAMILY) -> DataFrame:
    """``docs`` with the document of least doc_id of each group; rows with a null doc_id stay."""
    chunked, rows = grouped(docs, family)
    first = rows.filter("doc_id = component_id").groupBy("component_id").agg(F.min(F.struct("rh", "chunk")).alias("r")).select("r.chunk", "r.rh", F.lit(True).alias("once"))
    kept = first.unionByName(rows.filter("doc_id IS NULL").select("chunk", "rh", F.lit(False).alias("once")).distinct())
    names = chunked.columns

    def keep(_: int, t: pa.Table, told: pa.Table) -> pa.Table:
        rh, want, once = t.column("rh").to_numpy(), told.column("rh").to_numpy(), told.column("once").to_numpy()
        new = np.ones(len(rh), bool)
        new[1:] = rh[1:] != rh[:-1]
        mask = np.isin(rh, want[once]) & new | np.isin(rh, want[~once])
        return pa.table(packed.column_arrays(t, len(names)), names=names).filter(pa.array(mask))

    return packed.tell(chunked.rows, kept, keep, chunked.schema)
