"""Each corpus operator against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import base64
import random
import sys
import types
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from leafmill.llm import bpe, components, decontam, html, license, lm, ngram_join, packed, quality, repeats, substring, suffix, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
rng = random.Random(4)
WORDS = ["The", "the", "of", "ähnlich", "naïve", "x1", "tion,", "end.", "漢字", "a", "B", "re-do", "(so)", "42"]


def prose(n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))


def unique(n: int) -> str:
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


PASSAGE, BASE = unique(60), unique(120).split()


def near(k: int) -> str:
    """A near copy: a few words of BASE changed."""
    w = list(BASE)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    out = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One two three four five"), (7, prose(300)), (8, f"{unique(80)} {PASSAGE} {unique(30)}"),
        (9, f"{PASSAGE}\n{unique(200)}"), (10, prose(20_000)), (11, "z" * 5000), (12, " ".join(["same"] * 400)), (13, " 　 x\x00y  "), (None, unique(50)), (None, PASSAGE), (14, f"{PASSAGE} {PASSAGE}"),
        (15, unique(100)), (15, unique(100)), (2, ""), (2**62, prose(10)), (-5, " ".join(BASE)), *((20 + k, near(k % 4)) for k in range(14)),
    ]
    out += [(40, out[6][1]), (41, out[6][1]), out[6]]  # exact copies and a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those used inside."""
    data = [(d, t, 1, "k", b"x", 3.5, "c", True) for d, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, chunk int, key string, data binary, rh double, c0 string, row boolean").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def got(df, *columns):
    return H.ordered(tuple(r) for r in df.select(*columns).collect())


def test_quality(docs, rows, none):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(quality.measured(docs), "doc_id", *names) == H.ordered((d, *H.quality(t)) for d, t in rows)
    assert quality.measured(none).count() == 0
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns


def test_quality_verdicts(spark):
    menu = "Home | News | Sport | Weather | Travel | Shop"
    clean = "\n".join(f"{unique(10)}." for _ in range(9))
    cases = [(1, clean), (2, "\n".join([clean, menu])), (3, "\n".join([menu.replace("News", f"N{k}") for k in range(20)])), (4, " ".join(f"w{k}### x{k}$$$" for k in range(60))), (5, "\n".join(f"SHOUT{k}!! LOUD{k}!!" for k in range(50)))]
    df = spark.createDataFrame([(d, t, len(t)) for d, t in cases], "doc_id int, text string, n_chars bigint")
    assert {r.doc_id: r.kept for r in quality.measured(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    out = {r.doc_id: r for r in quality.cleaned(df).collect()}
    assert set(out) == {1, 2} and out[1].text == clean and out[2].text == clean and out[2].n_chars == len(clean)


def test_line_rules(spark):
    bad = [
        "Home | News | Sport | Weather", "All rights reserved.", "Please subscribe now to our letter.", "Alle Rechte vorbehalten!", "Tous droits réservés, 2020.", "Todos los derechos reservados.", "Log in", "Sign up now.",
        "This goes on and on ...", "and so on…", "***", "a### b$$$ c&&&", "Menu\r", "\tShop", "LOUD!! LOUDER!! LOUDEST!!",
    ]
    good = [
        "He saw the catalog in the hall and went on.", "They had to log in the forest for years, which paid well.", "A design in blue.", "Yes.", "Three words here", "A line with a comma,", "Das Wort Impressumspflicht ist lang.", "\tOne two three\r",
        "It says all rights reserved, " + "but this is only one phrase in a line of very many words that go on and on until nobody would take it for a footer any more, " * 2,
    ]
    df = spark.createDataFrame([(x,) for x in bad + good], "line string")
    from pyspark.sql import functions as F

    out = {r.line: r.fails for r in df.select("line", quality.line_fails(F.col("line")).alias("fails")).collect()}
    assert [x for x in bad if not out[x]] == [] and [x for x in good if out[x]] == []


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_rows(docs, rows, none, encoder):
    def one(d, t):
        ids = encoder.encode_ordinary(t or "")
        return d, len(ids), H.sha(b"".join(i.to_bytes(4, "little") for i in ids)), H.sha((t or "").encode())

    assert got(bpe.digests(docs, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == H.ordered(one(*r) for r in rows)
    assert bpe.digests(none, RANKS).count() == 0
    encoded = bpe.with_ids(docs, RANKS, offsets=True)
    assert encoded.columns[-2:] == ["ids", "offsets"]
    assert got(bpe.decoded(encoded, RANKS), "doc_id", "text") == H.ordered((d, t or "") for d, t in rows)
    for r in encoded.filter("doc_id = 7").collect():
        raw, ids = r.text.encode(), list(r.ids)
        assert r.offsets[0] == 0 and sorted(r.offsets) == list(r.offsets) and r.offsets[-1] < len(raw)
        cut = r.offsets.index(r.offsets[len(ids) // 2])
        assert b"".join(bpe.ranks(RANKS).bytes[o : o + n].tobytes() for o, n in zip(bpe.ranks(RANKS).offsets[ids[cut:]], bpe.ranks(RANKS).sizes[ids[cut:]], strict=True)) == raw[r.offsets[cut] :]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab1 '\n\t,!stmdrevléх漢\xa0　\x85_"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), min_size=1, max_size=4))
def test_bpe_text(texts):
    ranks = bpe.ranks(RANKS)
    ids, count, _, _ = ranks.encode(texts)
    at = 0
    enc = test_bpe_text.encoder = getattr(test_bpe_text, "encoder", None) or tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    for t, n in zip(texts, count.tolist(), strict=True):
        assert ids[at : at + n].tolist() == enc.encode_ordinary(t), t
        at += n


def test_substring(docs, rows, none):
    assert got(substring.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == H.ordered(H.substring(rows))
    assert got(substring.digests(docs, 4), "doc_id", "n_words", "n_removed", "kept_sha256") == H.ordered(H.substring(rows, 4))
    assert substring.digests(none).count() == 0
    out = substring.removed(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.filter("doc_id IS NOT NULL").collect()}
    assert PASSAGE not in kept[8] and 14 not in kept and kept[15] and kept[2] == ""


def test_suffix(docs, rows, none):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for crowded in (4000, 1):  # by suffix arrays, and by counting the windows of crowded anchors
        assert got(suffix.digests(docs, crowded=crowded), *columns) == H.ordered(H.suffix(rows))
    assert got(suffix.digests(docs, 40, 12), *columns) == H.ordered(H.suffix(rows, 40))
    assert suffix.digests(none).count() == 0


def test_suffix_collision():
    import numpy as np

    parts = [b"banana", b"bananas", b"band", b"an", b"", b"banana"]
    data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in parts])
    group = np.array([0, 0, 0, 1, 1, 1])
    s = repeats.Suffixes(data, np.cumsum(sizes) - sizes, sizes)
    order, near = s.sorted(group)
    assert [parts[k] for k in order] == [b"banana", b"bananas", b"band", b"", b"an", b"banana"] and near.tolist() == [-1, 6, 3, -1, 0, 0]
    s.prefixes.sums = np.zeros_like(s.prefixes.sums)  # every hash is like every other
    order, near = s.sorted(group)
    assert [parts[k] for k in order] == [b"banana", b"bananas", b"band", b"", b"an", b"banana"] and near.tolist() == [-1, 6, 3, -1, 0, 0]


def test_suffix_far():
    """Windows past 16 MiB find their anchors: those of a passage repeated there are the same."""
    import numpy as np
    import pyarrow as pa

    data = np.random.default_rng(2).integers(97, 123, (1 << 24) + 5000).astype(np.uint8)
    one, two = (1 << 24) + 1000, (1 << 24) + 4001
    data[two : two + 300] = data[one : one + 300]
    texts = suffix.Texts(pa.array([data.tobytes().decode()]))
    lo, hi, at, h = suffix.contexts(texts, suffix.LENGTH, suffix.GRAM)
    assert ((lo <= hi) & (hi <= at) & (at + suffix.GRAM <= lo + suffix.LENGTH)).all()
    for k in range(101):
        i, j = np.searchsorted(lo, [one + k, two + k], "right") - 1
        assert h[i] == h[j] and at[i] - one == at[j] - two


def test_ngram_chain(spark):
    """A chain of texts, each like the next one only, is one group, also where its family is dealt out by rare shingles."""
    words = unique(720).split()
    rows = [(k, " ".join(words[3 * k : 3 * k + 120])) for k in range(200)] + [(k, unique(60)) for k in range(300, 310)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.component_id for r in ngram_join.groups_of(df, family=12_000).collect()}
    assert all(out[k] == 0 for k in range(200)) and all(out[k] == k for k in range(300, 310))


def test_ngram_join(docs, rows, none):
    want = H.ordered(H.groups(rows))
    assert got(ngram_join.groups_of(docs), "doc_id", "n_shingles", "component_id") == want
    assert got(ngram_join.groups_of(docs, family=300), "doc_id", "n_shingles", "component_id") == want  # in pairs of blocks
    assert ngram_join.groups_of(none).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").select("doc_id").collect())
    assert ids == sorted({c for _, _, c in want if c is not None}) and kept.filter("doc_id IS NULL").count() == 2


def test_t_occurrence():
    import numpy as np

    for seed in range(60):
        r = np.random.default_rng(seed)
        bases = [r.choice(300, r.integers(1, 40), replace=False) for _ in range(4)]
        sets = []
        for _ in range(r.integers(1, 40)):
            s = set(bases[r.integers(4)].tolist()) ^ set(r.choice(300, r.integers(0, 6)).tolist())
            sets += [np.array(sorted(s), np.uint64)] * bool(s)
        want, have = list(range(len(sets))), list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = want[i], want[j]
                    want = [b if x == a else x for x in want]
        for root, member in ngram_join.linked(sets) if sets else ():
            have[member] = root
        cells = lambda x: sorted(tuple(i for i in range(len(x)) if x[i] == v) for v in set(x))
        assert cells(want) == cells(have), seed


def test_components(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(0, 60)] + [("x", "y"), ("y", "x"), ("z", "z"), ("q1", "q2"), ("q3", "q2")]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    out = {r.a: r.b for r in components.components(df).collect()}
    assert out == {f"n{k:03d}": "n000" for k in range(1, 61)} | {"y": "x", "q2": "q1", "q3": "q1"}
    assert components.components(df.limit(0)).count() == 0


def test_decontamination(spark, docs, rows, none):
    words = BASE[10:30]
    items = [(1, " ".join(words)), (2, "One two, three"), (3, None), (None, "one two three four five"), (4, "!!"), (5, " ".join(words)), (10, f"{PASSAGE.upper()}"), (2, "One two, three")]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = H.ordered(H.decontam(rows, items))
    assert sum(r[-1] for r in want) > 5
    assert got(decontam.contaminated(docs, df), *names) == want
    assert decontam.contaminated(none, df).count() == 0
    assert not decontam.contaminated(docs, df.limit(0)).filter("contaminated").count()
    block, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 50
    try:
        assert got(decontam.contaminated(docs, df), *names) == want  # an automaton for each few items
    finally:
        decontam.BLOCK_BYTES = block
    out = {r.doc_id: r.text for r in decontam.removed(docs, df).filter("doc_id IS NOT NULL").collect()}
    assert 14 not in out and PASSAGE not in out[8] and out[15] and out[1] is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=25), max_size=3))
def test_automaton(items, texts):
    import numpy as np
    import pyarrow as pa

    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    auto = decontam.Automaton(named, 3)
    t = decontam.Texts(pa.array([x for _, x in rows], pa.string()), lower=True)
    t.words(decontam.WORD)
    for strip in (1, 2, 64):
        decontam.STRIP = strip
        hit = np.zeros(len(t.w_text), bool)
        pairs = set(zip(*(x.tolist() for x in auto.hits(t, t.word_hash(), hit)), strict=True))
        for k, want in enumerate(H.decontam(rows, named, 3)):
            assert int(hit[t.w_first[k] : t.w_first[k + 1]].sum()) == want[2] and sum(x == k for x, _ in pairs) == want[3]


def thue_morse(a: str, b: str, n: int = 1024) -> tuple[str, str]:
    """Two strings that rolling polynomials modulo powers of two can't tell apart."""
    one, two = a, b
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


def test_hashes_of_patterns(spark):
    """Words that polynomials modulo 2**64 confuse are told apart by every operator that hashes."""
    x, y = thue_morse("a", "b")
    same = unique(40).split()
    one, two = " ".join([*same[:20], x, *same[20:]]), " ".join([*same[:20], y, *same[20:]])
    rows = [(1, one), (2, two), (3, x), (4, y), (5, f"{x} {y} {x}"), (6, " ".join(thue_morse("p ", "q ", 200)[0].split())), (7, " ".join(thue_morse("p ", "q ", 200)[1].split()))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert got(substring.digests(df), "doc_id", "n_words", "n_removed", "kept_sha256") == H.ordered(H.substring(rows))
    assert got(suffix.digests(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == H.ordered(H.suffix(rows))
    assert got(ngram_join.groups_of(df), "doc_id", "n_shingles", "component_id") == H.ordered(H.groups(rows))
    items = [(1, x), (2, " ".join([*same[15:20], y, *same[20:24]]))]
    want = H.ordered(H.decontam(rows, items))
    assert got(decontam.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS).rank, special_tokens={})
    assert {r.doc_id: r.ids for r in bpe.with_ids(df, RANKS).collect()} == {d: enc.encode_ordinary(t) for d, t in rows}


def test_bpe_collision(monkeypatch):
    """Pieces whose hashes are all equal are encoded by their bytes."""
    import numpy as np

    monkeypatch.setattr(bpe, "slices", lambda data, a, b: np.full(len(a), 7, np.uint64))
    ranks = bpe.Ranks(RANKS)
    texts = ["one two three", "two one", "", "漢字 zwei"]
    ids, count, _, _ = ranks.encode(texts)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    assert ids.tolist() == [i for t in texts for i in enc.encode_ordinary(t)] and count.tolist() == [len(enc.encode_ordinary(t)) for t in texts]


def test_word_collision(monkeypatch):
    """Benchmark words whose hashes are all equal are told apart by their bytes."""
    import numpy as np
    import pyarrow as pa
    from leafmill.llm import columns

    monkeypatch.setattr(columns, "slices", lambda data, a, b, which=0: np.full(len(a), 7, np.uint64))
    named, rows = [("a", "one two three four"), ("b", "x y")], [(1, "zero one two three x y"), (2, "two one three four two three four"), (3, "x x")]
    auto = decontam.Automaton(named, 3)
    t = decontam.Texts(pa.array([x for _, x in rows]), lower=True)
    t.words(decontam.WORD)
    hit = np.zeros(len(t.w_text), bool)
    auto.hits(t, t.word_hash(), hit)
    assert [int(hit[t.w_first[k] : t.w_first[k + 1]].sum()) for k in range(3)] == [w[2] for w in H.decontam(rows, named, 3)]


def test_very_long_text(spark):
    """A text of over 2**24 bytes: what is planted near its end is found there."""
    words = unique(1_600_000)  # about 17 MB
    body = f"{PASSAGE} {words} {PASSAGE} tail"
    assert len(body) > 1 << 24
    rows = [(1, body), (2, f"{unique(30)} {PASSAGE}"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    n = len(PASSAGE.split())
    out = {r.doc_id: r for r in substring.digests(df).collect()}
    kept = f"{words} tail"
    assert (out[1].n_removed, out[2].n_removed, out[3].n_removed) == (2 * n, n, 0) and out[1].kept_sha256 == H.sha(kept.encode())
    out = {r.doc_id: r for r in suffix.digests(df).collect()}
    assert out[1].n_bytes == len(body) and out[1].n_spans == 2 and 2 * len(PASSAGE) <= out[1].n_removed <= 2 * len(PASSAGE) + 8
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    out = {r.doc_id: r for r in decontam.contaminated(df, items).collect()}
    assert (out[1].n_hit, out[2].n_hit, out[1].n_words) == (2 * n, n, 2 * n + 1_600_001)
    assert {r.doc_id: r.n_shingles for r in ngram_join.groups_of(df).collect()}[1] > 1_599_000
    encoded = bpe.digests(df, RANKS)
    assert {r.doc_id: r.decoded_sha256 for r in encoded.collect()}[1] == H.sha(body.encode())


def test_chunks_of_repeated_rows(spark):
    """Rows that all repeat are dealt out over the chunks; so are rows without text."""
    for rows in ([(1, "one two three")] * 3000, [(None, None)] * 3000, [(k, None) for k in range(3000)]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        chunked = packed.Chunked(df, chunk_rows=500)
        sizes = [r["count"] for r in chunked.rows.groupBy("chunk").count().collect()]
        assert chunked.n >= 6 and max(sizes) <= 900, sizes
    df = spark.createDataFrame([(1, " ".join(BASE))] * 300, "doc_id bigint, text string")
    packed.CHUNK_ROWS, most = 50, packed.CHUNK_ROWS
    try:
        assert {r.n_removed for r in substring.digests(df).collect()} == {len(BASE)} and suffix.digests(df).filter("n_removed = n_bytes").count() == 300
        assert ngram_join.one_of_each(df).count() == 1 and ngram_join.groups_of(df).filter("component_id = 1").count() == 300
    finally:
        packed.CHUNK_ROWS = most


def test_lm(docs, rows, none):
    have = got(lm.scores(docs), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = H.ordered(H.lm_base(rows))
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert all(abs(h[5] - w[5]) <= 1e-9 * abs(w[5]) for h, w in zip(have, want, strict=True))
    assert all(h[6] < 0 for h in have)
    assert lm.scores(none).count() == 0


def lm_model(n_words=400, n_tokens=20_000, seed=1):
    """A bucket of a Zipf corpus of three contexts; every (context, word) has a cell."""
    import numpy as np

    r = np.random.default_rng(seed)
    words = r.integers(0, 2**63, n_words).astype(np.uint64)
    p = 1 / np.arange(1, n_words + 1)
    text = words[r.choice(n_words, n_tokens, p=p / p.sum())]
    context = np.append(lm.START, (text[:-1] % np.uint64(3)).astype(np.int64))
    every = (np.repeat(words, 3), np.tile(np.arange(3), n_words))
    tokens = types.SimpleNamespace(word=np.concatenate([text, every[0]]), text=np.repeat([0, 1], [n_tokens, 3 * n_words]), context=np.concatenate([context, every[1]]))
    return lambda: lm.Seats(lm.ask(0, tokens, np.array([True, False]), 1).column("data").to_pylist())


def lm_sums(make, seed=0):
    """The corpus and the sums after each seating, as the rounds make them."""
    import numpy as np

    corpus, told = lm.counted(make()), []
    for _ in range(1 + lm.SAMPLES):
        t = lm.totals(make(), seed, corpus, told)
        x = {a: (b, d) for a, b, d in zip(*(t.column(k).to_pylist() for k in range(3)), strict=True)}
        told.append(lm.Sums(*(np.array([x[k][j] for k in range(lm.CONTEXTS)]) for j in (0, 1)), *x[-2]))
    return corpus, told


def test_lm_is_a_distribution():
    """Probabilities of one context sum to one over the known words and the unknown one."""
    import numpy as np

    make = lm_model()
    corpus, told = lm_sums(make)
    seats = make()
    prob = lm.sampled(seats, 0, corpus, told)
    assert (prob > 0).all() and (seats.tables <= seats.count).all() and (seats.tables[seats.count > 0] >= 1).all()
    d, unseen = corpus.discount(), int(corpus.known) + 1 - int((seats.word_count > 0).sum())
    assert unseen == 1
    for context in range(3):
        inside = prob[(seats.context == context) & (seats.word_count[seats.word] > 0)].sum()
        unknown = np.mean([(lm.STRENGTH + d * s.t[context]) / (lm.STRENGTH + s.c[context]) * s.base(np.zeros(1), np.zeros(1), corpus.known)[0] for s in told[1:]])
        assert abs(inside + unknown - 1) < 1e-9
    again = lm.sampled(make(), 7, *lm_sums(make, 7))
    assert np.abs(np.log(prob / again)).mean() < 0.2


def test_lm_conditional():
    """Tables are drawn with their exact probabilities, generalised Stirling numbers times the weights of new tables: for few customers nearly so, for many to a few percent."""
    import math

    import numpy as np

    d, n = 0.7, 20_000
    for strength, base in ((30.0, 0.05), (2000.0, 0.001), (100.0, 0.0001), (30.0, 0.5)):
        for c, far in ((2, 0.012), (5, 0.025), (60, 0.06), (1500, 0.2)):
            log = np.full(c + 1, -np.inf)  # Stirling numbers of the customers so far, by tables
            log[1] = 0
            with np.errstate(divide="ignore"):
                for m in range(1, c):
                    log = np.logaddexp(np.append(-np.inf, log[:-1]), log + np.log(np.maximum(m - d * np.arange(c + 1), 0)))
            t = np.arange(1, c + 1)
            want = log[1:] + np.cumsum(np.log(strength + d * (t - 1))) + t * np.log(base)
            want = np.exp(want - want.max())
            want /= want.sum()
            ids = np.random.default_rng(c).integers(0, 2**63, n).astype(np.uint64)
            have = lm.conditional(lm.Draws(3), ids, np.full(n, c), np.full(n, strength), np.full(n, base), d)
            assert abs(have.mean() / (want * t).sum() - 1) < far, (strength, base, c)
            if c <= 5:
                assert np.abs(np.bincount(have, minlength=c + 1)[1:] / n - want).max() < 0.02
    x = np.array([0.01, 0.5, 1, 3.3, 40, 1e6])
    assert np.allclose(lm.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_lm_perplexity(spark):
    """Text like what was learnt is less of a surprise than text unlike it; repeated and very long texts are scored whole."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    rows = [(k, text(300)) for k in range(60)] + [(k, unique(300)) for k in range(100, 110)] + [(200, text(300_000)), (200, text(50)), (201, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = lm.scores(df).collect()
    of = lambda lo, hi: [x.perplexity for x in out if lo <= x.doc_id < hi and x.held_out]
    assert of(0, 60) and max(of(0, 60)) < 400 and (not of(100, 110) or min(of(100, 110)) > max(of(0, 60)))
    assert all(abs(x.perplexity - 10 ** (-x.score / x.n_tokens)) < 1e-6 * x.perplexity for x in out)
    assert sorted(x.n_tokens for x in out if x.doc_id >= 200) == [1, 51, 300_001]


def test_lm_buckets(spark, monkeypatch):
    """Sums are of the whole corpus: scores don't depend on the number of buckets."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(r.choices(words, [1 / (i + 1) for i in range(400)], k=400))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = []
    for n in (1, 7):
        monkeypatch.setattr(lm.Chunked, "buckets", lambda self, entries, each, n=n: n)
        out.append(got(lm.scores(df), "doc_id", "n_known", "train_tokens", "base_score", "score"))
    assert out[0] == out[1]


def test_lm_histories(spark):
    """A word is expected by the two words before it, not by how they are spelt: endings are shared here, and the nearer word too."""
    r = random.Random(8)
    # after xx-ending p, after yy-ending q; after "one mid" u, after "two mid" v
    runs = [["xxending", "p"], ["yyending", "q"], ["one", "mid", "u"], ["two", "mid", "v"]]
    noise = [f"n{k}" for k in range(50)]
    train = [" ".join(w for _ in range(60) for w in [*r.choice(runs), r.choice(noise)]) for _ in range(40)]
    tests = ["xxending p", "xxending q", "yyending q", "yyending p", "one mid u", "one mid v", "two mid v", "two mid u"]
    rows = list(enumerate(train, 1000)) + list(enumerate(tests))
    score = {x.doc_id: x.score for x in lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(score[k] > score[k + 1] + 0.8 for k in range(0, 8, 2)), score


def test_lm_histories_sum_to_one():
    """Of each history, over all known words and the unknown one, by any number of buckets."""
    import numpy as np

    r = np.random.default_rng(4)
    words = r.integers(0, 2**63, 30).astype(np.uint64)
    p = 1 / np.arange(1, 31)
    word = words[r.choice(30, 6000, p=p / p.sum())]
    tokens = types.SimpleNamespace(word=word, one=np.append(lm.BEGIN, word[:-1]), two=np.append([lm.BEGIN, lm.BEGIN], word[:-2]), text=np.zeros(6000, int))
    some = [(words[a], words[b]) for a, b in ((0, 0), (1, 0), (7, 3), (29, 28))]
    more = [(w, one, two) for two, one in some for w in [*words, lm.U64(12345)]]
    for k, c in enumerate(("word", "one", "two")):
        setattr(tokens, c, np.append(getattr(tokens, c), np.array([m[k] for m in more], np.uint64)))
    tokens.text = np.append(tokens.text, np.ones(len(more), int))
    out = []
    for n, frequent in ((1, words[:0]), (5, words[:2])):
        h = lm.Histories(tokens, np.array([True, False]), n, frequent)
        sent = dict(zip(*h.sent(0).select(["bucket", "data"]).to_pydict().values(), strict=True))
        to = lambda rows: {k: sorted(r[2:0:-1] + r[3:] for r in rows if r[0] == k) for k in range(n)}
        step = lambda x, got: to([a for k in range(n) for a in lm.bucket_step(k, [sent[k]] if k in sent else [], got[k], x, n, frequent)])
        ids = got = step(None, {k: [] for k in range(n)})
        for number in range(1 + lm.SAMPLES):
            if number:
                got = step(x, told)
            told = to([a for k in range(n) for a in lm.parent_step(k, ids[k], got[k], number)])
            x = lm.Whole(*sum(np.frombuffer(d, "<f8") for v in told.values() for kind, _, d in v if kind == lm.SUMS))
        assert (x.n, x.known) == (6000, 30)
        answers = [lm.unbundle(lm.bucket_answers([sent[k]], [0], k, told[k], x, frequent)["data"][0].as_py()) for k in sorted(sent)]
        prob = np.concatenate([np.frombuffer(a[1], "<f4") for a in answers])[h.cell]
        assert np.abs(prob[6000:].reshape(4, 31).astype(float).sum(1) - 1).max() < 1e-5
        out.append(prob)
    assert (out[0] == out[1]).all()


def test_lm_exact():
    """Up to ``EXACT`` customers tables are drawn with their exact probabilities, and the draws of a cell don't depend on what else is drawn."""
    import numpy as np

    d, n = 0.7, 20_000
    for strength, base in ((30.0, 0.05), (2000.0, 0.001), (100.0, 0.0001), (30.0, 0.5)):
        for c in (5, 60, 400):
            log = np.full(c + 1, -np.inf)
            log[1] = 0
            with np.errstate(divide="ignore"):
                for m in range(1, c):
                    log = np.logaddexp(np.append(-np.inf, log[:-1]), log + np.log(np.maximum(m - d * np.arange(c + 1), 0)))
            t = np.arange(1, c + 1)
            want = log[1:] + np.cumsum(np.log(strength + d * (t - 1))) + t * np.log(base)
            want = np.exp(want - want.max())
            want /= want.sum()
            ids = np.random.default_rng(c).integers(0, 2**63, n).astype(np.uint64)
            have = lm.conditional(lm.Draws(3), ids, np.full(n, c), np.full(n, strength), np.full(n, base), d)
            mean = (want * t).sum()
            far = 5 * np.sqrt((want * (t - mean) ** 2).sum() / n)
            assert abs(have.mean() - mean) < far + 1e-9, (strength, base, c)
    count = np.array([1, 2, 600, 7, 0, 3000])
    ids, one = np.arange(9, 15).astype(np.uint64), np.ones(6)
    both = lm.conditional(lm.Draws(3), ids, count, 50 * one, 0.01 * one, d)
    each = [int(lm.conditional(lm.Draws(3), ids[k : k + 1], count[k : k + 1], one[:1] * 50, one[:1] * 0.01, d)[0]) for k in range(6)]
    assert both.tolist() == each and both[0] == 1 and both[4] == 0


def test_lm_questions_are_small():
    """Frequent words are sent as numbers, which changes how large the questions are and no answer."""
    import numpy as np

    r = np.random.default_rng(6)
    words = r.integers(0, 2**63, 3000).astype(np.uint64)
    p = 1 / np.arange(1, 3001)
    word = words[r.choice(3000, 40_000, p=p / p.sum())]
    tokens = types.SimpleNamespace(word=word, one=np.append(lm.BEGIN, word[:-1]), two=np.append([lm.BEGIN, lm.BEGIN], word[:-2]), text=np.zeros(40_000, int))
    x, out = lm.Whole(40_000, 1, 30_000, 2000, 20_000, 2000, 3000, 30_000, 4000), []
    for common in (lm.NO_WORDS, lm.Words(words[:1500]), lm.Words(np.append(words, lm.BEGIN))):
        h = lm.Histories(tokens, np.array([True]), 1, words[:0], common)
        sent = h.sent(0)["data"].to_pylist()
        b = lm.Bucket(sent, words[:0], common)
        told = [np.full(len(b.word), 9), np.full(len(b.word), 2), *(np.zeros(len(b.keys), int) for _ in range(2))]
        b.again(lm.Draws(5), x, told)
        out.append((len(sent[0]), b.predicted(x, told)[b.entry][h.cell]))
    assert (out[0][1] == out[1][1]).all() and (out[0][1] == out[2][1]).all()
    import pickle

    common = lm.Words(words)  # goes with the code of each task
    again = pickle.loads(pickle.dumps(common))
    assert len(pickle.dumps(common)) < 9 * 3000 and all((getattr(again, k) == v).all() for k, v in vars(common).items())
    some = np.sort(np.append(words[::7], r.integers(0, 2**63, 500).astype(np.uint64)) & lm.LOW)
    assert (common.climbed(common.steps(some)) == some.astype(np.int64)).all() and len(common.steps(some)) < len(lm.steps(some))
    assert out[2][0] < 5 * 40_000 < 9 * 40_000 < out[0][0]


def test_warc(spark, tmp_path):
    page = "<html>" + prose(400) + "</html>"
    rows = [(1, None), (2, ""), (3, page), (4, page), (9, page), (9, page), (None, page), (5, "x"), (6, "y" * 200_000)]
    df = spark.createDataFrame([(p, None if p == 5 else f"http://a.b/{p} c", h, "e") for p, h in rows], "page_id bigint, url string, html string, sha string").repartition(3)
    have = got(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert have == H.ordered(H.warc(rows))
    assert warc.round_trip(df.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(df, least=10).collect()}
    assert small[1] == small[2] == "response" and small[3] == "revisit"
    ids = []
    for e in warc.export(warc.archives(df), str(tmp_path)).collect():
        raw = (tmp_path / e.archive).read_bytes()
        assert raw[:4] == warc.SKIPPABLE.to_bytes(4, "little") and len(raw) == e.bytes
        for k, r in enumerate(warc.records(raw)):
            assert r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") and (b"warcinfo" in r[:40]) == (k == 0)
            ids.append(r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0])
    assert len(ids) == len(set(ids)) > len(rows)
    named = df.withColumn("page_id", df.page_id.cast("string"))
    assert {r.page_id: r.refers_to for r in warc.round_trip(named).filter("record_type = 'revisit'").collect()} == {"3": "9", "4": "9", "1": "2"}
    whole = {r.page_id: bytes(r.payload) for r in warc.read(warc.archives(df), payloads=True).filter("record_type = 'response'").collect()}
    assert whole[9].decode() == page and whole[6] == b"y" * 200_000


def page(k: int, style: int = 0) -> tuple[str, str]:
    """A page and its article text."""
    paras = [f"Paragraph {k}.{i} of the article, with {unique(12)}." for i in range(4)]
    body = "".join(f"<p>{p}</p>" for p in paras)
    home = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>')[style]
    noise = "<aside><p>Read this too</p></aside>" if k % 2 else ""
    made = f"<!DOCTYPE html><html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home {k}</a></li><li><a>News</a></li></ul></nav><div class='ad'>Buy now {k}</div>{home.format(f'<h1>Title &amp; {k}</h1>' + body + noise)}<!-- gone --><div class='comments'><p>Nice one {k}</p></div><footer>&copy; someone</footer></body></html>"
    return made, "\n".join([f"Title & {k}", *paras])


def test_html(spark):
    pages = [page(k) for k in range(60)]
    df = spark.createDataFrame([(k, f"u{k}", h) for k, (h, _) in enumerate(pages)] + [(100, None, None), (101, "e", ""), (None, "n", pages[0][0]), (102, "x", "<p>a < b <i>c")], "page_id bigint, url string, html string")
    out = {r.url if r.page_id is None else r.page_id: r for r in html.extracted(df).collect()}
    right = sum(out[k].text == text for k, (_, text) in enumerate(pages))
    assert right >= 58, right
    assert out[100].text == "" == out[101].text and out["n"].text == out[0].text and out[0].n_chars == len(out[0].text)
    assert html.extracted(df.limit(0)).count() == 0


def test_html_held_out():
    """Pages of other make-ups than those trained on: nearly all blocks are labelled right."""
    import numpy as np

    model = html.trained([page(k)[0] for k in range(80)])
    good = total = 0
    for k in range(100, 160):
        made, text = page(k, k % 3)
        blocks = html.blocks(made)
        labels = model.label([html.vectors(blocks)])[0]
        want = np.array([b.text in text.split("\n") for b in blocks])
        good, total = good + int((labels == want).sum()), total + len(want)
    assert good / total > 0.95, good / total


def test_html_blocks():
    text = lambda h: [b.text for b in html.blocks(h)]
    assert text("<p>a\n b<br>c<p>d&nbsp;e&#33;</p>f") == ["a b c", "d e!", "f"]
    assert text("<table><tr><td>1<td>2</tr></table><ul><li>x<li>y</ul>") == ["1", "2", "x", "y"]
    assert text("<style>p{}</style><script>if (a < b) '</p>'</script>z<!-- <p>q</p> -->") == ["z"]
    assert text("a < b and <i title='x>y'>c</i>") == ["a < b and c"]
    assert text("<p>" * 3000 + "deep") == ["deep"]


def test_html_unclosed():
    """Elements and quotes that are never closed keep the rest of the page; nested hidden ones end with the outer one."""
    text = lambda h: [b.text for b in html.blocks(h)]
    assert text("<object>x<object>y</object>tail</object>z") == ["z"]
    for name in ("svg", "object", "select", "video"):
        assert text(f"<p>a<{name}><p>b</p>c") == ["a", "b", "c"], name
    assert text("<p>a</p><script>x = 1<p>b</p>") == ["a", "b"]
    assert text("<p>a <a href=http://x/>link</a> b") == ["a link b"]
    assert text('<p>a<b title="x>c</b><p>d') == ["ac", "d"]
    assert text("<head><title>t</title><p>a") == ["a"] and text("a<!-- b > c") == ["a c"] and text("<div/>x") == ["x"]


def test_html_is_linear():
    import time

    for part in ('<a "', "<div>x", '<a ">"', '<a x=">"', "<script>x", "<object>x", "<b><p>", "<!--", "<p>x</b>"):
        took = []
        for n in (4_000, 32_000):
            began = time.process_time()
            html.blocks(part * n)
            took.append(time.process_time() - began)
        assert took[1] < 32 * max(took[0], 0.02), (part, took)  # of eight times the text, quadratic work would take 64 times as long


def test_html_blinded():
    """Without the names that the labels were taken from, words and places still tell the article on other pages."""
    import numpy as np

    model = html.trained([page(k)[0] for k in range(80)])
    good = total = 0
    for k in range(100, 150):
        made, text = page(k, k % 2)
        blocks = html.blinded(html.blocks(made, tokens=True))
        labels = model.label([html.vectors(blocks)])[0]
        want = np.array([b.text in text.split("\n") for b in blocks])
        good, total = good + int((labels == want).sum()), total + len(want)
    assert good / total > 0.85, good / total


def test_html_rows(spark):
    """Repeated rows, a clashing column and a page of a megabyte."""
    big = "<article>" + "".join(f"<p>Paragraph {k} of a long text, with its words.</p>" for k in range(20_000)) + "</article>"
    pages = [page(k)[0] for k in range(20)]
    df = spark.createDataFrame([(k, "u", h, "x") for k, h in enumerate(pages)] + [(3, "u", pages[3], "x"), (99, "u", big, "x")], "page_id bigint, url string, html string, text string")
    out = html.extracted(df).collect()
    assert len(out) == 22 and len({r.text for r in out if r.page_id == 3}) == 1
    long = next(r for r in out if r.page_id == 99)
    assert long.n_chars == len(long.text) and long.text.count("\n") > 19_000


def test_html_long_block():
    """All words of a block count, not only those at its start."""
    start = " ".join(["word"] * 70)
    one, two = (html.vectors(html.blocks(f"<p>{start} {x}</p>"))[0, html.PATH_SIZE : html.PATH_SIZE + html.WORD_SIZE] for x in ("alpha beta", "gamma delta"))
    assert (one != two).any()


def test_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    m = html.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask = r.standard_normal((2, 4, m.w["xf"].shape[0])), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = r.integers(0, 2, (2, 4)).astype(float)
    loss = lambda: -(mask * (y * np.log(p := m.probabilities(x, mask)) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = m.gradients(x, mask, y)
    for name in m.w:
        i = tuple(r.integers(0, n) for n in m.w[name].shape)
        before, h = m.w[name][i], 1e-4
        m.w[name][i] = before + h
        up = loss()
        m.w[name][i] = before - h
        down = loss()
        m.w[name][i] = before
        assert abs((up - down) / (2 * h) - g[name][i]) < 1e-4, name


def whole_alignment(a, b):
    """The score of the best local alignment, over all cells."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, *row), row
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_align(a, b):
    import numpy as np

    n, start, stop = license.align(np.array(a), np.array(b), -len(a), len(b))
    best = whole_alignment(a, b)
    assert (n > 0) == (best > 0)
    if n:
        assert whole_alignment(a, b[start:stop]) == best and best <= 2 * n


def test_license_each_occurrence(spark):
    """However close they stand, all occurrences of a notice are found; long texts and repeated rows too."""
    line = "Released under the MIT License."
    long = " ".join([unique(30_000), line, unique(5), line, unique(60_000), dict(license.TEMPLATES)["Zlib"]])
    rows = [(1, " ".join([line] * 50)), (2, " and ".join([line] * 3)), (3, long), (3, long), (4, f"{line} x y Licensed under CC BY 4.0.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = {(r.doc_id, r.license): r["count"] for r in license.scan(df).groupBy("doc_id", "license").count().collect()}
    assert n == {(1, "MIT"): 50, (2, "MIT"): 3, (3, "MIT"): 4, (3, "Zlib"): 2, (4, "MIT"): 1, (4, "CC-BY-4.0"): 1}
    assert license.scan(df, templates=()).count() == 0


def test_license(spark, docs, none):
    body = dict(license.TEMPLATES)["ISC"]
    changed = body.replace("fee is hereby", "a fee is here by").replace("any purpose", "all purposes")
    rows = [(1, f"{unique(40)}\nReleased under the MIT License. {unique(20)}"), (2, f"{unique(5)} {changed}"), (3, unique(500)), (4, None), (5, ""), (6, "licensed under\n CC-BY-NC 4.0 and Licensed under the Apache license, version 2.0"), (7, "under the terms of the")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, license string")
    out = {}
    for r in license.scan(df).collect():
        out.setdefault(r.doc_id, {})[r.license] = r
    assert {d: set(x) for d, x in out.items()} == {1: {"MIT"}, 2: {"ISC"}, 6: {"CC-BY-NC-4.0", "Apache-2.0"}}
    r = out[1]["MIT"]
    assert r.coverage == 1 and rows[0][1].encode()[r.start_byte : r.end_byte] == b"Released under the MIT License"
    assert 0.8 <= out[2]["ISC"].coverage < 1
    assert license.scan(none).count() == 0 and license.scan(docs).count() == 0


@pytest.mark.parametrize("gap", range(8))
@pytest.mark.parametrize("times", [2, 5, 1000])
def test_license_repeated(gap, times):
    """Each of several notices that follow each other closely is found."""
    import pyarrow as pa

    t = license.index(license.TEMPLATES)
    x = license.Texts(pa.array([" ".join(f"{unique(gap)} Licensed under CC BY 4.0." for _ in range(times))]), lower=True)
    x.words(license.WORD)
    want = [(6, k * (gap + 6) + gap, (k + 1) * (gap + 6)) for k in range(times)]
    assert [m[1:] for m in license.matches(x.word_hash(), t, license.COVERAGE)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=16))
def test_alignment(a, b):
    """The banded alignment with a band over everything finds the score of the plain recurrence."""
    import numpy as np

    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    n, start, stop = license.align(np.array(a), np.array(b), -len(a), len(b))
    assert (n > 0) == (best > 0) and 2 * n >= best and 0 <= start <= stop <= len(b)
