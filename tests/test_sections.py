"""Order-dependent section passes, page layout and source readers against hand-made cases."""

from __future__ import annotations

import zipfile
from io import BytesIO

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import text as T
from leafmill.operators import pdf_layout, quality_gate, search, sections, structure, verify
from leafmill.plans import pages, structures
from leafmill.sources import archive, decode, detect, readers


def rows(spark, *chapters):
    return spark.createDataFrame([(1, n, t, x, len(x.split())) for n, (t, x) in enumerate(chapters, 1)], "doc int, n int, title string, text string, tokens bigint")


def test_merge_tiny(spark):
    long = "word " * 40
    out = sections.merged_tiny(rows(spark, ("a", "x"), ("b", "y"), ("c", long), ("d", long), ("e", "z"))).orderBy("n").collect()
    assert [(r.title, r.tokens) for r in out] == [("c", 44), ("d", 42)]
    assert out[0].text.startswith("b\n\na\n\nx\n\ny\n\nword") and out[1].text.rstrip().endswith("e\n\nz")
    assert sections.merged_tiny(rows(spark, ("only", "x"))).count() == 1


def test_split_giants(spark):
    text = "\n\n".join(["one two three. four five six."] * 10)
    out = sections.split_giants(rows(spark, ("t", text), ("s", "short")), 30, 20).collect()
    parts = sorted((r for r in out if r.part), key=lambda r: r.part)
    assert [r.title for r in parts] == [f"t ({k}/{len(parts)})" for k in range(1, len(parts) + 1)]
    assert all(r.tokens <= 20 for r in parts) and " ".join(r.text for r in parts).split() == text.split()
    assert [r.title for r in out if not r.part] == ["s"]


def test_greedy_bins(spark):
    df = spark.createDataFrame([([5, 5, 1, 9, 20, 1],)], "t array<bigint>")
    assert df.select(structure.greedy_bins(df.t, 10)).first()[0] == [0, 0, 1, 1, 2, 3]


def test_layout(spark):
    b = pages.PAGES.df(spark)
    out = pdf_layout.layout(b).orderBy("doc", "page", "pos").collect()
    heads = {r.text: r.level for r in out if r.kind == "heading"}
    assert heads["Part 1"] == 1 and heads["The Road"] == 2 and heads["Bold Words"] == 3 and heads["Chapter 2"] == 1
    assert not any("Travel Notes" in r.text or r.text.startswith("—") for r in out)
    assert [r.text for r in out if r.kind == "footnote"] == ["1 a note at the foot"]
    assert [r.text.split()[2] for r in out if r.doc == 2 and r.page == 1] == ["1.0", "1.2", "1.1"]  # the last one goes on over the page
    assert pdf_layout.wide_pages(b).collect() == [(3, 1)]


def test_text_across_pages(spark):
    block = lambda pos, page, text, size=10.0, y=100.0: (1, page, pos, text, size, False, 1, 50.0, y, 500.0, y + 50, 600.0, 800.0, "para", None)
    schema = pages.PAGES.schema
    joined = lambda *b: [r.text for r in pdf_layout.across_pages(spark.createDataFrame(list(b), schema)).orderBy("pos").collect()]
    assert joined(block(0, 1, "it goes on"), block(1, 2, "and on"), block(2, 3, "to the end.")) == ["it goes on and on to the end."]
    assert joined(block(0, 1, "It ends."), block(1, 2, "and on")) == ["It ends.", "and on"]
    assert joined(block(0, 1, "it goes on"), block(1, 2, "Capital")) == ["it goes on", "Capital"]
    assert len(joined(block(0, 1, "body text of the page that is long."), block(1, 1, "1 a note", 7.0, 700.0), block(2, 2, "and on"))) == 3


def test_chapters_of_trees(spark):
    t = structures.tree(spark)
    out = structure.chapters(t, structure.F.lit(2)).orderBy("doc", "start").collect()
    assert [r.title for r in out if r.doc == 4] == ["Book", "Book · Leaf", "Book · Empty", "Book · Last"] or [r.title for r in out if r.doc == 4][0].startswith("Book")
    assert [r.title for r in out if r.doc == 3] == [structure.PREFACE]


def test_gate(spark):
    ok = "A line of text that is long enough.\n" * 200
    df = spark.createDataFrame([(1, ok), (2, "a-\nb\n\n12\n\n" + ok[:100]), (3, "��Ñ" + ok)], "doc int, text string").withColumn("tokens", T.word_count(structure.F.col("text")))
    refs = df.selectExpr("doc", "tokens as ref_tokens", "0L as removed_tokens", "0L as control_chars", "true as found", "0 as pages", "0 as wide_pages", "true as hyphenated")
    out = {r.doc: r for r in quality_gate.scored(quality_gate.metrics(df, refs)).collect()}
    assert (out[1].status, out[1].score, out[1].triggers) == ("ok", 1.0, [])
    assert out[2].status != "ok" and any("garbage" in t for t in out[2].triggers) and any("dehyphen" in t for t in out[2].triggers)
    assert out[3].encoding_score > 0


def test_quotes():
    chapter = "# Head\n\nFirst sentence here. The quick brown fox jumps over the lazy dog [3] near the river bank. Last one follows.\n\n# Next\n\nother words"
    tokens = verify.normalized(chapter)
    assert "head" not in [t.canon for t in tokens] and "3" not in [t.canon for t in tokens]
    look = lambda q: verify.best_window([t.canon for t in tokens], [t.canon for t in verify.normalized(q)])
    w = look("quick brown fox jumps over the lazy dog near the river")
    assert w.exact and verify.passage(chapter, tokens, w.low, w.high) == "The quick brown fox jumps over the lazy dog [3] near the river bank."
    w = look("quick brown fox leaps over the lazy dog near the river")
    assert not w.exact and verify.verdict(round(w.ratio, 4), w.exact) in ("close", "distorted")
    assert look("zzz qqq xxx www vvv") is None
    assert verify.verdict(0.95, False) == "close" and verify.verdict(0.7499, False) == "not_found"
    long = ". ".join(f"sentence number {k} has some words" for k in range(60)).replace(". ", ", ")
    t = verify.normalized(long)
    p = verify.passage(long, t, 100, 110)
    assert p.startswith("[…] ") and p.endswith(" […]") and len(p) < 420
    assert verify.word_diff([("a", "A"), ("b", "B")], [("a", "A"), ("c", "C")]) == [("C", "B")]
    assert verify.bounds(list("abcdefghij"), "c d e f", 4)[0].tolist() == [0, 1, 2, 3, 4, 5, 6]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=3), min_size=1, max_size=30), st.lists(st.text("abd", min_size=1, max_size=3), min_size=1, max_size=8))
def test_best_window(chapter, quote):
    """Bounds only leave out what can't win: the result is that of comparing every window."""
    from difflib import SequenceMatcher

    width, wanted = min(len(quote), len(chapter)), " ".join(quote)
    starts = sorted({*range(0, len(chapter) - width + 1, max(1, width // 4)), len(chapter) - width})
    every = []
    for s in starts:
        m = SequenceMatcher(None, " ".join(chapter[s : s + width]), wanted, autojunk=False)
        if m.quick_ratio() >= verify.PREFILTER:
            every.append((m.ratio(), -s))
    got = verify.best_window(chapter, quote)
    assert (got is None) == (not every)
    if every and max(every)[0] < verify.DISTORTED:
        assert (got.ratio, -got.low) == max(every)
    elif every:
        assert got.ratio >= max(every)[0]


def test_long_texts(spark):
    """Work grows with the text, not with its square: many lone numbers, many small blocks."""
    df = spark.createDataFrame([("1\n\n" * 200_000,)], "text string").select(quality_gate.line_counts(structure.F.col("text")).alias("c")).select("c.*")
    assert tuple(df.first()) == (200_000, 200_000, 0)
    t = np.random.default_rng(1).integers(0, 40, 300_000)
    assert structure.bins_of(t, 100)[-1] > 50_000


@given(st.lists(st.integers(0, 12), max_size=40))
def test_bins(tokens):
    want, held = [], None
    for t in tokens:
        new = held is not None and held + t > 10
        want.append((want[-1] if want else 0) + new)
        held = t if held is None or new else held + t
    assert structure.bins_of(np.array(tokens, np.int64), 10).tolist() == want


def test_search_words():
    assert search.snippet("a b c licensed under d " + "x " * 20, ["licens", "under"]).count("«") == 2
    assert search.light_stem("walking") == "walk" and search.light_stem("is") == "is"
    assert search.yo_variants(["еж"]) == [["еж"], ["ёж"]]


def test_decoding():
    text = "Жила была старая щука в глубоком озере и никого не боялась"
    for name in ("utf-8", "cp1251", "koi8-r", "cp866", "utf-8-sig"):
        assert decode.decoded(text.encode(name)) == text, name
    assert decode.decoded(b"\xff\xfea\x00b\x00") == "ab"


def test_detection():
    assert detect.detect("x", b"%PDF-1.4") == "pdf"
    assert detect.detect("x.txt", b"\xef\xbb\xbf<?xml version='1.0'?><!-- c --><FictionBook>") == "fb2"
    assert detect.detect("x", b" <!DOCTYPE html><p>") == "html"
    assert detect.detect("a.md", b"# hi") == "md" and detect.detect("a.log", b"plain words") == "txt"
    with pytest.raises(detect.Unknown):
        detect.detect("a.bin", bytes(range(256)))


def test_guards():
    def zipped(**entries):
        out = BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in entries.items():
                z.writestr(k, v)
        return out.getvalue()

    with pytest.raises(archive.TooLarge):
        archive.opened(zipped(a=b"0" * 20_000_000))
    with pytest.raises(archive.Broken):
        archive.opened(b"PK nothing")
    with pytest.raises(archive.Broken):
        readers.xml(b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")
    with pytest.raises(archive.Broken):  # however late
        readers.xml(b"<!--" + b"x" * 100_000 + b"--><!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")
    with pytest.raises(archive.Broken):
        readers.xml("<?xml version='1.0' encoding='utf-16'?><!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>".encode("utf-16"))
    assert readers.xml(b"<!DOCTYPE a><a>x</a>").text == "x"


def test_fictionbook():
    book = """<FictionBook><description><title-info><author><nickname>N</nickname></author><book-title>B</book-title></title-info></description><body><title><p>B</p></title>
    <epigraph><p>e</p><text-author>who</text-author></epigraph><section><title><p>One</p><p>more</p></title><p>text<a type="note">1</a> and <a type="note">[2]</a></p><poem><stanza><v>l1</v><v>l2</v></stanza><text-author>x</text-author></poem>
    <subtitle>sub</subtitle><section><title><p>In</p></title><table><tr><th>a</th><td>b</td></tr></table></section></section></body><body name="notes"><section><title><p>1.</p></title><p>note</p></section></body></FictionBook>"""
    raw = readers.read_fb2(book.encode())
    assert [(b.kind, b.text, b.level) for b in raw.blocks] == [
        ("quote", "e\nwho", None), ("heading", "One more", 1), ("para", "text[1] and [2]", None), ("para", "l1\nl2", None), ("heading", "sub", 2), ("heading", "In", 2), ("table", "a\tb", None), ("heading", readers.NOTES, 1), ("para", "1. note", None),
    ]
    assert (raw.title, raw.author) == ("B", "N")


def test_readers():
    md = readers.read_md(b"---\nk: v\n---\nTitle\n=====\n\ntext [a](b) and ![c](d)\nmore\n\n```\nx [y](z)\n```\n> q1\n> q2\n\n- item\n1. second\n\n## Sub ##\n***\nend")
    assert [(b.kind, b.text, b.level) for b in md.blocks] == [("meta", "k: v", None), ("heading", "Title", 1), ("para", "text a and c more", None), ("code", "x [y](z)", None), ("quote", "q1\nq2", None), ("list_item", "item", None), ("list_item", "second", None), ("heading", "Sub ##", 2), ("para", "end", None)]
    md = readers.read_md("a paragraph\nof two\nHead\n---\n\n##### deep\n\n```py\ncode\n```text\nmore\n````\n\nlast-\nly\n\n---\n\nend".encode())
    assert [(b.kind, b.text, b.level) for b in md.blocks] == [("para", "a paragraph of two", None), ("heading", "Head", 2), ("heading", "deep", 4), ("code", "code\n```text\nmore", None), ("para", "lastly", None), ("para", "end", None)]
    assert [(b.text, b.level) for b in readers.read_md("Том 1\n\nГлава первая\n\nТекст.\n\nГлава вторая\n\nЕщё.".encode()).blocks if b.kind == "heading"] == [("Том 1", 1), ("Глава первая", 2), ("Глава вторая", 2)]
    txt = readers.read_txt("Том 1\n\nГлава 2. Начало\n\nпере-\nнос кто-\nто\n\nвсё".encode())
    assert [(b.kind, b.text, b.level) for b in txt.blocks] == [("heading", "Том 1", 1), ("heading", "Глава 2. Начало", 2), ("para", "перенос кто-то", None), ("para", "всё", None)]
    html = readers.read_html(b"<html lang=en><title>T &amp; t</title><nav>n</nav><article><h5>H</h5><p>a<br>b</p><ul><li>i</ul><pre> c\n d</pre><table><tr><td>1<td>2</tr><tr><td>3</td><td>4</td></tr></table><blockquote><p>q</p></blockquote><odd>z</odd></article>")
    assert [(b.kind, b.text) for b in html.blocks] == [("heading", "H"), ("para", "a b"), ("list_item", "i"), ("code", " c\n d"), ("table", "1\t2\n3\t4"), ("quote", "q"), ("para", "z")]
    assert html.title == "T & t" and html.lang == "en" and html.unknown_tags == {"odd": 1} and html.blocks[0].level == 4


def test_release(spark):
    from leafmill.session import release, stored

    kept = stored(spark.range(3).toDF("n"), "numbers")
    assert kept.count() == 3 and release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        spark.read.parquet(kept.inputFiles()[0]).count()
