"""Ingest of every format, reads, search, verification, updates, streaming and the command line."""

from __future__ import annotations

import zipfile

import pytest

from leafmill import config
from leafmill.cli import main
from leafmill.library import Library
from leafmill.streaming.ingest import watch

PROSE = "It was a bright cold day in April, and the clocks were striking thirteen as the travellers came over the hill. "


def epub(path):
    page = lambda title, text: f"<html><body><h1>{title}</h1><p>{text}</p></body></html>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", '<package xmlns:dc="d"><metadata><dc:title>The Lighthouse</dc:title><dc:creator>A. Keeper</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", page("First Light", PROSE * 40))
        z.writestr("OEBPS/b.xhtml", page("Second Light", "The keeper wrote in the log every evening before the lamp was lit. " * 60))


def docx(path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda text, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("Report", "Heading1") + para(PROSE * 40) + para("Results", "Heading1") + para("All tests were green at the end of the day. " * 60)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    d = tmp_path_factory.mktemp("sources")
    (d / "novel.txt").write_bytes(("Chapter 1\n\n" + PROSE * 40 + "\n\nChapter 2\n\n" + "She walked to the harbour where seven ships lay at anchor. " * 60).encode())
    (d / "roman.txt").write_bytes(("Глава 1\n\n" + "Жила была старая щука в глубоком озере и никого не боялась. " * 60 + "\n\nГлава 2\n\n" + "Наступила зима и озеро покрылось льдом до самой весны. " * 60).encode("cp1251"))
    (d / "notes.md").write_text("---\ntitle: x\n---\n\n# One\n\n" + PROSE * 40 + "\n\n- a [link](http://x)\n- b\n\n```\ncode\n```\n\n# Two\n\n> quoted words\n\n" + "Words about the second thing in these notes. " * 60)
    (d / "page.html").write_text("<html lang='en'><head><title>A Page</title></head><body><nav>menu</nav><article><h1>Top</h1><p>" + PROSE * 40 + "</p><h1>Next</h1><p>" + "A page has more than one part to it. " * 60 + "</p></article><footer>foot</footer></body></html>")
    (d / "tale.fb2").write_text('<?xml version="1.0" encoding="utf-8"?><FictionBook><description><title-info><author><first-name>Ivan</first-name><last-name>Petrov</last-name></author><book-title>Tale</book-title><lang>ru</lang></title-info></description><body><section><title><p>Start</p></title><p>' + PROSE * 40 + 'see<a type="note">1</a></p></section><section><title><p>End</p></title><p>' + "Then they all went home again. " * 60 + '</p></section></body><body name="notes"><section><title><p>1</p></title><p>a note</p></section></body></FictionBook>')
    epub(d / "light.epub")
    docx(d / "report.docx")
    (d / "broken.epub").write_bytes(b"PK\x03\x04 not a zip")
    (d / "blob.bin").write_bytes(bytes(range(256)) * 20)
    return d


@pytest.fixture(scope="module")
def library(spark, sources, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("library")))
    lib.first = {r.path.rpartition("/")[2]: r for r in lib.ingest(str(sources)).collect()}
    return lib


def test_outcomes(library):
    status = {k: r.status for k, r in library.first.items()}
    assert status.pop("broken.epub") == "failed"
    assert status.pop("blob.bin") == "skipped"
    assert len(status) == 7 and set(status.values()) <= {"ok", "review"}, library.first


def test_catalogue(library):
    rows = {r.id: r for r in library.list_books().collect()}
    assert {"petrov-tale", "ivan-petrov-tale"} & set(rows) and "a-keeper-the-lighthouse" in rows
    assert rows["a-keeper-the-lighthouse"].chapters == 2
    assert [r.title for r in library.list_chapters("novel").collect()] == ["Chapter 1", "Chapter 2"]
    assert [r.title for r in library.list_chapters("roman").collect()] == ["Глава 1", "Глава 2"]
    assert [r.title for r in library.list_chapters("report").collect()] == ["Report", "Results"]


def test_reads(library):
    got = library.get_chapters("novel", spec="2,1")
    assert got["chapters"] == [2, 1] and got["text"].startswith("# Chapter 2")
    sizes = [r.tokens for r in library.list_chapters("novel").collect()]
    got = library.get_chapters("novel", budget=sizes[0])
    assert got["chapters"] == [1] and got["next_from"] == 2
    assert library.get_chapters("novel", budget=5)["chapters"] == []
    with pytest.raises(ValueError):
        library.get_chapters("novel", spec="9")
    with pytest.raises(KeyError):
        library.list_chapters("nothing")
    with pytest.raises(ValueError):
        library.info("../etc")


def test_find_and_verify(library):
    hits = library.find("harbour ships").collect()
    assert hits[0].id == "novel" and not hits[0].partial and "«" in hits[0].snippet
    hits = library.find("harbour zebra").collect()
    assert hits and all(h.partial for h in hits)
    best = library.verify("She walked to the harbour where seven ships lay at anchor").first()
    assert (best.book, best.n, best.verdict) == ("novel", 2, "exact")
    best = library.verify("She walked to the harbour where nine ships lay at anchor").first()
    assert best.verdict in ("close", "distorted") and any("seven" in d.source for d in best.diff)
    with pytest.raises(ValueError):
        library.verify("the of")


def test_updates(library, sources):
    assert {r.status for r in library.ingest(str(sources / "novel.txt")).collect()} == {"skipped"}
    library.lock_metadata("notes", "Own Title", "Me")
    assert library.info("notes").first().title == "Own Title"
    library.remove("page") if library.table("books").filter("id = 'page'").count() else library.remove("a-page")
    assert not library.list_books().filter("id LIKE '%page'").count()


def test_reingest(spark, sources, tmp_path):
    settings = tmp_path / "own.toml"
    settings.write_text("[sections]\ngiant = 300\npart = 200\n")
    root = str(tmp_path / "lib")
    lib = Library(spark, root)
    lib.ingest(str(sources / "novel.txt"), str(sources / "light.epub"))
    lib.lock_metadata("novel", "Kept", "By Hand")
    again = Library(spark, root, config.load(str(settings)))
    assert {r.id for r in again.reingest().collect()} == {"novel", "a-keeper-the-lighthouse"}
    assert again.info("novel").first().title == "Kept" and again.list_chapters("novel").count() > 2
    assert {r.status for r in again.ingest(str(sources / "novel.txt")).collect()} == {"skipped"}
    settings.write_text("[sections]\nunknown = 1\n")
    with pytest.raises(ValueError):
        config.load(str(settings))


def test_streaming(spark, sources, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.txt").write_bytes((sources / "novel.txt").read_bytes() + b" more" * k)
        watch(spark, str(folder), lib, str(tmp_path / "seen"), once=True).awaitTermination(120)
    assert lib.table("books").count() == 2


def test_command_line(library, spark, capsys):
    base = ["--library", library.root]
    assert main([*base, "list"], spark) == 0
    assert main([*base, "get", "novel", "--chapters", "1"], spark) == 0
    assert main([*base, "find", "harbour"], spark) == 0
    assert main([*base, "find", "qqqqqq"], spark) == 1
    assert main([*base, "get", "novel", "--chapters", "x"], spark) == 2
    assert main([*base, "info", "nobody"], spark) == 1
    assert main(["nonsense"], spark) == 2
    assert "novel" in capsys.readouterr().out


def test_markdown(library):
    text = library.get_chapters("notes", spec="1-2")["text"]
    assert "\n\n- a link\n- b\n\n```\ncode\n```" in text and "> quoted words" in text


def test_hyphens_and_marks(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    (tmp_path / "a.txt").write_text("Chapter 1\n\n" + "A well-known harbour, they said, and well they might. " * 30 + "\n\nChapter 2\n\n" + "It was known as well as any other place by the sea. " * 30)
    lib.ingest(str(tmp_path / "a.txt"))
    at = lambda q: [r.n for r in lib.find(q).collect() if r.src == "chapter"]
    assert at("well-known") == [1] and at("harbour,") == [1] and at("«harbour»") == [1] and sorted(at("well known")) == [1, 2] and at("— !") == []


def test_index(spark, tmp_path, sources):
    """The stored index gives the scores of the texts, reads only its terms' partitions, and follows what changes."""
    from pyspark.sql import functions as F

    from leafmill.operators import search

    lib = Library(spark, str(tmp_path / "lib"))
    lib.ingest(str(sources / "novel.txt"), str(sources / "light.epub"))
    before = {p.name for p in lib._parts()}
    lib.ingest(str(sources / "notes.md"))
    assert before < {p.name for p in lib._parts()} and len(lib._parts()) == 2  # added to, not written anew
    lib.remove("novel")
    queries = [(0, "clocks striking"), (1, "lamp"), (2, "harbour")]
    direct = search.bm25(lib.table("chapters"), ["book", "n"], {"title": 5.0, "text": 1.0}, search.query_terms(spark, queries))
    indexed = lib._scored(queries)
    assert sorted(map(tuple, indexed.collect())) == sorted(map(tuple, direct.collect())) and not indexed.filter("book = 'novel'").count()
    assert lib.table("index").select("book", "n", "term").distinct().count() == lib.table("index").count()
    plan = indexed._jdf.queryExecution().toString()
    filters = [x for x in plan.split("\n") if "PartitionFilters" in x and "lead#" in x]
    assert filters and all("lead#" in x.split("PartitionFilters")[1] and "StringStartsWith(term" in x for x in filters), filters
    import leafmill.library as module

    module.MOST_PARTS, most = 3, module.MOST_PARTS
    try:
        lib.ingest(str(sources / "novel.txt"))
    finally:
        module.MOST_PARTS = most
    assert len(lib._parts()) == 1 and lib.table("books").count() == 3 and lib.table("outcomes").count() == 4
    assert [r.id for r in lib.find("harbour ships").collect()][0] == "novel"
    assert lib.table("sources").select(F.count("*")).first()[0] == 3


def test_stale_lock(spark, tmp_path):
    import os
    import time

    lib = Library(spark, str(tmp_path))
    (tmp_path / "writer.lock").write_text("dead writer")
    os.utime(tmp_path / "writer.lock", (time.time() - 7 * 3600,) * 2)
    with lib.lock():
        assert lib._held()
    assert not (tmp_path / "writer.lock").exists()


def test_tokens(spark, sources, tmp_path):
    import public_tokenizers
    import tiktoken

    from leafmill.functions import tokens
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.encoder(path)._mergeable_ranks, special_tokens={})
    texts = ["Hello, it's a well-known text.", None, "", "Жила была щука 12345  \n x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.counter(path)(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: len(enc.encode_ordinary(t or "")) for t in texts}
    settings = tmp_path / "own.toml"
    settings.write_text(f'[tokens]\nranks = "{path}"\n')
    lib = Library(spark, str(tmp_path / "lib"), config.load(str(settings)))
    lib.ingest(str(sources / "novel.txt"))
    rows = lib.table("chapters").collect()
    assert [r.tokens for r in rows] == [len(enc.encode_ordinary(r.text)) for r in rows]
