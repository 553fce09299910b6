"""Source and pipeline queries (SRC, E, SNK4): pages and documents as files."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import config
from leafmill.functions import text as T
from leafmill.functions.batches import pieces
from leafmill.library import VERSION, Library
from leafmill.operators import catalog
from leafmill.plans.inline import Inline
from leafmill.plans.texts import CONTROL_SQL, count_sql
from leafmill.session import shared_dir, table
from leafmill.sources import decode, detect, extract

QUERIES, ORACLES = {}, {}


def add(name: str, duck: str | None = None, *others: str):
    def keep(f):
        for n in (name, *others):
            QUERIES[n] = f
            if duck:
                ORACLES[n] = duck
        return f

    return keep


LEAD = r"(?s)^(\s+|<\?.*?\?>|<!--.*?-->)+"


def as_files(df: DataFrame, key: str, text: str, suffix: str) -> DataFrame:
    return df.select(F.concat(F.lit("in/"), F.col(key).cast("string"), F.lit(suffix)).alias("path"), F.encode(text, "UTF-8").alias("content"))


def mapped(f: Callable, kind: str) -> Callable:
    """A function of one value as an Arrow function of a column."""
    return F.pandas_udf(lambda x: x.map(f), kind)


@add("src03_first_tag", rf"SELECT page_id, lower(regexp_extract(regexp_replace(html, '{LEAD}', ''), '(?i)^<(!doctype\s+)?([a-z][a-z0-9:._-]*)', 2)) AS tag FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", mapped(lambda x: detect.first_tag((x or "").encode()), "string")("html").alias("tag"))


@add("src01_detect", rf"SELECT 'in/' || page_id || '.html' AS path, CASE WHEN lower(regexp_extract(regexp_replace(html, '{LEAD}', ''), '(?i)^<(!doctype\s+)?([a-z][a-z0-9:._-]*)', 2)) IN ('html', 'head', 'body') THEN 'html' END AS fmt FROM pages")
def _(spark, d):
    return extract.extract(as_files(table(spark, d, "pages", spread=True), "page_id", "html", ".html")).select("path", "fmt")


@add("src04_texty", f"SELECT doc_id, {count_sql('text', '[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B' + chr(92) + 'x0E-' + chr(92) + 'x1F' + chr(92) + 'x7F' + chr(92) + 'x{0080}-' + chr(92) + 'x{009F}]')} * 100 < greatest(1, length(text)) AS texty FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", mapped(decode.texty, "boolean")("text").alias("texty"))


@add("src05_size_limit", "SELECT 'in/' || doc_id || '.txt' AS path FROM documents WHERE strlen(text) <= 4096")
def _(spark, d):
    read = extract.extract(as_files(table(spark, d, "documents", spread=True), "doc_id", "text", ".txt"), most=4096)
    return read.filter(~F.contains(F.coalesce("error", F.lit("")), F.lit("size limit"))).select("path")


@add("src07_txt_paragraphs", rf"SELECT 'in/' || doc_id || '.txt' AS path, CAST(len(list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda p: regexp_matches(p, '[^ \t\n\r]'))) AS BIGINT) AS n FROM (SELECT doc_id, text || chr(10) || ' ' || chr(10) || 'second' || chr(10) || 'part' AS text FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents", spread=True).withColumn("text", F.concat("text", F.lit("\n \nsecond\npart")))
    return extract.extract(as_files(docs, "doc_id", "text", ".txt")).select("path", F.size("blocks").cast("bigint").alias("n"))


@add("src19_html_blocks", None, "src20_html_main", "src24_markup", "src06_dispatch")
def _(spark, d):
    read = extract.extract(as_files(table(spark, d, "pages", spread=True), "page_id", "html", ".html"))
    return read.select("path", "fmt", "title", "lang", F.explode("blocks").alias("b")).groupBy("path", "fmt", "title", "lang").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("b.kind") == "heading").alias("headings"), F.sum(F.length("b.text")).alias("chars"))


@add("g12_unknown_tags", "SELECT tag, CAST(sum(n * (length(html) - length(replace(html, '</article>', ''))) // 10) AS BIGINT) AS n FROM pages, (VALUES ('odd', 2), ('x-y', 1)) AS v(tag, n) GROUP BY tag")
def _(spark, d):
    """Tags that are not of HTML, put into the article of each page, are counted."""
    pages = table(spark, d, "pages", spread=True).withColumn("html", F.replace("html", F.lit("</article>"), F.lit("<odd>a</odd><odd>b</odd><x-y>c</x-y></article>")))
    found = extract.extract(as_files(pages, "page_id", "html", ".html")).select(F.explode("unknown_tags").alias("tag", "n"))
    return found.groupBy("tag").agg(F.sum("n").alias("n"))


@add("src09_md_blocks")
def _(spark, d):
    read = extract.extract(as_files(table(spark, d, "documents", spread=True), "doc_id", "text", ".md"))
    return read.select("path", "fmt", "status", F.explode("blocks").alias("b")).groupBy("path", "fmt", "status", "b.kind").agg(F.count("*").alias("n"))


@add("src08_decode")
def _(spark, d):
    docs = table(spark, d, "documents")
    read = extract.extract(docs.select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")).alias("content")))
    return read.select("path", "status", F.sha2("ref_text", 256).alias("sha"))


def epub_of(text: str, first: str, second: str) -> bytes:
    """A book of two files without headings; its table of contents names them."""
    page = f"<html><body><p>{escape(text or '')}</p></body></html>"
    point = lambda title, href: f"<navPoint><navLabel><text>{escape(title)}</text></navLabel><content src='{href}'/></navPoint>"
    return zipped({
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfile full-path="O/b.opf"/></container>',
        "O/b.opf": '<package><metadata><title>B</title></metadata><manifest><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="x" href="x.html"/><item id="y" href="y.html"/></manifest><spine><itemref idref="x"/><itemref idref="y"/></spine></package>',
        "O/t.ncx": f"<ncx><navMap>{point(first, 'x.html')}{point(second, 'y.html#p')}{point('again', 'y.html')}</navMap></ncx>", "O/x.html": page, "O/y.html": page,
    })


@add("src15_nav_titles", "SELECT 'in/' || doc_id || '.epub' AS path, source || '|' || lang AS titles FROM documents", "src16_file_titles")
def _(spark, d):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            made = [epub_of(*(x.as_py() for x in row)) for row in zip(*(b.column(c) for c in ("text", "source", "lang")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("path")
    books = table(spark, d, "documents", spread=True).select(path, "text", "source", "lang").mapInArrow(built, "path string, content binary")
    heads = F.filter("blocks", lambda b: b["kind"] == "heading")
    return extract.extract(books).select("path", F.array_join(F.transform(heads, lambda b: b["text"]), "|").alias("titles"))


JSON = Inline("id int, raw string", [(1, '{"id": "a", "n": 2}'), (2, '{"id": "b"'), (3, '{"id": "c", "n": 5}'), (4, "nonsense"), (5, '{"id": "e", "n": 0}')])


def parsed(spark: SparkSession) -> DataFrame:
    return JSON.df(spark).withColumn("j", F.from_json("raw", "id string, n int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


@add("src26_library_scan", f"SELECT json_extract_string(raw, '$.id') AS book, CAST(json_extract_string(raw, '$.n') AS INTEGER) AS n FROM {JSON.sql} WHERE json_valid(raw)")
def _(spark, d):
    return parsed(spark).filter("j._bad IS NULL").select(F.col("j.id").alias("book"), "j.n")


@add("src27_broken", f"SELECT id FROM {JSON.sql} WHERE NOT json_valid(raw)")
def _(spark, d):
    return parsed(spark).filter("j._bad IS NOT NULL").select("id")


@add("snk4_canonical_json", """SELECT doc_id, '{"author":"' || source || '","id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}' AS json FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("source").alias("author"), F.col("doc_id").alias("id"), "lang", "n_chars")).alias("json"))


@add("e03_cache_skip", f"SELECT doc_id, sha256(text) || ':{VERSION}:{config.digest(config.load())}' AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def _(spark, d):
    lib = Library(spark, "unused")
    docs = table(spark, d, "documents").select("doc_id", lib.cache_key(F.sha2("text", 256)).alias("key"))
    return catalog.fresh(docs, docs.join(table(spark, d, "labels"), "doc_id").select("key")).select("doc_id", "key")


@add("e08_config_hash", f"SELECT sha256('{json.dumps(config.load(), sort_keys=True)}') AS hash")
def _(spark, d):
    return spark.createDataFrame([(config.digest(config.load()),)], "hash string")


@add("e02_ingest", None)
def _(spark, d):
    """All documents through the whole pipeline, into a library of their own."""
    lib = Library(spark, f"{shared_dir(spark)}/library-{uuid.uuid4().hex}")
    return lib.ingest_files(as_files(table(spark, d, "documents", spread=True).withColumn("text", F.concat(F.lit("Chapter 1\n\n"), "text")), "doc_id", "text", ".txt")).select("path", "id", "status", "score")


FB2 = (
    "<FictionBook><description><title-info><author><first-name>Doc</first-name><last-name>Writer</last-name></author><book-title>Book %d</book-title><lang>%s</lang></title-info></description>"
    "<body><section><title><p>One</p></title><p>%s<a type='note'>1</a></p></section></body><body name='notes'><section><title><p>1</p></title><p>note</p></section></body></FictionBook>"
)


@add("src10_fb2", None, "src11_fb2_notes", "src12_fb2_metadata")
def _(spark, d):
    docs = table(spark, d, "documents", spread=True)
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    read = extract.extract(as_files(docs.withColumn("x", F.format_string(FB2, "doc_id", "lang", safe)), "doc_id", "x", ".fb2"))
    return read.select("path", "status", "title", "author", "lang", F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"))


def zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def containers() -> list[tuple[str, bytearray]]:
    """One small book in each container format, and two that can't be read."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    files = {
        "a.epub": {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfile full-path="b.opf"/></container>', "b.opf": '<package><metadata><title>B</title></metadata><manifest><item id="x" href="x.html"/><item id="y" href="y.html"/></manifest><spine><itemref idref="x"/><itemref idref="y"/></spine></package>', "x.html": "<h1>X</h1><p>first</p>", "y.html": "<h1>Y</h1><p>second</p>"},
        "b.docx": {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'},
        "c.zip": {"book.fb2": "<FictionBook><body><section><title><p>T</p></title><p>p</p></section></body></FictionBook>"},
        "two.zip": {"1.fb2": "<FictionBook/>", "2.fb2": "<FictionBook/>"},
        "bomb.epub": {"mimetype": "application/epub+zip", "big": "0" * 20_000_000},
    }
    return [(name, bytearray(zipped(entries))) for name, entries in files.items()]


@add("src02_zip_kinds", None, "src13_zipped_fb2", "src14_epub", "src17_epub_files", "src18_docx", "src23_zip_guard", "src25_error_rows")
def _(spark, d):
    read = extract.extract(spark.createDataFrame(containers(), "path string, content binary"))
    return read.select("path", "fmt", "status", F.substring_index("error", ":", 1).alias("error"), F.size("blocks").alias("n"))


@add("n03_controls", f"SELECT doc_id, {count_sql('text', CONTROL_SQL)} AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.control_count(F.col("text")).alias("n"))
