"""Page layout queries (P, G7-G10, G17, W7-W10, W13, J7, SRC21-22, M5) over a small inline document of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import pdf_layout as L
from leafmill.plans.inline import Inline
from leafmill.plans.texts import collapse_sql, fold_sql

QUERIES, ORACLES = {}, {}


def add(name: str, duck: str | None = None, *others: str):
    def keep(f):
        for n in (name, *others):
            QUERIES[n] = f
            if duck:
                ORACLES[n] = duck
        return f

    return keep


def _rows() -> list[tuple]:
    """Six pages with a running head, page numbers, headings by size and bold type, columns, notes and a broken layer."""
    rows = []

    def put(doc: int, page: int, text: str, size: float, box: tuple, bold: bool = False, lines: int = 1) -> None:
        pos = sum(1 for r in rows if r[0] == doc)
        rows.append((doc, page, pos, text, size, bold, lines, *map(float, box), 600.0, 800.0, "para", None))

    for page in range(1, 7):
        put(1, page, f"Travel Notes  {page}", 9.0, (50, 20, 300, 40))
        if page in (1, 4):
            put(1, page, f"Part {page}", 18.0, (50, 100, 300, 130))
        if page in (2, 5):
            put(1, page, "The Road", 14.0, (50, 100, 300, 120))
        put(1, page, "Body text that fills the page and ends here." if page % 2 else "body text that goes on over the page and", 10.0, (50, 150, 550, 400), lines=8)
        if page == 3:
            put(1, page, "Bold Words", 10.0, (50, 410, 200, 425), bold=True)
            put(1, page, "More of it, and more.", 10.0, (50, 430, 550, 500), lines=2)
        if page == 5:
            put(1, page, "1 a note at the foot", 8.0, (50, 650, 550, 690))
        put(1, page, f"— {page} —", 9.0, (280, 770, 320, 790))
    for page in (1, 2):
        for k, (x, y) in enumerate([(50, 100), (330, 100), (50, 300), (330, 300)]):
            put(2, page, f"column block {page}.{k} with words", 10.0, (x, y, x + 200, y + 150), lines=5)
    for k, x in enumerate((20, 220, 420)):
        put(3, 1, f"three {k}", 10.0, (x, 200, x + 120, 300))
        put(3, 1, f"more {k}", 10.0, (x, 320, x + 120, 400))
    put(3, 2, "bad �� layer", 10.0, (20, 200, 500, 300))
    put(3, 2, "Chapter 2", 10.0, (20, 320, 500, 340))
    return rows


PAGES = Inline("doc int, page int, pos int, text string, size double, bold boolean, n_lines int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, kind string, level int", _rows())
BODY = f"(SELECT doc, arg_max(size, chars - size / 1000) AS body FROM (SELECT doc, size, sum(length(text)) AS chars FROM {PAGES.sql} GROUP BY ALL) GROUP BY doc)"
ZONE = "CASE WHEN (y0 + y1) / 2 < 0.10 * page_h THEN 'top' WHEN (y0 + y1) / 2 > 0.90 * page_h THEN 'bottom' END"
NUMBER = r"(SELECT c <> '' AND length(c) <= 4 AND regexp_matches(c, '^([0-9]+|[ivxlcdmIVXLCDM]+)$') FROM (SELECT regexp_replace(text, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g') AS c))"
SIGNATURE = fold_sql(collapse_sql("regexp_replace(text, '[0-9]+', '#', 'g')"))
CUTS = f"(SELECT doc, page, count(*) FILTER (WHERE cut) AS cuts, min((x + nx) / 2) FILTER (WHERE cut) AS split_x FROM (SELECT *, nx - x >= 0.15 * page_w AND k >= 0.25 * n AND n - k >= 0.25 * n AS cut FROM (SELECT doc, page, page_w, (x0 + x1) / 2 AS x, lead((x0 + x1) / 2) OVER o AS nx, row_number() OVER o AS k, count(*) OVER (PARTITION BY doc, page) AS n FROM {PAGES.sql} WHERE ({ZONE}) IS NULL WINDOW o AS (PARTITION BY doc, page ORDER BY (x0 + x1) / 2))) GROUP BY doc, page)"
HEADERS = f"(SELECT doc, zone, signature FROM (SELECT doc, {ZONE} AS zone, {SIGNATURE} AS signature, count(DISTINCT page) AS n FROM {PAGES.sql} GROUP BY ALL) m JOIN (SELECT doc, count(DISTINCT page) AS pages FROM {PAGES.sql} GROUP BY doc) p USING (doc) WHERE zone IS NOT NULL AND n >= greatest(5, ceil(0.30 * pages)))"
SIZES = f"(SELECT doc, size, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS BIGINT) AS size_level FROM (SELECT doc, size, body, count(*) AS n FROM {PAGES.sql} JOIN {BODY} USING (doc) GROUP BY ALL) WHERE size >= 1.15 * body AND n >= 2 QUALIFY size_level <= 3)"


def pages(spark: SparkSession) -> DataFrame:
    return PAGES.df(spark)


def shown(b: DataFrame) -> DataFrame:
    return b.select("doc", "page", "pos", "text")


@add("g07_body_size", f"SELECT doc, body FROM {BODY}")
def _(spark, d):
    return L.body_sizes(pages(spark))


@add("g08_heading_sizes", f"SELECT doc, size, size_level FROM {SIZES}")
def _(spark, d):
    return L.heading_sizes(pages(spark)).select("doc", "size", F.col("size_level").cast("bigint").alias("size_level"))


@add("g09_running_headers", f"SELECT doc, zone, signature FROM {HEADERS}")
def _(spark, d):
    return L.running_headers(pages(spark))


@add("g10_defect_ratio", rf"SELECT doc, page, round(CAST(bad AS DOUBLE) / chars, 4) AS share FROM (SELECT doc, page, sum(len(regexp_extract_all(text, '[\x{{FFFD}}\p{{Co}}]'))) AS bad, sum(length(text)) AS chars FROM {PAGES.sql} GROUP BY ALL) WHERE bad > 0.02 * chars", "p4_defect_pages")
def _(spark, d):
    return L.defect_pages(pages(spark))


@add("g17_wide_page_share", f"SELECT doc, CAST(count(*) FILTER (WHERE cuts >= 2) AS DOUBLE) / count(*) > 0.10 AS flagged FROM {CUTS} GROUP BY doc")
def _(spark, d):
    return L.column_cuts(pages(spark)).groupBy("doc").agg((F.count_if(F.col("cuts") >= 2) > L.WIDE_PAGES * F.count("*")).alias("flagged"))


@add("w07_column_gaps", f"SELECT doc, page, cuts, split_x FROM {CUTS}")
def _(spark, d):
    return L.column_cuts(pages(spark))


@add("w13_page_runs", f"SELECT doc, page, CAST(count(*) AS BIGINT) AS n FROM {PAGES.sql} GROUP BY ALL")
def _(spark, d):
    return pages(spark).groupBy("doc", "page").agg(F.count("*").alias("n"))


@add("p1_page_numbers", f"SELECT doc, page, pos, text FROM {PAGES.sql} JOIN {BODY} USING (doc) WHERE NOT (({ZONE}) IS NOT NULL AND {NUMBER} AND size < 1.15 * body)")
def _(spark, d):
    return shown(L.without_page_numbers(pages(spark)))


@add("p2_headers_footers", f"SELECT doc, page, pos, text FROM {PAGES.sql} WHERE (doc, coalesce({ZONE}, ''), {SIGNATURE}) NOT IN (SELECT (doc, zone, signature) FROM {HEADERS})", "j07_header_blocks")
def _(spark, d):
    return shown(L.without_headers(pages(spark)))


_ordered = f"(SELECT p.*, split_x, ({ZONE}) IS NULL AND cuts = 1 AS is_body FROM {PAGES.sql} p LEFT JOIN {CUTS} USING (doc, page))"


@add("p3_reading_order", f"WITH b AS (SELECT * FROM {_ordered}), r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN (x0 + x1) / 2 >= split_x THEN 1 ELSE 0 END, y0, x0) AS place, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS slot FROM b WHERE is_body) SELECT doc, page, pos, text FROM b WHERE is_body IS NOT TRUE UNION ALL SELECT r.doc, r.page, s.pos, r.text FROM r JOIN r s ON r.doc = s.doc AND r.page = s.page AND r.place = s.slot", "w08_slots", "o07_column_sort")
def _(spark, d):
    return shown(L.in_reading_order(pages(spark)))


@add("p5_headings")
def _(spark, d):
    return L.with_headings(pages(spark)).filter("kind = 'heading'").select("doc", "page", "text", "level")


QUERIES["w10_heading_merge"] = QUERIES["p5_headings"]


@add("p6_cross_page")
def _(spark, d):
    b = L.without_headers(L.without_page_numbers(pages(spark)))
    return shown(L.across_pages(b))


QUERIES["w09_adjacent_merge"] = QUERIES["p6_cross_page"]


@add("p7_footnotes", f"SELECT doc, page, text FROM {PAGES.sql} JOIN {BODY} USING (doc) WHERE size < 0.85 * body AND y0 >= 0.67 * page_h AND regexp_matches(text, '^[0-9*]')")
def _(spark, d):
    return L.with_footnotes(pages(spark)).filter("kind = 'footnote'").select("doc", "page", "text")


@add("p0_layout")
def _(spark, d):
    return L.layout(pages(spark)).select("doc", "page", "pos", "kind", "level", "text")


SPANS = Inline(
    "doc int, page int, block int, line int, span int, text string, size double, bold boolean",
    [(1, 1, 0, 0, 0, "Title ", 14.2, True), (1, 1, 0, 0, 1, "words", 14.2, True), (1, 1, 1, 0, 0, "plain text", 10.1, False), (1, 1, 1, 1, 0, "bold", 10.1, True), (1, 1, 2, 0, 0, "even", 9.0, False), (1, 1, 2, 0, 1, "size", 11.0, False), (2, 1, 0, 0, 0, "x", 10.0, False), (2, 2, 0, 0, 0, "scan", 10.0, False)],
)


@add("src21_pdf_blocks", f"WITH s AS (SELECT * FROM {SPANS.sql}), z AS (SELECT doc, page, block, round_even(size * 2, 0) / 2 AS size, sum(length(text)) AS chars FROM s GROUP BY ALL), m AS (SELECT doc, page, block, arg_max(size, chars - size / 1000) AS size FROM z GROUP BY ALL), l AS (SELECT doc, page, block, line, string_agg(text, '' ORDER BY span) AS text, sum(length(text)) AS chars, coalesce(sum(length(text)) FILTER (WHERE bold), 0) AS b FROM s GROUP BY ALL) SELECT doc, page, block, string_agg(text, chr(10) ORDER BY line) AS text, sum(b) >= 0.60 * sum(chars) AS bold, CAST(count(*) AS BIGINT) AS n_lines, max(m.size) AS size FROM l JOIN m USING (doc, page, block) GROUP BY ALL")
def _(spark, d):
    return L.blocks_of_spans(SPANS.df(spark))


@add("src22_scan_detection", f"SELECT doc, median(chars) AS median_chars FROM (SELECT doc, page, sum(length(text)) AS chars FROM {SPANS.sql} GROUP BY ALL) GROUP BY doc HAVING median(chars) < 20")
def _(spark, d):
    return L.scanned(SPANS.df(spark))
