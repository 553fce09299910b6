"""Catalogue queries (A, J, G, O, U, SNK): conversations are books with turns as chapters, documents are books with sources as authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import catalog, render
from leafmill.plans.inline import Inline
from leafmill.plans.reads import turns
from leafmill.plans.texts import CUT_SQL, TOKENS_SQL, slug_sql
from leafmill.session import table

QUERIES, ORACLES = {}, {}


def add(name: str, duck: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, duck
        return f

    return keep


CHAPTERS = r"(SELECT conv_id AS book, turn AS n, role AS title, text, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS BIGINT) AS tokens FROM conversations)"
BOOKS = "(SELECT doc_id AS id, source || ' ' || CAST(doc_id AS VARCHAR) AS title, source AS author, sha256(text) AS sha256, sha256(text || ':2.4') AS cache_key, CASE WHEN n_chars < 400 THEN 'review' ELSE 'ok' END AS status, CAST(least(1.0, n_chars / CAST(2000 AS DOUBLE)) AS DOUBLE) AS score FROM documents)"


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).withColumnRenamed("role", "title")


def books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("author"),
        F.sha2("text", 256).alias("sha256"),
        F.sha2(F.concat("text", F.lit(":2.4")), 256).alias("cache_key"),
        F.when(F.col("n_chars") < 400, "review").otherwise("ok").alias("status"),
        F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("score"),
    )


@add("a01_catalog_listing", f"SELECT b.id, b.title, author, CAST(count(c.book) AS BIGINT) AS chapters, CAST(coalesce(sum(c.tokens), 0) AS BIGINT) AS total_tokens, status FROM {BOOKS} b LEFT JOIN {CHAPTERS} c ON b.id = c.book GROUP BY ALL")
def _(spark, d):
    return catalog.listing(books(spark, d), chapters(spark, d).drop("title"))


@add("a02_turn_listing", f"SELECT book, n, title, tokens, {CUT_SQL} AS summary FROM {CHAPTERS}")
def _(spark, d):
    return chapters(spark, d).select("book", "n", "title", "tokens", T.cut_300(F.col("text")).alias("summary"))


@add("a03_book_lookup", f"SELECT id, title, author, status FROM {BOOKS} WHERE id = 7")
def _(spark, d):
    return catalog.lookup(books(spark, d), 7).select("id", "title", "author", "status")


@add("a04_lookup_by_hash", f"SELECT b.id, f.id AS first_id, g.id AS first_cached FROM {BOOKS} b JOIN (SELECT sha256, min(id) AS id FROM {BOOKS} GROUP BY 1) f USING (sha256) JOIN (SELECT cache_key, min(id) AS id FROM {BOOKS} GROUP BY 1) g USING (cache_key)")
def _(spark, d):
    b = books(spark, d)
    sha = catalog.first_by(b, "sha256").withColumnRenamed("id", "first_id")
    key = catalog.first_by(b, "cache_key").withColumnRenamed("id", "first_cached")
    return b.join(sha, "sha256").join(key, "cache_key").select("id", "first_id", "first_cached")


@add("a05_info", f"SELECT id, title, status, score, coalesce('quality ' || CAST(quality AS VARCHAR), '') AS warnings FROM {BOOKS} b LEFT JOIN labels l ON b.id = l.doc_id")
def _(spark, d):
    reports = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("warnings"))
    return catalog.info(books(spark, d), reports)


QUERIES["a13_book_info"], ORACLES["a13_book_info"] = QUERIES["a05_info"], ORACLES["a05_info"]
SPEC = "3,1-2,3"


@add("a06_spec", "SELECT CAST(ord AS BIGINT) AS ord, CAST(n AS BIGINT) AS n FROM (VALUES (0, 3), (1, 1), (2, 2), (3, 3)) AS v(ord, n)")
def _(spark, d):
    return spark.range(1).select(F.posexplode(catalog.spec_column(SPEC)).alias("ord", "n")).select(F.col("ord").cast("bigint").alias("ord"), F.col("n").cast("bigint").alias("n"))


@add("a07_spec_read", f"WITH s AS (SELECT * FROM (VALUES (0, 3), (1, 1), (2, 2), (3, 3)) AS v(ord, n)) SELECT book, string_agg(regexp_replace(text, '\\n+$', ''), chr(10) || chr(10) ORDER BY ord) AS text, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS ords FROM {CHAPTERS} c JOIN s USING (n) GROUP BY book")
def _(spark, d):
    return catalog.read_spec(chapters(spark, d), SPEC)


@add("a09_default_budget", "WITH r AS (SELECT book, n, tokens, sum(tokens) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM " + CHAPTERS + ") SELECT book, CAST(count(*) FILTER (WHERE run <= 12000) AS BIGINT) AS chapters_read, CAST(coalesce(sum(tokens) FILTER (WHERE run <= 12000), 0) AS BIGINT) AS tokens_read, min(n) FILTER (WHERE run > 12000) AS next_from FROM r GROUP BY book")
def _(spark, d):
    from leafmill.plans.reads import budget_read

    return budget_read(turns(spark, d), 12000)


TRIGGERS = "(SELECT doc_id AS id, 1 AS ord, 'short text' AS trigger FROM documents WHERE n_chars < 400 UNION ALL SELECT doc_id, 2, 'low label' FROM labels WHERE quality = 0)"


@add("a11_review_listing", f"SELECT b.id, coalesce(string_agg(trigger, '; ' ORDER BY ord), '') AS triggers FROM {BOOKS} b LEFT JOIN {TRIGGERS} t ON b.id = t.id WHERE status = 'review' GROUP BY b.id")
def _(spark, d):
    short = table(spark, d, "documents").filter("n_chars < 400").select(F.col("doc_id").alias("id"), F.lit(1).alias("ord"), F.lit("short text").alias("trigger"))
    low = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"), F.lit(2), F.lit("low label"))
    return catalog.review_listing(books(spark, d), short.union(low))


@add("a12_doctor", f"SELECT id, status, round(score, 4) AS score, status = 'review' AS flagged FROM {BOOKS}")
def _(spark, d):
    return books(spark, d).select("id", "status", F.round("score", 4).alias("score"), (F.col("status") == "review").alias("flagged"))


@add("g01_totals", f"SELECT book, CAST(count(*) AS BIGINT) AS chapters, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM {CHAPTERS} GROUP BY book")
def _(spark, d):
    return chapters(spark, d).groupBy("book").agg(F.count("*").alias("chapters"), F.sum("tokens").alias("total_tokens"))


@add("g02_median", f"SELECT book, median(tokens) AS median_tokens FROM {CHAPTERS} GROUP BY book")
def _(spark, d):
    return chapters(spark, d).groupBy("book").agg(F.median("tokens").alias("median_tokens"))


@add("g16_control_total", r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0D\x0E-\x1F\x7F\x{0080}-\x{009F}]'))) AS BIGINT) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(T.control_count(F.col("text"))).alias("n"))


@add("j01_hits_to_books", f"SELECT h.book, n, title AS book_title, author FROM (SELECT conv_id AS book, turn AS n FROM conversations WHERE strpos(lower(text), 'the') > 0) h LEFT JOIN {BOOKS} b ON h.book = b.id")
def _(spark, d):
    hits = table(spark, d, "conversations").filter(F.instr(F.lower("text"), "the") > 0).select(F.col("conv_id").alias("book"), F.col("turn").alias("n"))
    return hits.join(books(spark, d), F.col("book") == F.col("id"), "left").select("book", "n", F.col("title").alias("book_title"), "author")


@add("j02_deleted", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return catalog.deleted(books(spark, d), table(spark, d, "labels").withColumnRenamed("doc_id", "id"))


KNOWN = "(SELECT doc_id AS id, sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(quality AS VARCHAR)) AS fingerprint FROM labels)"
CURRENT = "(SELECT doc_id AS id, sha256(CAST(doc_id AS VARCHAR) || ':' || CASE WHEN lang = 'en' THEN '1' ELSE '0' END) AS fingerprint FROM documents)"


@add("j03_changed", f"SELECT c.id, CASE WHEN k.fingerprint IS NULL THEN 'new' ELSE 'changed' END AS what FROM {CURRENT} c LEFT JOIN {KNOWN} k USING (id) WHERE c.fingerprint IS DISTINCT FROM k.fingerprint")
def _(spark, d):
    mark = lambda c: F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), c), 256).alias("fingerprint")
    known = table(spark, d, "labels").withColumnRenamed("doc_id", "id").select("id", mark(F.col("quality").cast("string")))
    current = table(spark, d, "documents").withColumnRenamed("doc_id", "id").select("id", mark(F.when(F.col("lang") == "en", "1").otherwise("0")))
    return catalog.changed(current, known)


@add("j04_candidates", f"WITH c AS (SELECT book, max(n) AS n FROM {CHAPTERS} GROUP BY book) SELECT book, n, tokens FROM c JOIN {CHAPTERS} USING (book, n)")
def _(spark, d):
    c = chapters(spark, d)
    return c.groupBy("book").agg(F.max("n").alias("n")).join(c, ["book", "n"]).select("book", "n", "tokens")


@add("j05_ordered_lookup", f"WITH s AS (SELECT * FROM (VALUES (0, 3), (1, 1), (2, 2), (3, 3)) AS v(ord, n)) SELECT book, CAST(ord AS BIGINT) AS ord, n, tokens FROM s JOIN {CHAPTERS} USING (n)")
def _(spark, d):
    asked = spark.range(1).select(F.posexplode(catalog.spec_column(SPEC)).alias("ord", "n")).select(F.col("ord").cast("bigint").alias("ord"), F.col("n").cast("bigint").alias("n"))
    return chapters(spark, d).join(F.broadcast(asked), "n").select("book", "ord", "n", "tokens")  # a spec of a few numbers


@add("j08_nav_titles", "SELECT p.page_id, n.titles, n.first_title FROM pages p LEFT JOIN (SELECT source, count(*) AS titles, min(doc_id) AS first_title FROM documents GROUP BY source) n ON n.source = 'src' || CAST(p.page_id AS VARCHAR)")
def _(spark, d):
    nav = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("titles"), F.min("doc_id").alias("first_title"))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id").cast("string")).alias("source"))
    return pages.join(nav, "source", "left").select("page_id", "titles", "first_title")


ID_SOURCES = f"(SELECT sha256(text) AS sha256, {slug_sql('text', 60)} AS slug FROM documents)"
ID_BOOKS = f"(SELECT {slug_sql('text', 60)} AS id, min(sha256(text)) AS sha256 FROM documents d JOIN labels l USING (doc_id) GROUP BY 1)"


@add("j10_identity", f"WITH same AS (SELECT sha256, min(id) AS same_id FROM {ID_BOOKS} GROUP BY 1) SELECT s.sha256, s.slug, CASE WHEN same_id IS NOT NULL THEN same_id WHEN b.sha256 IS NULL OR b.sha256 = s.sha256 THEN s.slug ELSE s.slug || '-' || left(s.sha256, 6) END AS id FROM {ID_SOURCES} s LEFT JOIN same USING (sha256) LEFT JOIN {ID_BOOKS} b ON b.id = s.slug")
def _(spark, d):
    docs = table(spark, d, "documents")
    named = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), T.slug(F.col("text"), 60).alias("slug"))
    known = named.join(table(spark, d, "labels"), "doc_id").groupBy(F.col("slug").alias("id")).agg(F.min("sha256").alias("sha256"))
    return catalog.identities(named.select("sha256", "slug"), known)


@add("s03_fingerprint", f"SELECT book, sha256(string_agg(CAST(n AS VARCHAR) || ':' || sha256(text), '|' ORDER BY n)) AS fingerprint FROM {CHAPTERS} GROUP BY book")
def _(spark, d):
    return catalog.fingerprints(chapters(spark, d))


@add("o05_match_order", "SELECT doc_id, n_chars FROM documents ORDER BY -n_chars, doc_id LIMIT 25")
def _(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@add("o06_best_per_book", f"SELECT book, n, tokens FROM {CHAPTERS} QUALIFY row_number() OVER (PARTITION BY book ORDER BY tokens DESC, n) = 1")
def _(spark, d):
    best = chapters(spark, d).groupBy("book").agg(F.max_by(F.struct("n", "tokens"), F.struct("tokens", -F.col("n"))).alias("b"))
    return best.select("book", "b.n", "b.tokens")


@add("u01_difference", "SELECT lang, source FROM documents EXCEPT SELECT lang, source FROM documents d JOIN labels USING (doc_id)")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("lang", "source").distinct().exceptAll(docs.join(table(spark, d, "labels"), "doc_id").select("lang", "source").distinct())


@add("u02_distinct_ids", "SELECT DISTINCT source FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("source").distinct()


@add("u03_concatenation", "SELECT 'page' AS src, page_id AS id FROM pages UNION ALL SELECT 'doc', doc_id FROM documents")
def _(spark, d):
    return table(spark, d, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id")).unionByName(table(spark, d, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id")))


QUERIES["u04_stop_words"] = lambda spark, d: table(spark, d, "benchmark").select("item_id", F.array_join(T.significant(F.transform(T.tokens(F.col("text")), T.token_canon)), " ").alias("words"))
ORACLES["u04_stop_words"] = f"SELECT item_id, array_to_string(list_filter(list_transform({TOKENS_SQL}, lambda x: translate(replace(lower(x), 'ß', 'ss'), 'ё’‘′‐‑−', 'е''''''---')), lambda x: x NOT IN ({', '.join(repr(w) for w in sorted(T.STOP_WORDS))})), ' ') AS words FROM benchmark"

BLOCKS = Inline(
    "book int, n int, title string, pos int, kind string, level int, text string",
    [
        (1, 1, "Intro", 0, "meta", None, "front: matter"),
        (1, 1, "Intro", 1, "para", None, "First paragraph.  \nwith a line"),
        (1, 1, "Intro", 2, "list_item", None, "one"),
        (1, 1, "Intro", 3, "list_item", None, "two"),
        (1, 1, "Intro", 4, "footnote", None, "1. a note"),
        (1, 1, "Intro", 5, "heading", 1, "Inner"),
        (1, 1, "Intro", 6, "quote", None, "said\nsomeone"),
        (1, 2, "Data", 0, "table", None, "a\tb|c\n1\t2"),
        (1, 2, "Data", 1, "code", None, "x = ```y```"),
        (1, 2, "Data", 2, "list_item", None, "three"),
        (1, 2, "Data", 3, "para", None, "Between."),
        (1, 2, "Data", 4, "list_item", None, "four"),
        (2, 1, "Deep", 0, "heading", 7, "Very deep"),
        (2, 2, "Only notes", 0, "footnote", None, "2. lonely"),
    ],
)
_table = "(SELECT string_agg(CASE WHEN k = 2 THEN r || chr(10) || '|' || repeat('---|', len(string_split(string_split(text, chr(10))[1], chr(9)))) ELSE r END, chr(10) ORDER BY k) FROM (SELECT k, '| ' || replace(replace(string_split(text, chr(10))[k - 1], '|', chr(92) || '|'), chr(9), ' | ') || ' |' AS r FROM (SELECT unnest(range(2, 2 + len(string_split(text, chr(10))))) AS k)))"
_fence = "repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0)))"


@add("snk6_table", f"SELECT pos, {_table} AS md FROM {BLOCKS.sql} WHERE kind = 'table'")
def _(spark, d):
    return BLOCKS.df(spark).filter("kind = 'table'").select("pos", render.table_md(F.col("text")).alias("md"))


@add("snk7_code", f"SELECT pos, {_fence} || chr(10) || text || chr(10) || {_fence} AS md FROM {BLOCKS.sql} WHERE kind = 'code'")
def _(spark, d):
    return BLOCKS.df(spark).filter("kind = 'code'").select("pos", render.code_md(F.col("text")).alias("md"))


QUERIES["snk8_file_name"] = lambda spark, d: table(spark, d, "documents").select(
    "doc_id",
    render.file_name(F.pmod("doc_id", F.lit(1000)), F.when(F.col("lang") == "en", F.concat(F.col("text"), F.lit(" (2/3)"))).otherwise(F.col("text")), F.when(F.col("lang") == "en", 2)).alias("name"),
)
ORACLES["snk8_file_name"] = f"SELECT doc_id, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '-' || {slug_sql('text', 50)} || CASE WHEN lang = 'en' THEN '-p2' ELSE '' END || '.md' AS name FROM documents"

_body = f"CASE kind WHEN 'heading' THEN repeat('#', least(6, coalesce(level, 1) + 1)) || ' ' || text WHEN 'list_item' THEN '- ' || text WHEN 'quote' THEN '> ' || replace(text, chr(10), chr(10) || '> ') WHEN 'table' THEN {_table} WHEN 'code' THEN {_fence} || chr(10) || text || chr(10) || {_fence} ELSE text END"
ORACLES["snk5_render"] = f"""
WITH b AS (SELECT * FROM {BLOCKS.sql}),
m AS (SELECT book, n, pos, kind, {_body} AS md FROM b WHERE kind NOT IN ('meta', 'footnote')),
g AS (SELECT *, CASE WHEN kind = 'list_item' AND lag(kind) OVER (PARTITION BY book, n ORDER BY pos) = 'list_item' THEN 0 ELSE 1 END AS s FROM m),
r AS (SELECT *, sum(s) OVER (PARTITION BY book, n ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g),
p AS (SELECT book, n, run, string_agg(md, chr(10) ORDER BY pos) AS md FROM r GROUP BY ALL),
q AS (SELECT book, n, string_agg(md, chr(10) || chr(10) ORDER BY run) AS md FROM p GROUP BY ALL),
f AS (SELECT book, n, string_agg(text, chr(10) ORDER BY pos) AS notes FROM b WHERE kind = 'footnote' GROUP BY ALL),
h AS (SELECT book, n, min(title) AS title FROM b GROUP BY ALL)
SELECT h.book, h.n, regexp_replace('# ' || title || coalesce(chr(10) || chr(10) || md, '') || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || notes, ''), '[ \\t]+\\n', chr(10), 'g') || chr(10) AS md
FROM h LEFT JOIN q USING (book, n) LEFT JOIN f USING (book, n)"""
QUERIES["snk5_render"] = lambda spark, d: render.chapter_md(BLOCKS.df(spark))


@add("snk9_index", ORACLES["a01_catalog_listing"])
def _(spark, d):
    return catalog.listing(books(spark, d), chapters(spark, d).drop("title")).orderBy("id")


@add("snk10_remove", f"SELECT b.id, title FROM {BOOKS} b WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    gone = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return books(spark, d).join(gone, "id", "left_anti").select("id", "title")


@add("w04_running_sum", f"SELECT book, n, CAST(sum(tokens) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM {CHAPTERS}")
def _(spark, d):
    return chapters(spark, d).select("book", "n", F.sum("tokens").over(Window.partitionBy("book").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


@add("w12_renumber", f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY n) AS n, tokens FROM {CHAPTERS} WHERE tokens >= 30")
def _(spark, d):
    return catalog.renumbered(chapters(spark, d).filter("tokens >= 30")).select("book", "n", "tokens")
