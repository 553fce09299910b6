"""Search and verification queries (S, V, O, J9, G15, M8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import search, verify
from leafmill.plans.texts import CANON_SQL, STOP_SQL
from leafmill.session import stored, table

QUERIES, ORACLES = {}, {}


def add(name: str, duck: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if duck:
            ORACLES[name] = duck
        return f

    return keep


#: Queries: words as they are typed. The third has no document with both of its words.
ASKED = [(1, "licensed under"), (2, "theré anin"), (3, "creative zuverein"), (4, "released"), (5, "général queue")]
_rows = ", ".join(f"({q}, {i}, '{w}', {len(text.split())})" for q, text in ASKED for i, w in enumerate(text.split()))
FOLD = lambda x: f"translate(lower({x}), '{search.ACCENTED}', '{search.PLAIN}')"
TERMS = f"(SELECT qid, idx, {FOLD('word')} AS term, n_terms FROM (VALUES {_rows}) AS v(qid, idx, word, n_terms))"
LIST = lambda c: rf"regexp_extract_all({FOLD(c)}, '[\p{{L}}\p{{N}}]+')"
CHAPTER_ROWS = "(SELECT doc_id AS book_id, source AS title, text FROM documents)"
BOOK_ROWS = "(SELECT doc_id AS book_id, text AS title, source AS author FROM documents)"


def bm25_sql(rows: str, weights: dict[str, float]) -> str:
    post = " UNION ALL ".join(f"SELECT book_id, CAST({w} AS DOUBLE) AS w, unnest({LIST(c)}) AS token FROM {rows}" for c, w in weights.items())
    size = " + ".join(f"len({LIST(c)})" for c in weights)
    return f"""(WITH q AS (SELECT * FROM {TERMS}), p AS ({post}),
h AS (SELECT qid, idx, n_terms, book_id, sum(w) AS f FROM p JOIN q ON starts_with(token, term) GROUP BY ALL),
d AS (SELECT book_id, CAST({size} AS DOUBLE) AS len FROM {rows}), s AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM d),
n AS (SELECT qid, idx, count(*) AS df FROM h GROUP BY ALL),
i AS (SELECT *, ln((n_docs - df + 0.5) / CAST(df + 0.5 AS DOUBLE)) AS raw FROM h JOIN n USING (qid, idx) JOIN d USING (book_id) CROSS JOIN s)
SELECT qid, n_terms, book_id, round(sum(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))), 9) AS score, count(*) AS matched FROM i GROUP BY ALL)"""


CHAPTER_WEIGHTS, BOOK_WEIGHTS = {"title": 5.0, "text": 1.0}, {"title": 2.0, "author": 1.0}
S_CHAPTERS, S_BOOKS = bm25_sql(CHAPTER_ROWS, CHAPTER_WEIGHTS), bm25_sql(BOOK_ROWS, BOOK_WEIGHTS)
ALL_ANY = lambda s: f"(SELECT * FROM (SELECT *, max(CASE WHEN matched = n_terms THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1 AS has_all FROM {s}) WHERE (has_all AND matched = n_terms) OR (NOT has_all AND n_terms > 1))"
TOP = lambda s, k: f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, book_id) AS rank FROM {s} QUALIFY rank <= {k})"


def chapter_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"), "text")


def book_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.col("text").alias("title"), F.col("source").alias("author"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(chapter_rows(spark, d), ["book_id"], CHAPTER_WEIGHTS, search.query_terms(spark, ASKED))


@add("s02_postings", f"SELECT token AS term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({LIST('text')}) AS token FROM documents) GROUP BY token")
def _(spark, d):
    return search.postings(chapter_rows(spark, d), ["book_id"], ["text"]).groupBy("term").agg(F.count("*").alias("n"))


@add("s05_bm25_chapters", f"SELECT qid, book_id, score FROM {S_CHAPTERS}")
def _(spark, d):
    return scored(spark, d).select("qid", "book_id", "score")


QUERIES["m08_bm25"], ORACLES["m08_bm25"] = QUERIES["s05_bm25_chapters"], ORACLES["s05_bm25_chapters"]


@add("s06_bm25_books", f"SELECT qid, book_id, score FROM {TOP(S_BOOKS, 3)}")
def _(spark, d):
    found = search.bm25(book_rows(spark, d), ["book_id"], BOOK_WEIGHTS, search.query_terms(spark, ASKED))
    return search.top(found, ["book_id"], 3).select("qid", "book_id", "score")


QUERIES["o01_top_books"], ORACLES["o01_top_books"] = QUERIES["s06_bm25_books"], ORACLES["s06_bm25_books"]


@add("s07_and_or", f"SELECT qid, book_id, score, NOT has_all AS partial FROM {ALL_ANY(S_CHAPTERS)}")
def _(spark, d):
    return search.all_or_any(scored(spark, d)).select("qid", "book_id", "score", "partial")


@add("o02_top_chapters", f"SELECT qid, book_id, score FROM {TOP(ALL_ANY(S_CHAPTERS), 10)}")
def _(spark, d):
    return search.top(search.all_or_any(scored(spark, d)), ["book_id"], 10).select("qid", "book_id", "score")


@add("s08_candidates", f"SELECT qid, book_id, CAST(rank AS BIGINT) AS rank FROM {TOP(S_CHAPTERS, 20)}")
def _(spark, d):
    return search.top(scored(spark, d), ["book_id"], 20).select("qid", "book_id", F.col("rank").cast("bigint").alias("rank"))


QUERIES["o03_top_candidates"], ORACLES["o03_top_candidates"] = QUERIES["s08_candidates"], ORACLES["s08_candidates"]


@add("o04_combined_hits", f"WITH u AS (SELECT qid, 0 AS src, book_id, rank FROM {TOP(S_BOOKS, 3)} UNION ALL SELECT qid, 1, book_id, rank FROM {TOP(ALL_ANY(S_CHAPTERS), 10)}) SELECT qid, src, book_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY src, rank) AS BIGINT) AS place FROM u QUALIFY place <= 10")
def _(spark, d):
    from pyspark.sql import Window

    terms = search.query_terms(spark, ASKED)
    b = search.top(search.bm25(book_rows(spark, d), ["book_id"], BOOK_WEIGHTS, terms), ["book_id"], 3).select("qid", F.lit(0).alias("src"), "book_id", "rank")
    c = search.top(search.all_or_any(scored(spark, d)), ["book_id"], 10).select("qid", F.lit(1).alias("src"), "book_id", "rank")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("src", "rank")).cast("bigint")
    return b.unionByName(c).select("qid", "src", "book_id", place.alias("place")).filter("place <= 10")


@add("g15_corpus_stats", f"WITH d AS (SELECT CAST(len({LIST('title')}) + len({LIST('text')}) AS DOUBLE) AS len FROM {CHAPTER_ROWS}) SELECT count(*) AS n_docs, round(avg(len), 6) AS avgdl FROM d")
def _(spark, d):
    return search.lengths(chapter_rows(spark, d), ["book_id"], ["title", "text"]).agg(F.count("*").alias("n_docs"), F.round(F.avg("len"), 6).alias("avgdl"))


@add("j09_prefix_join", f"SELECT DISTINCT term, token FROM {TERMS} JOIN (SELECT DISTINCT unnest({LIST('text')}) AS token FROM documents) ON starts_with(token, term)")
def _(spark, d):
    tokens = search.postings(chapter_rows(spark, d), ["book_id"], ["text"]).select(F.col("term").alias("token")).distinct()
    terms = search.query_terms(spark, ASKED).select("term").distinct()
    return tokens.join(F.broadcast(terms), F.col("token").startswith(F.col("term"))).select("term", "token")


@add("s11_phrase", r"SELECT doc_id AS book_id FROM documents WHERE regexp_matches(translate(lower(text), '" + search.ACCENTED + "', '" + search.PLAIN + r"'), '(^|[^\p{L}\p{N}])licensed[^\p{L}\p{N}]+under[^\p{L}\p{N}]+c')")
def _(spark, d):
    return search.phrases(search.postings(chapter_rows(spark, d), ["book_id"], ["text"]), ["book_id"], ["licensed", "under", "c"])


@add("s10_highlight", r"SELECT doc_id, regexp_replace(text, '(^|[^\p{L}\p{N}])((?i:the)[\p{L}\p{N}]*)', '\1«\2»', 'g') AS marked FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", search.highlight(F.col("text"), "the").alias("marked"))


@add("s09_snippets")
def _(spark, d):
    hits = search.top(scored(spark, d).filter("qid = 1"), ["book_id"], 10)
    return search.with_snippets(hits.join(chapter_rows(spark, d), "book_id"), "text", "licensed under").select("book_id", "snippet")


@add("f20_query_terms", f"SELECT qid, CAST(idx AS BIGINT) AS idx, term FROM {TERMS}")
def _(spark, d):
    return search.query_terms(spark, ASKED).select("qid", F.col("idx").cast("bigint").alias("idx"), "term")


@add("s04_sync", f"SELECT book_id, token AS term, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id AS book_id, unnest({LIST('text')}) AS token FROM documents) GROUP BY ALL")
def _(spark, d):
    """An index of other texts, of which some are the same, is brought up to date: it then is that of the documents."""
    docs = table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("book_id"), F.lit("").alias("title"), "text")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("book_id"), "toxic")
    old = docs.join(labels, "book_id").withColumn("text", F.when(F.col("toxic") == 1, F.lit("another text")).otherwise(F.col("text")))
    gone = spark.createDataFrame([(-1, "", "a book that is gone")], "book_id bigint, title string, text string")
    old = old.select("book_id", "title", "text").unionByName(gone)
    prints = lambda x: x.select(F.col("book_id").alias("id"), F.sha2("text", 256).alias("fingerprint"))
    index = search.synced(search.index_rows(old, ["book_id"], ["title", "text"]), prints(old), docs, ["book_id"], ["title", "text"], prints(docs))
    return index.select("book_id", "term", F.col("rest").cast("bigint").alias("n"))


@add("s02_index", f"SELECT qid, book_id, score FROM {S_CHAPTERS}")
def _(spark, d):
    """The same scores from an index that is written and read again."""
    docs = chapter_rows(spark, d)
    index = stored(search.index_rows(docs, ["book_id"], ["title", "text"]), "index")
    corpus = search.lengths(docs, ["book_id"], ["title", "text"]).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))
    return search.from_index(index, ["book_id"], (5.0, 1.0), spark, ASKED, corpus).select("qid", "book_id", "score")


@add("f19_stems", "SELECT * FROM (VALUES ('running', 'runn'), ('walks', 'walk'), ('книгами', 'книг'), ('as', 'as'), ('ties', 'ties')) AS v(word, stem)")
def _(spark, d):
    return spark.createDataFrame([(w, search.light_stem(w)) for w in ("running", "walks", "книгами", "as", "ties")], "word string, stem string")


@add("f25_yo_variants", "SELECT * FROM (VALUES (0, 'елка зелен'), (1, 'ёлка зелен'), (2, 'елка зёлен'), (3, 'елка зелён')) AS v(k, words)")
def _(spark, d):
    return spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(search.yo_variants(["елка", "зелен"]))], "k int, words string")


CANON_TEXT = lambda c: rf"array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace({c}, '\[[0-9]+\]', '', 'g'), '[\p{{L}}\p{{N}}''’‘′‐‑−-]+'), lambda x: {CANON_SQL}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), ' ')"


@add("v09_exact_contains", f"SELECT doc_id AS key, item_id AS quote_id FROM (SELECT doc_id, ' ' || {CANON_TEXT('text')} || ' ' AS c FROM documents) d, (SELECT item_id, {CANON_TEXT('text')} AS q FROM benchmark) b WHERE contains(c, ' ' || q || ' ')")
def _(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return verify.containing(table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("key"), "text"), quotes)


@add("v01_normalized", f"SELECT item_id, {CANON_TEXT('text')} AS canon FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", verify.canon_text(F.col("text")).alias("canon"))


@add("v06_verdict", "SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'exact' WHEN n_chars / CAST(2000 AS DOUBLE) >= 0.95 THEN 'close' WHEN n_chars / CAST(2000 AS DOUBLE) >= 0.75 THEN 'distorted' ELSE 'not_found' END AS verdict FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", verify.verdict_column(F.col("n_chars") / 2000, F.col("n_chars") > 4000).alias("verdict"))


def _forms(quote: pd.Series) -> pd.Series:
    """The significant words of each quote in their yo-variants; none if they are too few."""
    strong = quote.map(lambda q: [t.canon for t in verify.normalized(q or "") if t.canon not in T.STOP_WORDS])
    return strong.map(lambda w: search.yo_variants(w) if len(w) >= verify.LEAST_SIGNIFICANT else [])


def attributed(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with the best chapters for any of their significant words, compared word by word."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    docs = chapter_rows(spark, d)
    forms = quotes.select("quote_id", F.posexplode(F.pandas_udf(_forms, "array<array<string>>")("quote")).alias("form", "words"))
    terms = forms.select(F.col("quote_id").alias("qid"), "form", F.size("words").alias("n_terms"), F.posexplode("words").alias("idx", "word"))
    terms = terms.select("qid", "form", "idx", search.folded(F.col("word")).alias("term"), "n_terms")  # canonical tokens: one each
    best = search.best(docs, ["book_id"], {"title": 5.0, "text": 1.0}, terms, verify.CANDIDATES).select(F.col("qid").alias("quote_id"), F.col("book_id").alias("key"))
    # a few rows a quote: the texts stay where they are but for those that are compared
    pairs = docs.select(F.col("book_id").alias("key"), "text").join(F.broadcast(best), "key").join(quotes, "quote_id")
    return verify.compared(pairs, "text", "quote").filter("verdict <> 'not_found'")


@add("v05_similarity")
def _(spark, d):
    return attributed(spark, d).select("key", "quote_id", "similarity", "exact", "verdict")


@add("v10_attribution")
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("quote_id").orderBy(F.desc("similarity"), "key")
    return attributed(spark, d).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= verify.CANDIDATES).select("quote_id", "rank", "key", "similarity", "verdict", "passage")


@add("v07_word_diff")
def _(spark, d):
    return attributed(spark, d).select("key", "quote_id", F.size("diff").alias("n"), F.to_json("diff").alias("diff"))


_strong = f"len(list_filter(string_split(canon, ' '), lambda x: x NOT IN ({STOP_SQL})))"


@add("v11_null_verdicts", f"SELECT item_id, CASE WHEN canon = '' THEN 'empty quote' WHEN {_strong} < {verify.LEAST_SIGNIFICANT} THEN 'too short' END AS message FROM (SELECT item_id, {CANON_TEXT('text')} AS canon FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, ' ' UNION ALL SELECT -2, 'two words' UNION ALL SELECT -3, 'the of and to be'))")
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text").union(spark.createDataFrame([(-1, " "), (-2, "two words"), (-3, "the of and to be")], "item_id bigint, text string"))
    return rows.select("item_id", F.pandas_udf(lambda q: q.map(verify.refusal), "string")("text").alias("message"))


for alias, of in {"v03_window_candidates": "w14_windows", "v12_batch_attribution": "v10_attribution", "v08_passages": "v10_attribution", "m04_ratio": "v05_similarity"}.items():
    if of in QUERIES:
        QUERIES[alias] = QUERIES[of]
