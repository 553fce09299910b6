"""Catalogue operators: listings, lookups, reads, index joins. All are plain DataFrame plans.

A books table has id, title, author, sha256, cache_key, status, score; a chapters table has book, n,
title, text, tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOK_ID = re.compile(r"[a-z0-9][a-z0-9._-]*")


def validate_book_id(book: str) -> str:
    """The id, if it is one; ids never leave their folder."""
    if not BOOK_ID.fullmatch(book) or ".." in book:
        raise ValueError(f"not a book id: {book!r}")
    return book


def listing(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per book with its number of chapters and total tokens."""
    sums = chapters.groupBy("book").agg(F.count("*").alias("chapters"), F.sum("tokens").cast("bigint").alias("total_tokens"))
    return books.join(sums, books.id == sums.book, "left").select("id", "title", "author", F.coalesce("chapters", F.lit(0)).cast("bigint").alias("chapters"), F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"), "status")


def lookup(books: DataFrame, book: object) -> DataFrame:
    """The book of an id; an unknown id is an error."""
    found = books.filter(F.col("id") == F.lit(book))
    if found.isEmpty():
        raise KeyError(f"no book {book!r}")
    return found


def first_by(books: DataFrame, key: str) -> DataFrame:
    """The first id, in order of ids, of each value of ``key``."""
    return books.groupBy(key).agg(F.min("id").alias("id"))


def info(books: DataFrame, reports: DataFrame) -> DataFrame:
    """Books with their reports where there are some."""
    return books.join(reports, "id", "left").select("id", "title", "status", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("warnings", F.lit("")).alias("warnings"))


def parse_spec(spec: str, n_max: int) -> list[int]:
    """``3,1-2,3`` as chapter numbers: order and repeats stay; numbers out of bounds are an error."""
    out: list[int] = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a chapter or range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if not 1 <= a <= b <= n_max:
            raise ValueError(f"chapters {part.strip()} are not within 1-{n_max}")
        out += range(a, b + 1)
    return out


def spec_column(spec: str) -> Column:
    """The same as an array column, for specs that are within bounds."""
    parts = [f"sequence({a}, {b or a})" for a, b in re.findall(r"(\d+)(?:-(\d+))?", spec)]
    return F.expr(f"flatten(array({', '.join(parts)}))")


def read_spec(chapters: DataFrame, spec: str) -> DataFrame:
    """Texts of the chapters of a spec, in its order and with its repeats, joined by a blank line."""
    asked = chapters.select("book").distinct().select("book", F.posexplode(spec_column(spec)).alias("ord", "n"))
    text = F.regexp_replace("text", "\n+$", "")
    rows = asked.join(chapters, ["book", "n"]).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))).alias("rows"))
    return rows.select("book", F.array_join("rows.text", "\n\n").alias("text"), F.array_join(F.transform("rows", lambda r: r["ord"].cast("string")), ",").alias("ords"))


def review_listing(books: DataFrame, triggers: DataFrame) -> DataFrame:
    """Books under review with their triggers in one string."""
    joined = triggers.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "trigger"))), lambda t: t["trigger"]), "; ").alias("triggers"))
    return books.filter("status = 'review'").join(joined, "id", "left").select("id", F.coalesce("triggers", F.lit("")).alias("triggers"))


def deleted(known: DataFrame, current: DataFrame) -> DataFrame:
    """Known ids that are there no longer."""
    return known.select("id").join(current.select("id"), "id", "left_anti")


def fresh(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose ``key`` isn't known."""
    return files.join(known.select("key"), "key", "left_anti")


def changed(current: DataFrame, known: DataFrame) -> DataFrame:
    """Current ids whose fingerprint isn't the known one, null meaning new."""
    old = known.select("id", F.col("fingerprint").alias("old"))
    return current.join(old, "id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("old"))).select("id", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("what"))


def identities(sources: DataFrame, books: DataFrame) -> DataFrame:
    """The id of each source (sha256, slug): that of a book of its content, else its slug, with six digits of the hash if another book has it."""
    same = books.groupBy("sha256").agg(F.min("id").alias("same_id"))
    taken = books.select(F.col("id").alias("slug"), F.col("sha256").alias("other")).dropDuplicates(["slug"])
    own = sources.join(same, "sha256", "left").join(taken, "slug", "left")
    return own.select("sha256", "slug", F.when(F.col("same_id").isNotNull(), F.col("same_id")).when(F.col("other").isNull() | (F.col("other") == F.col("sha256")), F.col("slug")).otherwise(F.concat_ws("-", "slug", F.substring("sha256", 1, 6))).alias("id"))


def fingerprints(chapters: DataFrame) -> DataFrame:
    """A hash of each book's chapters, in order."""
    part = F.concat_ws(":", F.col("n").cast("string"), F.sha2("text", 256))
    return chapters.groupBy("book").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), "|"), 256).alias("fingerprint"))


def renumbered(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("n", F.row_number().over(Window.partitionBy("book").orderBy("n")).cast("bigint"))
