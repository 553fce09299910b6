"""Markdown of chapters as Column expressions and one ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import slug


def table_md(text: Column) -> Column:
    """Lines of TAB-separated cells as a pipe table; the first is the head."""
    rows = F.transform(F.split(F.replace(text, F.lit("|"), F.lit("\\|")), "\n"), lambda r: F.concat(F.lit("| "), F.replace(r, F.lit("\t"), F.lit(" | ")), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.split(F.split(text, "\n")[0], "\t"))))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.size(rows))), "\n")


def code_md(text: Column) -> Column:
    """Fenced by more backticks than any run in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def file_name(n: Column, title: Column, part: Column, most: int = 50) -> Column:
    plain = F.when(part.isNotNull(), F.regexp_replace(title, r"\s*\([0-9]+/[0-9]+\)$", "")).otherwise(title)
    return F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("-"), slug(plain, most), F.when(part.isNotNull(), F.concat(F.lit("-p"), part.cast("string"))).otherwise(""), F.lit(".md"))


def body_md(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the Markdown ``text`` of their blocks (pos, kind, level, text), without a title.

    List items stand together until another block follows; metadata is left out, footnotes go to the end.
    """
    shown = blocks.filter("kind NOT IN ('meta', 'footnote')")
    order = Window.partitionBy(*keys).orderBy("pos")
    item = (F.col("kind") == "list_item").cast("int")
    run = F.sum(F.when((item == 1) & (F.lag(item, 1, 0).over(order) == 1), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    body = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.coalesce("level", F.lit(1)) + 1)), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.col("text")))
        .when(F.col("kind") == "quote", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"))
        .when(F.col("kind") == "table", table_md(F.col("text")))
        .when(F.col("kind") == "code", code_md(F.col("text")))
        .otherwise(F.col("text"))
    )
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("md")))), lambda x: x["md"])
    runs = shown.withColumn("run", run).groupBy(*keys, "run").agg(F.min("pos").alias("pos"), F.array_join(joined(body), "\n").alias("md"))
    parts = runs.groupBy(*keys).agg(joined(F.col("md")).alias("parts"))
    notes = blocks.filter("kind = 'footnote'").groupBy(*keys).agg(F.array_join(joined(F.col("text")), "\n").alias("notes"))
    none = F.array().cast("array<string>")
    whole = parts.join(notes, keys, "full")
    text = F.array_join(F.concat(F.coalesce("parts", none), F.when(F.col("notes").isNotNull(), F.array(F.lit("---"), F.col("notes"))).otherwise(none)), "\n\n")
    return whole.select(*keys, F.regexp_replace(text, "[ \\t]+\n", "\n").alias("text"))


def chapter_md(blocks: DataFrame) -> DataFrame:
    """book, n and the Markdown of each chapter; blocks have book, n, title, pos, kind, level, text."""
    heads = blocks.groupBy("book", "n").agg(F.min("title").alias("title"))
    whole = heads.join(body_md(blocks, ["book", "n"]), ["book", "n"], "left")
    head = F.regexp_replace(F.concat(F.lit("# "), "title"), "[ \\t]+$", "")
    return whole.select("book", "n", F.concat(F.array_join(F.array(head, F.nullif("text", F.lit(""))), "\n\n"), F.lit("\n")).alias("md"))
