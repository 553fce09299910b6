"""Page layout passes over pre-extracted blocks of PDF pages, as relations.

Blocks: doc, page, pos, text, size, bold, n_lines, x0, y0, x1, y1, page_w, page_h, kind, level. Spans
(text pieces with sizes) are first put together by ``blocks_of_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions.text import half_point, header_signature, heading_rank, is_page_number, line_merge
from leafmill.session import stored

# Zones, ratios and limits of the layout rules.
ZONE, HEADER_RATIO, HEADER_LEAST, NUMBER_MOST = 0.10, 0.30, 5, 4
GAP, SIDE, WIDE_PAGES = 0.15, 0.25, 0.10
HEADING, HEADING_LEVELS, HEADING_MOST, BOLD_MOST = 1.15, 3, 120, 60
NOTE_SIZE, NOTE_ZONE, DEFECTS, SCAN_LEAST, BOLD_SHARE = 0.85, 0.33, 0.02, 20, 0.60
SENTENCE_ENDS = ".!?…:;»\")"


def page_window() -> WindowSpec:
    return Window.partitionBy("doc", "page")


def blocks_of_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc, page, block, line, span, text, size, bold) as blocks: most frequent size by characters, smaller of equals; bold if most characters are."""
    sizes = spans.groupBy("doc", "page", "block", half_point(F.col("size")).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    main = sizes.groupBy("doc", "page", "block").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("size"))
    lines = spans.groupBy("doc", "page", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("bold_chars"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    body = lines.groupBy("doc", "page", "block").agg(text.alias("text"), (F.sum("bold_chars") >= BOLD_SHARE * F.sum("chars")).alias("bold"), F.count("*").alias("n_lines"))
    return body.join(main, ["doc", "page", "block"])


def scanned(blocks: DataFrame) -> DataFrame:
    """Documents whose median page has too little text to be anything but a scan."""
    pages = blocks.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars"))
    return pages.groupBy("doc").agg(F.median("chars").alias("median_chars")).filter(F.col("median_chars") < SCAN_LEAST)


def zone() -> Column:
    middle = (F.col("y0") + F.col("y1")) / 2
    return F.when(middle < ZONE * F.col("page_h"), "top").when(middle > (1 - ZONE) * F.col("page_h"), "bottom")


def body_sizes(blocks: DataFrame) -> DataFrame:
    """doc and the size most characters of its paragraphs have, the smaller of equals."""
    n = blocks.filter("kind = 'para' AND size IS NOT NULL").groupBy("doc", "size").agg(F.sum(F.length("text")).alias("chars"))
    return n.groupBy("doc").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


def with_body(blocks: DataFrame) -> DataFrame:
    return blocks.join(body_sizes(blocks), "doc", "left")


def without_page_numbers(blocks: DataFrame) -> DataFrame:
    large = F.coalesce(F.col("size") >= HEADING * F.col("body"), F.lit(False))
    number = F.coalesce(zone().isNotNull() & is_page_number(F.col("text"), NUMBER_MOST) & ~large, F.lit(False))
    return with_body(blocks).filter(~number).drop("body")


def running_headers(blocks: DataFrame) -> DataFrame:
    """(doc, zone, signature) that stand on enough pages."""
    pages = blocks.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    marks = blocks.withColumn("zone", zone()).filter("zone IS NOT NULL").groupBy("doc", "zone", header_signature(F.col("text")).alias("signature")).agg(F.count_distinct("page").alias("on"))
    return marks.join(pages, "doc").filter(F.col("on") >= F.greatest(F.lit(HEADER_LEAST), F.ceil(HEADER_RATIO * F.col("pages")))).select("doc", "zone", "signature")


def without_headers(blocks: DataFrame) -> DataFrame:
    own = blocks.withColumn("zone", zone()).withColumn("signature", header_signature(F.col("text")))
    return own.join(running_headers(blocks), ["doc", "zone", "signature"], "left_anti").drop("zone", "signature")


def column_cuts(blocks: DataFrame) -> DataFrame:
    """doc, page, cuts, split_x: gaps between columns of the page body."""
    x = (F.col("x0") + F.col("x1")) / 2
    body = blocks.withColumn("x", x).filter(zone().isNull() & F.col("x").isNotNull())
    order = page_window().orderBy("x")
    g = body.select("doc", "page", "page_w", "x", F.lead("x").over(order).alias("next"), F.row_number().over(order).alias("k"), F.count("*").over(page_window()).alias("n"))
    cut = (F.col("next") - F.col("x") >= GAP * F.col("page_w")) & (F.col("k") >= SIDE * F.col("n")) & (F.col("n") - F.col("k") >= SIDE * F.col("n"))
    return g.groupBy("doc", "page").agg(F.count_if(cut).alias("cuts"), F.min(F.when(cut, (F.col("x") + F.col("next")) / 2)).alias("split_x"))


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """Two-column pages: the body's blocks, by column, take the body's places in order; others stay."""
    b = blocks.join(column_cuts(blocks).filter("cuts = 1"), ["doc", "page"], "left")
    is_body = F.coalesce(zone().isNull() & F.col("split_x").isNotNull(), F.lit(False))
    b = b.withColumn("is_body", is_body)
    own = b.filter("is_body").withColumn("right", ((F.col("x0") + F.col("x1")) / 2 >= F.col("split_x")).cast("int"))
    ranked = own.withColumn("place", F.row_number().over(page_window().orderBy("right", "y0", "x0"))).withColumn("slot_rank", F.row_number().over(page_window().orderBy("pos")))
    slots = ranked.select("doc", "page", F.col("slot_rank").alias("place"), F.col("pos").alias("slot"))
    moved = ranked.join(slots, ["doc", "page", "place"]).withColumn("pos", F.col("slot"))
    return b.filter(~F.col("is_body")).select(*blocks.columns).unionByName(moved.select(*blocks.columns))


def wide_pages(blocks: DataFrame) -> DataFrame:
    """Pages of three columns or more."""
    return column_cuts(blocks).filter("cuts >= 2").select("doc", "page")


def defect_pages(blocks: DataFrame) -> DataFrame:
    """Pages with too many unreadable characters in their text layer."""
    bad = F.sum(F.regexp_count("text", F.lit(r"[\x{FFFD}\p{Cn}\p{Co}]|[\p{Cc}&&[^\n\t]]")))
    return blocks.groupBy("doc", "page").agg(bad.alias("bad"), F.sum(F.length("text")).alias("chars")).filter(F.col("bad") > DEFECTS * F.col("chars")).select("doc", "page", F.round(F.col("bad") / F.col("chars"), 4).alias("share"))


def heading_sizes(blocks: DataFrame) -> DataFrame:
    """doc, size, size_level: the largest sizes that stand out and occur twice."""
    n = with_body(blocks).filter("kind = 'para' AND size IS NOT NULL").groupBy("doc", "size", "body").agg(F.count("*").alias("n")).filter((F.col("size") >= HEADING * F.col("body")) & (F.col("n") >= 2))
    return n.withColumn("size_level", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size")))).filter(F.col("size_level") <= HEADING_LEVELS).select("doc", "size", "size_level")


def with_headings(blocks: DataFrame) -> DataFrame:
    """Paragraphs that are headings by size, by bold type, or, where no size stands out, by pattern."""
    sizes = heading_sizes(blocks)
    levels = sizes.groupBy("doc").agg(F.max("size_level").alias("n_levels"))
    b = with_body(blocks).join(sizes, ["doc", "size"], "left").join(levels, "doc", "left").withColumn("n_levels", F.coalesce("n_levels", F.lit(0)))
    end = F.substring(F.rtrim("text"), -1, 1)
    by_size = F.col("size_level").isNotNull() & (F.col("n_lines") <= 2) & (F.length("text") <= HEADING_MOST) & ~end.isin(".", ",")
    by_bold = (F.col("size") == F.col("body")) & F.col("bold") & (F.col("n_lines") == 1) & (F.length("text") <= BOLD_MOST) & (end != ".")
    rank = F.when((F.col("kind") == "para") & (F.col("n_levels") == 0) & (F.col("n_lines") == 1) & ~by_bold, heading_rank(F.col("text")))
    b = b.withColumn("rank", rank)
    rank = F.when(F.col("rank").isNotNull(), F.dense_rank().over(Window.partitionBy("doc", F.col("rank").isNull()).orderBy("rank")))
    level = F.when(F.col("kind") != "para", F.col("level")).when(by_size, F.col("size_level")).when(by_bold, F.least(F.col("n_levels") + 1, F.lit(4))).otherwise(rank)
    b = b.withColumn("level", level).withColumn("kind", F.when((F.col("kind") == "para") & F.col("level").isNotNull(), "heading").otherwise(F.col("kind")))
    return merged_headings(b.select(*blocks.columns))


def merged_headings(blocks: DataFrame) -> DataFrame:
    """Headings of one level that follow each other on a page closer than a line are one, unless both are headings by pattern."""
    order = Window.partitionBy("doc").orderBy("page", "pos")
    prev = lambda c: F.lag(c).over(order)
    line = (prev("y1") - prev("y0")) / F.greatest(F.lit(1), prev("n_lines"))
    joins = (F.col("kind") == "heading") & (prev("kind") == "heading") & (prev("level") == F.col("level")) & (prev("page") == F.col("page")) & (F.col("y0") - prev("y1") < line) & ~(heading_rank(F.col("text")).isNotNull() & heading_rank(prev("text")).isNotNull())
    return _islands(blocks, F.coalesce(joins, F.lit(False)), order, first=True)


def _islands(blocks: DataFrame, joins: Column, order, first: bool) -> DataFrame:
    """Runs of blocks that join the one before become one: the first's place and, by ``first``, its page and box or the last's."""
    run = F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    b = blocks.withColumn("joins", joins).withColumn("run", run)
    edge = F.min_by if first else F.max_by
    at = F.struct("page", "pos")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))), lambda x: x["text"])
    keep = {"page": edge("page", at), "pos": F.min_by("pos", at) if first else F.max_by("pos", at), "text": line_merge(F.array_join(texts, "\n")), "x0": F.min("x0") if first else F.max_by("x0", at), "x1": F.max("x1") if first else F.max_by("x1", at), "y0": edge("y0", at), "y1": F.max_by("y1", at), "n_lines": F.sum("n_lines")}
    return b.groupBy("doc", "run").agg(*[keep.get(c, F.min_by(c, at)).alias(c) for c in blocks.columns if c != "doc"]).select(*blocks.columns)


def across_pages(blocks: DataFrame) -> DataFrame:
    """A paragraph without a sentence end goes on in the next page's first block if that begins in lower case or with a dash; foot notes don't."""
    b = with_body(blocks)
    order = Window.partitionBy("doc").orderBy("page", "pos")
    note = F.coalesce((F.col("size") < NOTE_SIZE * F.col("body")) & (F.col("y0") >= (1 - NOTE_ZONE) * F.col("page_h")), F.lit(False))
    b = b.withColumn("note", note)
    prev = lambda c: F.lag(c).over(order)
    head, tail = F.substring(F.ltrim("text"), 1, 1), F.substring(F.rtrim(prev("text")), -1, 1)
    goes_on = head.rlike(r"^[\p{Ll}—–-]$") & (tail != "") & ~tail.isin(*SENTENCE_ENDS)
    joins = (F.col("kind") == "para") & (prev("kind") == "para") & (F.col("page") > prev("page")) & ~prev("note") & goes_on
    return _islands(b, F.coalesce(joins, F.lit(False)), order, first=False).select(*blocks.columns)


def with_footnotes(blocks: DataFrame, drop: bool = False) -> DataFrame:
    """Small paragraphs low on the page that begin with a digit or star are foot notes, or go."""
    note = F.coalesce((F.col("kind") == "para") & (F.col("size") < NOTE_SIZE * F.col("body")) & (F.col("y0") >= (1 - NOTE_ZONE) * F.col("page_h")) & F.col("text").rlike(r"^[0-9*]"), F.lit(False))
    b = with_body(blocks).withColumn("kind", F.when(note, "footnote").otherwise(F.col("kind"))).select(*blocks.columns)
    return b.filter("kind <> 'footnote'") if drop else b


def layout(blocks: DataFrame) -> DataFrame:
    """All passes in their order; those that join blocks with sums of themselves begin from a written table."""
    b = stored(without_headers(without_page_numbers(blocks)), "layout")
    b = stored(with_headings(in_reading_order(b)), "layout")
    return with_footnotes(stored(across_pages(b), "layout"))
