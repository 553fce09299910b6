"""Section structure from blocks (doc, pos, kind, level, text): ranks, paths, chapters.

A document's blocks are in the order of ``pos``. Everything here is windows over a document, so one
shuffle by doc serves all steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions.text import path_title, word_count

#: Deepest heading level after ranking; titles of the parts without a heading of their own.
DEEPEST = 6
PREFACE = "Начало"
#: Tokens: deepen the cut above, make it shallow below, and size of parts without headings.
DEEPEN, SHALLOW, PART = 12000, 500, 6000


def so_far() -> WindowSpec:
    """A document's blocks up to this one."""
    return Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def ranked(blocks: DataFrame) -> DataFrame:
    """Heading levels as 1, 2, ... in each document; a heading without a level comes last."""
    heads = Window.partitionBy("doc", F.col("kind") == "heading").orderBy(F.col("level").asc_nulls_last())
    return blocks.withColumn("level", F.when(F.col("kind") == "heading", F.dense_rank().over(heads)))


def with_preface(blocks: DataFrame) -> DataFrame:
    """A first heading for documents that begin without one."""
    first = blocks.groupBy("doc").agg(F.min_by("kind", "pos").alias("kind")).filter("kind <> 'heading'")
    made = first.select("doc", F.lit(-1).alias("pos"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.lit(PREFACE).alias("text"))
    return blocks.select("doc", "pos", "kind", "level", "text").unionByName(made)


def _last(level: int) -> Column:
    return F.max(F.when((F.col("kind") == "heading") & (F.col("level") == level), F.struct("pos", "text"))).over(so_far())


def with_paths(blocks: DataFrame) -> DataFrame:
    """``path``: titles of the open sections; ``parent``: level of the section around a heading, 0 at the top."""
    d = blocks.select("*", *[_last(k).alias(f"h{k}") for k in range(1, DEEPEST + 1)])
    pos = lambda k: F.coalesce(F.col(f"h{k}.pos"), F.lit(-2))
    above = lambda k: F.greatest(F.lit(-2), F.lit(-2), *[pos(j) for j in range(1, k)])
    is_open = {k: F.col(f"h{k}").isNotNull() & (pos(k) > above(k)) for k in range(1, DEEPEST + 1)}
    path = F.filter(F.array(*[F.when(is_open[k], F.col(f"h{k}.text")) for k in range(1, DEEPEST + 1)]), lambda x: x.isNotNull())
    parent = F.greatest(F.lit(0), F.lit(0), *[F.when(is_open[k] & (F.col("level") > k), k).otherwise(0) for k in range(1, DEEPEST + 1)])
    return d.select(*blocks.columns, path.alias("path"), F.when(F.col("kind") == "heading", parent).alias("parent"))


def chapters(blocks: DataFrame, cut: Column, count: Callable[[Column], Column] = word_count) -> DataFrame:
    """doc, start, title, tokens, n_blocks of the chapters at level ``cut``, from blocks with paths.

    A heading begins a chapter if the section around it is above the cut; one above the cut without
    blocks of its own is no chapter. Headings inside a chapter count as its blocks.
    """
    begins = (F.col("kind") == "heading") & (F.col("parent") < cut)
    d = blocks.withColumn("cut", cut).withColumn("begins", begins).withColumn("start", F.max(F.when(begins, F.col("pos"))).over(so_far()))
    own = ~F.col("begins")
    out = d.groupBy("doc", "start").agg(
        F.max(F.when(F.col("begins"), path_title(F.col("path")))).alias("title"),
        F.max(F.when(F.col("begins"), F.col("level") < F.col("cut"))).alias("above"),
        F.sum(F.when(own, count(F.col("text"))).otherwise(0)).cast("bigint").alias("tokens"),
        F.count_if(own).alias("n_blocks"),
    )
    return out.filter("NOT (above AND n_blocks = 0)").drop("above")


def level_medians(blocks: DataFrame, count: Callable[[Column], Column] = word_count) -> DataFrame:
    """doc, cut (1 to 4), m: the median tokens of the chapters that each cut would make; one shuffle serves all cuts."""
    begins = {k: (F.col("kind") == "heading") & (F.col("parent") < k) for k in range(1, 5)}
    each = [F.struct(F.lit(k).alias("cut"), F.max(F.when(begins[k], F.col("pos"))).over(so_far()).alias("start"), begins[k].alias("begins"), (begins[k] & (F.col("level") < k)).alias("above")) for k in begins]
    d = blocks.select("doc", count(F.col("text")).alias("t"), F.array(*each).alias("cuts")).select("doc", "t", F.explode("cuts").alias("c"))
    own = ~F.col("c.begins")
    chapter = d.groupBy("doc", "c.cut", "c.start").agg(F.sum(F.when(own, F.col("t")).otherwise(0)).alias("tokens"), F.max("c.above").alias("above"), F.count_if(own).alias("n_blocks"))
    return chapter.filter("NOT (coalesce(above, false) AND n_blocks = 0)").groupBy("doc", "cut").agg(F.median("tokens").alias("m"))


def cut_levels(blocks: DataFrame, count: Callable[[Column], Column] = word_count) -> DataFrame:
    """doc and its cut level: from 2 deeper while chapters are long, to 1 if they are short at the start."""
    levels = blocks.filter("kind = 'heading'").groupBy("doc").agg(F.max("level").alias("deepest"))
    m = level_medians(blocks, count).groupBy("doc").agg(*[F.max(F.when(F.col("cut") == k, F.col("m"))).alias(f"m{k}") for k in range(1, 5)]).join(levels, "doc")
    med_at = lambda k: F.coalesce(F.col(f"m{k}"), F.lit(0.0))
    start = F.least(F.lit(2), F.col("deepest"))
    at3 = F.when((med_at(3) > DEEPEN) & (F.col("deepest") >= 4), 4).otherwise(3)
    at2 = F.when((med_at(2) > DEEPEN) & (F.col("deepest") >= 3), at3).otherwise(F.when(med_at(2) < SHALLOW, 1).otherwise(2))
    at1 = F.when((med_at(1) > DEEPEN) & (F.col("deepest") >= 2), 2).otherwise(1)
    return m.select("doc", F.when(start == 2, at2).otherwise(at1).alias("cut"))


def bins_of(tokens: np.ndarray, most: int) -> np.ndarray:
    """Bin of each entry: the next one goes into the open bin if it fits, else opens a bin. Each bin is found by one search in the running sums."""
    sums, cuts, at = np.append(0, np.cumsum(tokens)), [], 0
    while at < len(tokens):
        cuts.append(at)
        at = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
    return np.repeat(np.arange(len(cuts)), np.diff([*cuts, len(tokens)]))


def greedy_bins(tokens: Column, most: int) -> Column:
    """Bins of an array's entries, in an Arrow function: a fold in the plan would copy its result for every entry."""

    @F.pandas_udf("array<int>")
    def bins(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: bins_of(np.asarray(t, np.int64), most).astype(np.int32))

    return bins(tokens)


def parts(blocks: DataFrame, most: int = PART) -> DataFrame:
    """doc, part, parts, tokens, n_blocks: documents without headings cut by size."""
    rows = blocks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", word_count(F.col("text")).alias("t")))).alias("rows"))
    binned = rows.select("doc", greedy_bins(F.col("rows.t"), most).alias("bin"), F.col("rows.t").alias("t"))
    bins = binned.select("doc", F.explode(F.arrays_zip("bin", "t")).alias("x"))
    sums = bins.groupBy("doc", F.col("x.bin").alias("bin")).agg(F.sum("x.t").cast("bigint").alias("tokens"), F.count("*").alias("n_blocks"))
    return sums.select("doc", (F.col("bin") + 1).cast("bigint").alias("part"), F.count("*").over(Window.partitionBy("doc")).alias("parts"), "tokens", "n_blocks")
