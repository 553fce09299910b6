"""Quality gate: metrics from lines, subscores, weighted score, triggers, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import down, trapezoid

# Weights, limits and exceptions of the gate.
WEIGHTS = {"coverage": 0.30, "dehyphen": 0.10, "encoding": 0.15, "garbage": 0.20, "structure": 0.25}
OK_LEAST, FAILED_BELOW = 0.90, 0.60
COVERAGE_POINTS, COVERAGE_REVIEW = (0.40, 0.70, 1.02, 1.15), (0.60, 1.02)
GARBAGE, ENCODING, DEHYPHEN = (0.005, 0.05, 0.02), (0.0, 0.02, 0.005), (0.002, 0.03, 0.01)
MEDIAN_BAND = (300, 20000)
SHORT_OK = ("—", "–", "*", "―")
MOJIBAKE = ("Ñ",)


def lone_numbers(bare: Column) -> Column:
    """The trimmed lines that are a number between blank lines, or the text's ends."""
    blank = lambda i: F.coalesce(F.get(bare, i), F.lit("")) == ""
    return F.transform(bare, lambda s, i: s.rlike("^[0-9]{1,4}$") & blank(i - 1) & blank(i + 1))


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))


def line_counts(text: Column) -> Column:
    """struct(lines, garbage, residue) of one text: lines of one or two characters, lone numbers, hyphens left at line ends."""
    short = lambda s: (F.length(s) <= 2) & ~s.isin(*SHORT_OK)

    def counted(bare: Column) -> Column:
        garbage = F.filter(F.arrays_zip(bare.alias("s"), lone_numbers(bare).alias("lone")), lambda x: (x["s"] != "") & (short(x["s"]) | x["lone"]))
        residue = F.filter(bare, lambda s: s.rlike(r"\p{L}-$"))
        return F.struct(F.size(F.filter(bare, lambda s: s != "")).cast("bigint").alias("lines"), F.size(garbage).cast("bigint").alias("garbage"), F.size(residue).cast("bigint").alias("residue"))

    # the lines are bound by a function of one argument, so that they are made once and not for every line again
    return F.get(F.transform(F.array(trimmed_lines(text)), counted), 0)


def bad_chars(text: Column) -> Column:
    """Replacement characters and each marker of a wrong decoding, each counted for itself."""
    out = F.regexp_count(text, F.lit("�"))
    for m in MOJIBAKE:
        out = out + F.regexp_count(text, F.lit(m))
    return out.cast("bigint")


def metrics(chapters: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per doc. ``chapters``: doc, text, tokens; ``refs``: doc, ref_tokens, removed_tokens, control_chars, found, pages, wide_pages, hyphenated."""
    m = chapters.withColumn("c", line_counts(F.col("text"))).groupBy("doc").agg(
        F.sum("tokens").alias("tokens"), F.median("tokens").alias("median_tokens"), F.sum("c.lines").alias("lines"), F.sum("c.garbage").alias("garbage"), F.sum("c.residue").alias("residue"),
        F.sum(bad_chars(F.col("text"))).alias("bad"), F.sum(F.length("text")).alias("chars"),
    )
    m = m.join(refs, "doc")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return m.select(
        "doc",
        (F.col("tokens") / F.greatest(F.lit(1), F.col("ref_tokens") - F.col("removed_tokens"))).alias("coverage"),
        share(F.col("garbage"), F.col("lines")).alias("garbage_ratio"),
        share(F.col("bad") + F.col("control_chars"), F.col("chars")).alias("encoding_score"),
        F.when(~F.col("found"), 0.3).when(F.col("median_tokens").between(*MEDIAN_BAND), 1.0).otherwise(0.7).alias("structure"),
        F.when(F.col("hyphenated"), share(F.col("residue"), F.col("lines"))).otherwise(0.0).alias("dehyphen_residue"),
        "median_tokens",
        "found",
        ((F.col("pages") > 0) & (F.col("wide_pages") > 0.10 * F.col("pages"))).alias("layout_flag"),
    )


def scored(m: DataFrame) -> DataFrame:
    """Metrics with subscores, score, triggers in their order, and status."""
    subs = {
        "coverage": F.round(trapezoid(F.col("coverage"), COVERAGE_POINTS), 4),
        "dehyphen": F.round(down(F.col("dehyphen_residue"), *DEHYPHEN[:2]), 4),
        "encoding": F.round(down(F.col("encoding_score"), *ENCODING[:2]), 4),
        "garbage": F.round(down(F.col("garbage_ratio"), *GARBAGE[:2]), 4),
        "structure": F.col("structure"),
    }
    m = m.select("*", *[c.alias(f"sub_{k}") for k, c in subs.items()])
    score = F.lit(0.0)
    for k in sorted(WEIGHTS):
        score = score + WEIGHTS[k] * F.col(f"sub_{k}")
    lo, hi = COVERAGE_REVIEW
    triggers = F.array(
        F.when(F.col("coverage") < lo, F.format_string("coverage %.2f < %.2f", "coverage", F.lit(lo))).when(F.col("coverage") > hi, F.format_string("coverage %.2f > %.2f", "coverage", F.lit(hi))),
        F.when(F.col("garbage_ratio") > GARBAGE[2], F.format_string("garbage_ratio %.4f > %s", "garbage_ratio", F.lit(str(GARBAGE[2])))),
        F.when(F.col("encoding_score") > ENCODING[2], F.format_string("encoding_score %.4f > %s", "encoding_score", F.lit(str(ENCODING[2])))),
        F.when(~F.col("found"), "no chapters found"),
        F.when(F.col("dehyphen_residue") > DEHYPHEN[2], F.format_string("dehyphen_residue %.4f > %s", "dehyphen_residue", F.lit(str(DEHYPHEN[2])))),
        F.when(F.col("layout_flag"), "three or more columns on over 10% of the pages"),
    )
    m = m.withColumn("score", F.round(score, 4)).withColumn("triggers", F.filter(triggers, lambda t: t.isNotNull()))
    return m.withColumn("status", F.when(F.col("score") < FAILED_BELOW, "failed").when((F.col("score") < OK_LEAST) | (F.size("triggers") > 0), "review").otherwise("ok"))


def with_repair(m: DataFrame, repaired: Column, locked: Column) -> DataFrame:
    """A repaired title means review at least, unless the metadata are locked."""
    return m.withColumn("status", F.when((F.col("status") == "ok") & repaired & ~locked, "review").otherwise(F.col("status")))


def stored_only(m: DataFrame) -> DataFrame:
    """What is kept in the library: failed books are not."""
    return m.filter("status <> 'failed'")
