"""Chapter reads over ``conversations``: a conversation is a book, a turn is a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.session import table

#: White space of the word counter; fixed so that both engines agree.
WORD = r"[^ \t\n\r]+"


def word_count(text: str) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def budget_read(chapters: DataFrame, budget: int, start: int = 0) -> DataFrame:
    """Per book the longest run of consecutive chapters from ``start`` whose tokens fit in ``budget``.

    ``chapters`` has book, n and tokens (0 or more, so a running sum decides the prefix). It stops
    at the first chapter that doesn't fit; ``next_from`` names that chapter, null if all fitted.
    """
    order = Window.partitionBy("book").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = chapters.filter(F.col("n") >= start).withColumn("run", F.sum("tokens").over(order))
    fits = F.col("run") <= budget
    return run.groupBy("book").agg(
        F.count_if(fits).alias("chapters_read"),
        F.coalesce(F.sum(F.when(fits, F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens_read"),
        F.min(F.when(~fits, F.col("n"))).alias("next_from"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), "role", "text", word_count("text").alias("tokens"))


QUERIES = {"a08_budget_read": lambda spark, d: budget_read(turns(spark, d), 150)}
ORACLES = {
    "a08_budget_read": r"""
WITH t AS (SELECT conv_id AS book, turn AS n, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS tokens FROM conversations),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT book, CAST(count(*) FILTER (WHERE run <= 150) AS BIGINT) AS chapters_read,
       CAST(coalesce(sum(tokens) FILTER (WHERE run <= 150), 0) AS BIGINT) AS tokens_read,
       min(n) FILTER (WHERE run > 150) AS next_from
FROM r GROUP BY book""",
}
