"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents. What each takes away stays away: rejected
documents, all but one of each group of near duplicates, repeated runs of words, benchmark passages.
The last adds the token ids.

Cases, for every stage: a null text counts as empty and a null doc_id is a document like others, but links with none;
empty texts have no words, so the first stage rejects them; texts of any length are worked on whole; of tied copies the
one of least doc_id stays, of rows that repeat just one; an empty table stays empty; all other columns are carried, also
those named like columns of the operators, but ``ids`` is replaced by the last stage and ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, decontam, ngram_join, quality, substring
from leafmill.session import stored, table

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines: of fifty words or more, few of them repeated, with little lost."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that n-gram Jaccard links make."""
    return ngram_join.one_of_each(docs)


def repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of words that stand elsewhere too."""
    return substring.removed(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are little else are dropped."""
    return decontam.removed(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, as ``ids``."""
    return bpe.with_ids(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_runs),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stored(docs, f"stage-{k}") if k else docs, sf_dir)
    return docs
