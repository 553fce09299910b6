"""One registered query per operator, each over the whole of its table."""

from __future__ import annotations

import public_tokenizers

from leafmill.llm import bpe, decontam, html, license, lm, ngram_join, quality, substring, suffix, warc
from leafmill.llm.oracles import ORACLES
from leafmill.session import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark, sf_dir):
    return quality.measured(table(spark, sf_dir, "documents", spread=True)).drop("text", "clean_text")


def op2_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path(RANKS))


def op3_html_extraction(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages", spread=True))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark, sf_dir):
    return substring.digests(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.groups_of(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_lm_scoring(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return license.scan(table(spark, sf_dir, "documents", spread=True))


def op10_suffix_dedup(spark, sf_dir):
    return suffix.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_byte_bpe,
        op3_html_extraction,
        op4_warc,
        op5_substring_dedup,
        op6_ngram_jaccard,
        op7_decontamination,
        op8_lm_scoring,
        op9_license_scan,
        op10_suffix_dedup,
    )
}

__all__ = ["ORACLES", "QUERIES"]
