"""Token counts: runs of non-blank characters, or byte-level BPE tokens of a rank file."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import word_count

#: Pieces that are never merged with each other: a fixed value that goes with the ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str):
    """The encoder of a rank file (base64 of the token and its rank on each line), once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_count(c: Column, path: str) -> Column:
    """BPE tokens of a text; null has none. The file has to be on every worker."""

    @F.pandas_udf("bigint")
    def count(text: pd.Series) -> pd.Series:
        words = encoder(path)
        return text.map(lambda t: len(words.encode_ordinary(t)) if t else 0).astype("int64")

    return count(c)


def counter(path: str = "") -> Callable[[Column], Column]:
    """What tokens are counted with: BPE if there is a rank file, else words."""
    return (lambda c: bpe_count(c, path)) if path else word_count
