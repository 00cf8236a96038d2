"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Where the vocabulary files are; they are never copied here.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once in a process."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 of null and of the empty text."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        enc = encoding(folder, vocabulary)
        return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).fillna(0).astype("int64")

    return run(F.coalesce(text, F.lit("")))


def sized(docs: DataFrame, key: str, text: str, *more: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, more..., n_tokens."""
    slim = spread(docs.select(key, *more, text), key)
    return slim.select(key, *more, token_count(F.col(text), folder, vocabulary).alias("n_tokens"))
