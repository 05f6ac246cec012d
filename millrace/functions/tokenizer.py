"""Pluggable tokenizers: the native default, and byte-level vocabularies by rank file."""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

try:
    import tiktoken
except ImportError:
    tiktoken = None

# Fixed value: the pattern that byte-level vocabularies of this kind are built with.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class DefaultTokenizer:
    """Tokens as :data:`millrace.functions.text.TOKEN` has them, each with the white space before it, so decoding gives the text back."""

    def encode(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(rf"\s*(?:{T.TOKEN})|\s+\z"), F.lit(0))

    def decode(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    if tiktoken is None:
        raise ImportError("a vocabulary tokenizer needs tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class VocabularyTokenizer:
    """Ids of a byte-level vocabulary; ``path`` is a rank file that every executor has."""

    path: str
    pattern: str = WORD_PATTERN

    def encode(self, text: Column) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            one = _encoding(path, pattern)
            return texts.map(lambda t: None if t is None else one.encode_ordinary(t))

        return run(text)

    def decode(self, tokens: Column) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("string")
        def run(ids: pd.Series) -> pd.Series:
            one = _encoding(path, pattern)
            return ids.map(lambda x: None if x is None else one.decode(list(x)))

        return run(tokens)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))
