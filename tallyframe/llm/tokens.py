"""Sizes of texts in tokens of a public tokenizer (byte-level BPE read from a rank file; nothing is trained)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.tokenizer import load

#: Default vocabulary; every operator that counts tokens takes the path of another one.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def encoding(path: str = TOKENIZER, pattern: str | None = None):
    """The tokenizer in the rank file at ``path``, loaded once a process."""
    return load(path, pattern)


def _count(path: str, text: str, pattern: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            sizes = [0 if t is None else len(encode(t)) for t in batch[text]]
            yield batch.drop(columns=[text]).assign(n_tokens=sizes)

    return run


def token_sizes(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """Columns ``keep`` (renamed to k0, k1, ..) and ``n_tokens``; NULL text has 0 tokens. Whole texts are counted."""
    named = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    fields = ", ".join(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return named.mapInPandas(_count(path, "__text", pattern), f"{fields}, n_tokens bigint")
