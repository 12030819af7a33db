"""Token counts by a public tokenizer whose rank file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.runtime import cut_lineage

#: Byte-level BPE ranks; every worker needs the file at this path.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as file:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``keep, n_tokens``: the tokens of each whole text; null and empty texts have 0. Written to the checkpoint folder, so texts are read once."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(ranks).encode_ordinary
        for texts in batches:
            yield pd.Series([0 if t is None else len(encode(t)) for t in texts], dtype="int64")

    return cut_lineage(documents.select(*keep, count(F.col(text)).alias("n_tokens")))
