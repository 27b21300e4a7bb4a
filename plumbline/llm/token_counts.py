"""Token counts by lookups on the map side.

A worker's cache holds the counts of whole white-space pieces. What misses it is split into
pre-tokens, looked up in a compact hash table, broadcast once: the vocabulary's own entries, at
most as many as the vocabulary has, whatever the corpus. What misses that as well is encoded
once and kept in a second cache. Texts stay in their tasks: there is
no shuffle, of pre-tokens or of anything else.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; a text that
holds the vocabulary's special string is encoded whole, by the tokenizer's default; repeated
rows are counted each; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pretokens import TokenCounter, vocabulary_lengths

LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``_pl_bytes``, ``_pl_tokens`` and ``_pl_over_limit``. ``vocabulary`` is the
    path of a byte-level tokenizer file that driver and executors have."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary_lengths(vocabulary))

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(vocabulary, table.value)
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumns(
        {
            "_pl_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
            "_pl_tokens": tokens(F.col(text)),
        }
    ).withColumn("_pl_over_limit", F.col("_pl_tokens") > limit)
