"""Token counts through a digest cache.

Contents are joined to stored counts by (content digest, tokenizer digest). Only distinct
contents that the cache lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxrates.llm.common import digest_of, text_of
from boxrates.llm.ledger import extend
from boxrates.llm.pieces import byte_counter, version_of

CONTEXT = 1024


def _counter(path: str):
    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = byte_counter(path)
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return count


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, *, context: int = CONTEXT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file that every worker has;
    ``cache`` is a folder that all machines share and that later runs may use again.

    - NULL text counts as the empty text: 0 bytes, 0 tokens. No other normalisation is made,
      as each byte matters to byte-level tokens.
    - Equal texts are encoded once. Repeated rows give repeated results.
    - Other columns are ignored. An empty table gives an empty table.
    """
    blobs = docs.select(text_of().alias("text")).withColumn("digest", digest_of(F.col("text")))
    counts = extend(blobs, cache, version_of(tokenizer), _counter(tokenizer), T.LongType())
    rows = docs.select(
        "doc_id",
        F.octet_length(text_of()).cast("bigint").alias("n_bytes"),
        digest_of(text_of()).alias("digest"),
    )
    n = F.col("result")
    return rows.join(counts, "digest").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > context).alias("over_limit")
    )
