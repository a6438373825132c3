"""The query that counts the tokens of all ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.common import bounded_batches
from quernwork.llm.token_counts import token_count
from quernwork.sources import Tables

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def run(tables: Tables) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``LIMIT`` tokens."""
    bounded_batches(tables.spark)
    counted = tables.read("documents", "doc_id", "text").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), public_tokenizers.path(VOCABULARY)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
