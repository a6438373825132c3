"""The query that encodes and decodes all ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.bpe import encode_decoded
from quernwork.llm.common import bounded_batches
from quernwork.sources import Tables

VOCABULARY = "byte_bpe_50k.tiktoken"
# Short texts in each of two generations whose tokens a worker keeps, some 100 MB more
# than by default; no other operator runs beside this one.
TEXTS = 400_000


def run(tables: Tables) -> DataFrame:
    """Digests of the token ids of every text, and of the text they decode to."""
    bounded_batches(tables.spark)
    by = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = tables.read("documents").select("doc_id", encode_decoded(F.col("text"), *by, TEXTS).alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("both.ids", " "), 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )
