"""The query that removes repeated strings from all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.repeats import remove_repeats
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """What is removed of every text, and a digest of what is left."""
    found = remove_repeats(tables.read("documents", "doc_id", "text"), "doc_id", "text")
    return found.select(
        "doc_id",
        "repeats.n_bytes",
        "repeats.n_removed",
        "repeats.n_spans",
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )
