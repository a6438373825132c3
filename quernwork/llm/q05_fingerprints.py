"""The query that fingerprints all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernwork.llm.lz_fingerprint import compare_neighbours
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """Fingerprints of every text and its edited copy, and how alike they are."""
    return compare_neighbours(tables.read("documents", "doc_id", "text"), "doc_id", "text")
