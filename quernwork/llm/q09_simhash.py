"""The query that finds near copies among all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.common import bounded_batches, stored
from quernwork.llm.simhash import classes, fingerprint
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """The fingerprint of every text, and the smallest document it is linked to."""
    bounded_batches(tables.spark)
    rows = tables.read("documents", "doc_id", "text")
    prints = stored(rows.select("doc_id", fingerprint(F.col("text")).alias("print")), "prints")
    return classes(prints, "doc_id", "print").select(
        "doc_id",
        F.lower(F.hex("print")).alias("fingerprint"),
        "component_id",
    )
