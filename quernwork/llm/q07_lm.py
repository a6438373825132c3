"""The query that scores all ``documents`` with a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.kneser_ney import score
from quernwork.sources import Tables

FOLDS, HELD = 7, 2


def run(tables: Tables) -> DataFrame:
    """Scores of every text; those that are held out are not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    documents = tables.read("documents", "doc_id", "text")
    # A null id is in no fold, so it is learned from.
    learn = F.coalesce(fold != HELD, F.lit(True))
    scored = score(documents, "doc_id", "text", learn)
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), *columns)
