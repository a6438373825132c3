"""The query that scores all ``documents`` for quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernwork.llm.quality import THRESHOLD, Model, fit, score
from quernwork.sources import Tables

FOLDS = 5


def held_out(id_: Column) -> Column:
    """Whether a document's label is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fitted(documents: DataFrame, tables: Tables) -> Model:
    """A model of the labelled documents that are not held out."""
    labels = tables.read("labels", "doc_id", "quality").where(~held_out(F.col("doc_id")))
    return fit(documents, labels, "doc_id", "text", "quality")


def run(tables: Tables) -> DataFrame:
    """The score of every text, and whether it is taken as of quality 1."""
    documents = tables.read("documents", "doc_id", "text")
    scored = score(documents, fitted(documents, tables), "text")
    return documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), scored.alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
