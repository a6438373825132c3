"""The query that searches ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.topk import top_inner_products, whole_vectors
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """The 5 best other rows for every row whose vec_id is divisible by 50."""
    vectors = whole_vectors(tables.read("embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return top_inner_products(vectors, vectors.where(F.col("id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS whole
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_dot_product(q.whole, v.whole)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 5
"""
