"""The query over ``documents`` that mixes their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.common import stored
from quernwork.llm.mixing import mix, random_key, words
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """How many words of every document the mix takes."""
    sized = tables.read("documents").select(
        "doc_id",
        "source",
        words(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    # Written once, so that texts are read once.
    mixed = mix(stored(sized, "sizes"), "source", "size", "key")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce('=' || doc_id, '-') || ':' || coalesce('=' || text, '-')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT
             - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW
                                 AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM sources
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
level AS (SELECT level FROM levels WHERE 2 * source_size > level * weight
          ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST LIMIT 1),
dealt AS (
  SELECT source, source_size,
         CASE WHEN level.level IS NULL OR 2 * source_size <= level.level * weight
              THEN (2 * source_size)::DOUBLE ELSE weight * level.level END AS target
  FROM levels LEFT JOIN level ON true),
run AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size
              ELSE 0 END AS whole,
         (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                          ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, budget - whole * source_size
                                               - (upto - size))))::BIGINT AS taken
FROM run
"""
