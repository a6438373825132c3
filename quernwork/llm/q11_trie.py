"""The query that builds the trie of all rebuilt ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernwork.llm.prefix_trie import rebuilt, trie
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie(rebuilt(tables.read("conversations", "conv_id", "turn", "role", "text")))


# Of a node's subtree SQL takes every pair of a prefix and a longer one of each conversation.
SQL = """
WITH turns AS (
  SELECT conv_id,
         list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
              ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shares AS (
  SELECT conv_id, own,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT],
                       list_transform(range(1, length(conv_id::VARCHAR) + 1),
                                      lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                    lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM turns),
built AS (
  SELECT s.conv_id, list_concat(coalesce(b.own, [])[1:s.h], s.own[s.h + 1:]) AS path
  FROM shares s LEFT JOIN turns b ON b.conv_id = s.conv_id - s.conv_id % 5),
steps AS (
  SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM built),
reached AS (
  SELECT conv_id, depth, len(path) AS n, sha256(path[1:depth]::JSON::VARCHAR) AS node,
         sha256(path[1:depth - 1]::JSON::VARCHAR) AS parent,
         CASE WHEN depth > 0 THEN octet_length(encode(path[depth].text)) ELSE 0 END AS size
  FROM steps),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(n) = depth AS leaf, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), ''))
           AS ends_sha256
  FROM reached GROUP BY node, depth),
within AS (
  SELECT DISTINCT a.node, a.depth, b.node AS lower, b.depth AS lower_depth
  FROM reached a JOIN reached b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
totals AS (
  SELECT w.node, w.depth, sum(n.leaf::INTEGER) AS n_leaves, sum(n.saved) AS saved_tokens,
         sum((n.depth = w.depth + 1)::INTEGER) AS n_children
  FROM within w JOIN nodes n ON n.node = w.lower AND n.depth = w.lower_depth GROUP BY ALL)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id,
       n.n_convs::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.node = n.node AND t.depth = n.depth
LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1
"""
