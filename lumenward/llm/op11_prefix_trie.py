"""Query of the conversation prefix trie, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table
from lumenward.llm.prefix_trie import prefix_trie
from lumenward.storage import Scratch


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"), Scratch(spark))


# Every prefix as a list of digests, and every subtree as a join with the paths through it; for
# small tables.  The checksum is computed bit by bit.
ORACLE_SQL = r"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
    4294967295::BIGINT) % 4 AS shared FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS MATERIALIZED (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM (
    SELECT c.conv_id, 0 AS own, t.place, t.digest, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.shared
    UNION ALL
    SELECT c.conv_id, 1, t.place, t.digest, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.shared)),
lengths AS (SELECT c.conv_id, coalesce(max(depth), 0) AS n FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
paths AS MATERIALIZED (
  SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (
  SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.n = depth), '')) AS ends_sha256
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY path, depth),
edges AS MATERIALIZED (
  SELECT n.path, n.depth, up.path AS parent, owner.conv_id AS parent_conv_id FROM nodes n
  JOIN paths up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 JOIN nodes owner ON owner.path = up.path AND owner.depth = up.depth),
children AS (SELECT parent AS path, count(*) AS n FROM edges GROUP BY parent),
-- Each node lies in the subtrees of all prefixes of its smallest member.
sums AS (
  SELECT up.path, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.path = n.path JOIN paths up ON up.conv_id = n.conv_id AND up.depth <= n.depth GROUP BY up.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, e.parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN edges e USING (path) LEFT JOIN children c USING (path) JOIN sums s USING (path)
"""
