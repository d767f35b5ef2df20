"""Query of the near-duplicate vectors, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table
from lumenward.llm.itq_dedup import near_duplicates
from lumenward.storage import Scratch

LEAST = 0.98


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), LEAST, Scratch(spark))


# All pairs of a label, then reachability; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings
          UNION SELECT reach.vec_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT t.vec_id, (SELECT count(*) FROM e WHERE e.a = t.vec_id) AS n_links, m.c AS component_id, t.vec_id = m.c AS kept
FROM embeddings t JOIN (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id) m USING (vec_id)
"""
