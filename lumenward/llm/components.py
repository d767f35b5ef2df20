"""Connected components of a table of links, by stars that grow.

Alternates two steps until nothing changes: every node hands the smallest node
it knows to its larger neighbours, then every node passes that on to its smaller
ones.  Rounds grow with the logarithm of the longest chain.  No node's neighbours
are ever gathered: a round is a minimum by node and a join, so a hub with very
many links is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.storage import Scratch, drop_table


def _large_star(links: DataFrame) -> DataFrame:
    """Links (u, v) with v < u; every larger neighbour of a node gets the node's smallest."""
    both = links.unionByName(links.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).selectExpr("u AS _u", "least(u, _m) AS _m")
    return both.where("v > u").join(least, F.col("u") == F.col("_u")).selectExpr("v AS u", "_m AS v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("_m")).selectExpr("u AS _u", "_m")
    moved = links.join(least, F.col("u") == F.col("_u")).where("v <> _m").selectExpr("v AS u", "_m AS v")
    return moved.unionByName(least.selectExpr("_u AS u", "_m AS v")).distinct()


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` of every node in a table of pairs (a, b); the component
    is the smallest node that can be reached.  Nodes without links are not listed."""
    links = pairs.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct()
    before, seen = None, None
    while True:
        links = scratch.table(_small_star(_large_star(links)), "stars")
        path = scratch.paths[-1]
        # A star forest is done when no centre is itself a leaf; comparing sums of hashes finds that out.
        state = links.selectExpr("count(*) AS n", "sum(cast(xxhash64(u, v) AS decimal(38, 0))) AS h").first()
        if before:
            scratch.paths.remove(before)
            drop_table(scratch.spark, before)
        if state == seen or not state.n:
            break
        before, seen = path, state
    centres = links.selectExpr("v AS node", "v AS component").distinct()
    return links.selectExpr("u AS node", "v AS component").unionByName(centres)
