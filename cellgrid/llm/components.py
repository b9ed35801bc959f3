"""Connected components of an edge table that never leaves the cluster.

Alternates the large-star and small-star steps of Kiveris et al. (2014): each round points every
node's larger neighbours, then its smaller ones, at the least neighbour. Rounds end when the
edges no longer change; their number grows with the logarithm of the longest path, so the bound on
them (200) is met by no graph that fits on disks: passing it is an error, not a result. Every step is
an aggregation with partial results per task and an equi-join that Spark can split where a node
has very many edges, so no node's neighbours are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v after one star step."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        return moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    linked = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, and that to a node that has none: then each component is a star around its least node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    seen = ends.select("e.*").groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a and b): comp is the least node reachable."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = staged(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
