"""Connected components by alternating star contraction.

Every round replaces each edge by edges to the smallest neighbour of its ends
(large star), then of the smaller ends only (small star).  Rounds are
logarithmic in the longest path, whatever the diameter, and each is two
shuffles with map-side minimum, so a hub node costs no more than its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayloom.session import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One large (``both``) or small star over edges (u > v)."""
    around = edges.select("u", "v")
    if both:
        around = around.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    pairs = around.join(least, "u")
    if both:
        out = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an end that has only smaller neighbours keeps its edge to the least of them
        out = out.union(least.where("m < u").select("u", F.col("m").alias("v")))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``(node, component)``.

    Edges are undirected; loops, nulls and repeats are ignored.  Nodes without
    an edge are absent: left-join the result and coalesce to the node itself.
    """
    col: Column = F.col
    e = cut(
        edges.where(col(a).isNotNull() & col(b).isNotNull() & (col(a) != col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = cut(_star(_star(e, True), False))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
