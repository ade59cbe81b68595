"""Searches of sparse directed graphs by eliminating nodes, so that rounds don't follow path lengths.

A round eliminates nodes that are no neighbours of each other and whose removal adds
few arcs: each way through such a node becomes one arc around it.  What remains has the
same distances between its nodes, a constant share fewer of them, and hubs are left
alone.  A path or a ring of n nodes is gone after some log n rounds.  Each round's
removed arcs are a table of their own, a level; none is written again.

A search goes up first, over arcs to later levels only, and over the arcs that were
never eliminated; then each level, from the last to the first, takes its distances from
later ones at once.  Settled distances are tables of their own, too.

Graphs are tables of keys: ``arcs (u, v, w)`` with non-negative ``w``; areas of one
table are told apart by their keys.  Loops are ignored, parallel arcs count by the least.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wayloom.session import written

#: Most arcs that the removal of a node may add, beyond those that it takes away.
FILL = 12
#: Arcs from which on a round is worth its while even if it takes a fiftieth of them.
LARGE = 1 << 20


@dataclass(frozen=True)
class Eliminated:
    """``levels``: ``node, other, w, out`` of the nodes of each round, ``out`` for arcs from the node; ``core``: ``u, v, w`` that remain."""

    levels: tuple[DataFrame, ...]
    core: DataFrame

    def turned(self) -> Eliminated:
        """The same for the graph with all arcs turned round."""
        levels = tuple(x.withColumn("out", ~F.col("out")) for x in self.levels)
        return replace(self, levels=levels, core=self.core.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _independent(arcs: DataFrame, turn: int, fill: int) -> DataFrame:
    """Nodes that add few arcs and come before all their neighbours."""
    flag = lambda a, b, out: arcs.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(out).alias("outs"))
    around = flag("u", "v", 1).union(flag("v", "u", 0))
    n, outs = F.count("*"), F.sum("outs")
    added = (n - outs) * outs - n
    of = around.groupBy("node").agg(added.alias("added")).withColumn("place", F.struct("added", F.xxhash64("node", F.lit(turn)).alias("h"), "node"))
    near = around.select("node", "other").join(of.select(F.col("node").alias("other"), "place"), "other").groupBy("node").agg(F.min("place").alias("first"))
    return of.where(F.col("added") <= fill).join(near, "node").where("place < first").select("node")


def eliminate(arcs: DataFrame, fill: int = FILL, max_rounds: int = 400) -> Eliminated:
    """Rounds until few nodes can go; what is then left is searched by rounds over arcs that reach far."""
    least = lambda rows: rows.groupBy("u", "v").agg(F.min("w").alias("w"))
    now, levels = written(least(arcs.where("u <> v").select("u", "v", F.col("w").cast("double").alias("w")))), []
    for turn in range(max_rounds):
        gone = _independent(now, turn, fill)
        at = lambda c: gone.select(F.col("node").alias(c), F.lit(True).alias(f"gone_{c}"))  # noqa: E731, B023
        out = F.col("gone_u").isNotNull()
        node, other = F.when(out, F.col("u")).when(F.col("gone_v"), F.col("v")), F.when(out, F.col("v")).otherwise(F.col("u"))
        marked = written(now.join(at("u"), "u", "left").join(at("v"), "v", "left").select("u", "v", "w", node.alias("node"), other.alias("other"), out.alias("out")))
        size, taken = marked.agg(F.count("*"), F.count("node")).first()
        # rounds over few rows cost as much as those over a core that is left, so they stop earlier
        if taken * (50 if size > LARGE else 5) < size or not size:
            break
        level = marked.where("node is not null").select("node", "other", "w", "out")
        around = level.where("not out").select("node", F.col("other").alias("u"), F.col("w").alias("w1"))
        around = around.join(level.where("out").select("node", F.col("other").alias("v"), F.col("w").alias("w2")), "node").where("u <> v").select("u", "v", (F.col("w1") + F.col("w2")).alias("w"))
        now = written(least(marked.where("node is null").select("u", "v", "w").union(around)))
        levels.append(level)
    return Eliminated(tuple(levels), now)


def _up(g: Eliminated, sources: DataFrame, max_rounds: int) -> DataFrame:
    """Distances over arcs to later levels and those of the core, by rounds over what has improved."""
    arcs = [x.where("out").select(F.col("node").alias("u"), F.col("other").alias("v"), "w") for x in g.levels]
    arcs = written(union([g.core.select("u", "v", "w"), *arcs]))
    key, least = ["search", "node"], lambda c: F.min(c).alias(c)
    best = written(sources.groupBy(*key).agg(F.min("d").cast("double").alias("d")).withColumn("moved", F.lit(True)))
    for _ in range(max_rounds):
        front = best.where("moved").withColumnRenamed("node", "u")
        if front.isEmpty():
            return best.drop("moved")
        step = front.join(arcs, "u").select("search", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("double").alias("old"))
        both = best.select(*key, "d", F.col("d").alias("old")).union(step).groupBy(*key).agg(least("d"), least("old"))
        best = written(both.select(*key, "d", F.expr("old is null or d < old").alias("moved")))
    raise RuntimeError("distances did not settle")


def distances(g: Eliminated, sources: DataFrame, max_rounds: int = 2000) -> DataFrame:
    """``search, node, d`` of all nodes that a search reaches; ``sources (search, node, d)``."""
    best = _up(g, sources, max_rounds)
    settled = [best]
    for level in reversed(g.levels):
        ins = level.where("not out").select("node", "other", "w")
        found = ins.join(union(settled).withColumnRenamed("node", "other"), "other").groupBy("search", "node").agg(F.min(F.col("d") + F.col("w")).alias("new"))
        # of a node that the way up has met, the smaller distance counts
        better = found.join(best, ["search", "node"], "left").select("search", "node", F.when(F.col("d") <= F.col("new"), None).otherwise(F.col("new")).alias("d"))
        settled.append(written(better.where("d is not null")))
    return union(settled).groupBy("search", "node").agg(F.min("d").alias("d"))


def predecessors(dist: DataFrame, arcs: DataFrame, digits: int = 6) -> DataFrame:
    """``search, node, before``: of the arcs on shortest paths into a node, the one from the smallest node."""
    own = dist.where("d > 0").select("search", "node")
    into = arcs.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))
    steps = dist.withColumnRenamed("node", "u").join(into, "u").select("search", F.col("v").alias("node"), "u", F.round(F.col("d") + F.col("w"), digits).alias("sum"))
    return steps.join(own, ["search", "node"], "left_semi").groupBy("search", "node").agg(F.min_by("u", F.struct("sum", "u")).alias("before"))


def paths(forest: DataFrame, targets: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``search, pos, node`` from each search's root to its target, by pointer jumping over ancestors.

    ``forest (search, node, before)``, ``targets (search, node)``: one of a search.
    """
    jump = written(forest)
    found = written(targets.select("search", "node", F.lit(0).cast("long").alias("back")))
    span = 1
    for _ in range(max_rounds):
        ahead = written(found.join(jump, ["search", "node"]).select("search", F.col("before").alias("node"), (F.col("back") + span).alias("back")))
        if ahead.isEmpty():
            break
        found = written(found.union(ahead))
        far = jump.select("search", F.col("node").alias("before"), F.col("before").alias("before2"))
        jump = written(jump.join(far, ["search", "before"]).select("search", "node", F.col("before2").alias("before")))
        span *= 2
    else:
        raise RuntimeError("the paths are no paths of a forest")
    last = found.groupBy("search").agg(F.max("back").alias("n"))
    return found.join(last, "search").select("search", (F.col("n") - F.col("back")).alias("pos"), "node")
