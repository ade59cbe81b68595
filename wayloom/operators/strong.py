"""Strong components of a whole table of arcs at once, and which closures break the strong cores.

Components: nodes are eliminated as in ``elimination``; the few that remain are trimmed
and coloured: the largest key that reaches a node goes forward in rounds, then those
that reach their colour's node within the colour are its component, and the rest begins
again.  Going back over the levels, a node belongs to the component that it has both an
arc from and an arc to, or is one of its own; no two components can meet that.

Closures (a pair of nodes, or a node) are bits, 64 in a number.  A node that reaches the
root over a tree that a closure leaves alone is safe; the others, found by pointer
jumping over the trees' ancestors, are lost until they have an arc from one that is not,
in rounds over lost nodes only.  Cost: rows are (lost node, 64 closures); rounds follow
the longest detour inside one lost part, not the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayloom.operators.elimination import Eliminated, distances, predecessors, union
from wayloom.session import written


def coloured(arcs: DataFrame, max_rounds: int = 2000) -> DataFrame:
    """``node, scc`` of the nodes of ``arcs (u, v)`` whose component has others, by the largest key of each."""
    live = written(arcs.where("u <> v").select("u", "v").distinct())
    done = None
    for _ in range(max_rounds):
        # nodes without an arc from, or without an arc to another are on no ring
        live = written(live.join(live.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(live.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))
        if live.isEmpty():
            break
        colour = written(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        for _ in range(max_rounds):
            step = colour.where("moved").join(live, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "colour", F.lit(None).cast("long").alias("old"))
            both = colour.select("node", "colour", F.col("colour").alias("old")).union(step).groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old"))
            colour = written(both.select("node", "colour", (F.col("colour") > F.col("old")).alias("moved")))
            if colour.where("moved").isEmpty():
                break
        # back from each colour's own node, within the colour
        at = lambda c: colour.select(F.col("node").alias(c), "colour")  # noqa: E731, B023
        own = written(live.join(at("u"), "u").join(at("v"), ["v", "colour"]).select("u", "v"))
        found = written(colour.where("node = colour").select("node", F.lit(True).alias("moved")))
        for _ in range(max_rounds):
            step = found.where("moved").join(own, F.col("node") == F.col("v")).select(F.col("u").alias("node"), F.lit(True).alias("moved"))
            found = written(found.select("node", F.lit(False).alias("moved")).union(step).groupBy("node").agg(F.bool_and("moved").alias("moved")))
            if found.where("moved").isEmpty():
                break
        scc = written(colour.join(found, "node", "left_semi").select("node", F.col("colour").alias("scc")))
        done = scc if done is None else done.union(scc)
        gone = lambda c: scc.select(F.col("node").alias(c))  # noqa: E731, B023
        live = written(live.join(gone("u"), "u", "left_anti").join(gone("v"), "v", "left_anti"))
    else:
        raise RuntimeError("components did not settle")
    return arcs.sparkSession.createDataFrame([], "node long, scc long") if done is None else done


def strong_components(g: Eliminated) -> DataFrame:
    """``node, scc`` of all nodes with an arc; ``scc`` is the component's smallest key."""
    core = coloured(g.core)
    every = g.core.select(F.explode(F.array("u", "v")).alias("node"))
    if g.levels:  # and nodes that stayed until they had no arc
        levels = union(list(g.levels))
        every = every.union(levels.select("other")).distinct().join(levels.select("node"), "node", "left_anti")
    settled = [written(every.distinct().join(core, "node", "left").select("node", F.coalesce("scc", "node").alias("scc")))]
    for level in reversed(g.levels):
        labels = union(settled).select(F.col("node").alias("other"), "scc")
        met = level.join(labels, "other").groupBy("node", "scc").agg(F.bool_or("out").alias("o"), F.bool_or(~F.col("out")).alias("i")).where("o and i").select("node", "scc")
        nodes = level.select("node").distinct()
        settled.append(written(nodes.join(met, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))))
    found = union(settled)
    least = found.groupBy("scc").agg(F.min("node").alias("least"))
    return found.join(least, "scc").select("node", F.col("least").alias("scc"))


def _on_the_way(forest: DataFrame, bits: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, chunk, mask``: closures on each node's way from its root, by pointer jumping; ``bits`` are those of its own step."""
    jump = written(forest.select("node", "before"))
    seen = written(bits)
    for _ in range(max_rounds):
        if jump.isEmpty():
            return seen
        above = jump.join(seen.withColumnRenamed("node", "before"), "before").select("node", "chunk", "mask")
        seen = written(seen.union(above).groupBy("node", "chunk").agg(F.bit_or("mask").alias("mask")))
        far = jump.select(F.col("node").alias("before"), F.col("before").alias("before2"))
        jump = written(jump.join(far, "before").select("node", F.col("before2").alias("before")))
    raise RuntimeError("the ways don't end at roots")


def _lost(arcs: DataFrame, begin: DataFrame, blocked: DataFrame, shut: DataFrame, max_rounds: int = 2000) -> DataFrame:
    """``node, chunk, mask``: nodes that a closure parts from the root.

    ``begin``: nodes whose way in the tree is closed.  A closure stays if every arc into the node
    comes from a lost one or is blocked, or if it shuts the node itself.
    """
    lost, key = written(begin), ["node", "chunk"]
    into = arcs.select(F.col("v").alias("node"), F.col("u").alias("other")).join(blocked.select("node", "other", F.col("chunk").alias("on"), F.col("mask").alias("bit")), ["node", "other"], "left")
    into = written(into)
    before = None
    for _ in range(max_rounds):
        now = lost.agg(F.count("*"), F.sum(F.bit_count("mask"))).first()
        if now == before or not now[0]:
            return lost
        before = now
        other = lost.select(F.col("node").alias("other"), "chunk", F.col("mask").alias("theirs"))
        closed = F.coalesce("theirs", F.lit(0)).bitwiseOR(F.when(F.col("on") == F.col("chunk"), F.col("bit")).otherwise(0))
        kept = lost.join(into, "node").join(other, ["other", "chunk"], "left").groupBy("node", "chunk", "mask").agg(F.bit_and(closed).alias("all"))
        kept = kept.join(shut.withColumnRenamed("mask", "own"), key, "left")
        mask = F.col("mask").bitwiseAND(F.col("all").bitwiseOR(F.coalesce("own", F.lit(0))))
        lost = written(kept.select(*key, mask.alias("mask")).where("mask <> 0"))
    raise RuntimeError("closures did not settle")


def numbered_bits(closures: DataFrame) -> DataFrame:
    """``closures`` with ``chunk`` and ``mask``, a bit of their own in 64; written, since numbers come from partitions."""
    n = F.monotonically_increasing_id()
    return written(closures.withColumn("n", n).withColumns({"chunk": F.shiftright("n", 6), "mask": F.expr("shiftleft(1L, cast(n % 64 as int))")}).drop("n"))


def breaking_closures(g: Eliminated, arcs: DataFrame, core: DataFrame, closures: DataFrame) -> DataFrame:
    """Those of ``closures (group, lo, hi)`` without which the rest of their group's core is not strongly connected.

    ``core (group, node)``: the nodes of each strong core; ``arcs (u, v, w)`` of the graph that ``g`` comes from.
    A closure with ``lo = hi`` shuts that node; others close the arcs between the two, both ways.
    """
    inside = lambda c: core.select(F.col("node").alias(c))
    own = written(arcs.where("u <> v").join(inside("u"), "u", "left_semi").join(inside("v"), "v", "left_semi").groupBy("u", "v").agg(F.min("w").alias("w")))
    first = core.groupBy("group").agg(F.min("node").alias("root"))
    second = core.join(first, "group").where("node <> root").groupBy("group").agg(F.min("node").alias("second"))
    roots = written(first.join(second, "group"))  # a core of one node has nothing to break
    marked = closures.join(roots, "group").select("group", "lo", "hi", ((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("root"))).alias("of_root"))
    marked = numbered_bits(marked.repartitionByRange("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi"))
    # the root itself is shut in a search of its own, from the second node
    sources = roots.select(F.lit(0).alias("search"), F.col("root").alias("node"), F.lit(0.0).alias("d")).union(roots.select(F.lit(1), "second", F.lit(0.0)))
    broken = None
    for turned in (False, True):
        way = own.select(F.col("v").alias("u"), F.col("u").alias("v"), "w") if turned else own
        dist = written(distances(g.turned() if turned else g, sources).join(core.select("node"), "node", "left_semi"))
        forest = written(predecessors(dist, way))
        begin = []
        for search in (0, 1):
            tree = forest.where(F.col("search") == search).select("node", "before")
            some = marked.where("of_root" if search else "not of_root")
            steps = tree.withColumns({"lo": F.least("node", "before"), "hi": F.greatest("node", "before")})
            of_step = steps.join(some, ["lo", "hi"]).select("node", "chunk", "mask")
            of_node = some.where("lo = hi").select(F.col("lo").alias("node"), "chunk", "mask")
            bits = of_step.union(of_node).groupBy("node", "chunk").agg(F.bit_or("mask").alias("mask"))
            begin.append(_on_the_way(tree, bits))
        pairs = marked.where("lo <> hi")
        blocked = pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other"), "chunk", "mask").union(pairs.select("hi", "lo", "chunk", "mask"))
        shut = marked.where("lo = hi").select(F.col("lo").alias("node"), "chunk", "mask")
        both = union(begin).groupBy("node", "chunk").agg(F.bit_or("mask").alias("mask"))
        left = _lost(way, both, blocked, shut)
        rest = left.join(shut.withColumnRenamed("mask", "own"), ["node", "chunk"], "left").select("chunk", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0).cast("long")))).alias("mask"))
        rest = written(rest.groupBy("chunk").agg(F.bit_or("mask").alias("bad")))
        broken = rest if broken is None else broken.union(rest)
    hit = broken.groupBy("chunk").agg(F.bit_or("bad").alias("bad"))
    return marked.join(hit, "chunk").where(F.col("bad").bitwiseAND(F.col("mask")) != 0).select("group", "lo", "hi")
