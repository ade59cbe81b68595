"""Least costs by plain rounds of relaxation over a whole table, against which other searches are held.

No area has to fit a task.  Arcs are composed through nodes of few arcs first, so that a
round goes several arcs ahead; hubs are left out, since each pair of their arcs would be a row.
``elimination`` needs fewer rounds where paths are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayloom.session import written

#: Most ways through a node that arcs are composed over.
THROUGH = 16


def _composed(hop: DataFrame, within: list[str], doublings: int) -> DataFrame:
    """Least costs of up to ``2^doublings`` arcs on end."""
    for _ in range(doublings):
        hop = written(hop, "hops")
        count = lambda c: hop.groupBy(*within, F.col(c).alias("v")).agg(F.count("*").alias(f"n_{c}"))  # noqa: E731, B023
        narrow = count("u").join(count("v"), [*within, "v"]).where(f"n_u * n_v <= {THROUGH}").select(*within, "v")
        ahead = hop.select(*within, F.col("u").alias("v"), F.col("v").alias("w"), F.col("t").alias("t2"))
        two = hop.join(narrow, [*within, "v"], "left_semi").join(ahead, [*within, "v"]).where("u <> w").select(*within, "u", F.col("w").alias("v"), (F.col("t") + F.col("t2")).alias("t"))
        hop = hop.select(*within, "u", "v", "t").union(two).groupBy(*within, "u", "v").agg(F.min("t").alias("t"))
    return written(hop, "hops")


def relax(arcs: DataFrame, sources: DataFrame, cost: str = "time_s", within: tuple[str, ...] = ("area_id",), doublings: int = 2, max_rounds: int = 2000) -> DataFrame:
    """Least costs from the sources, by rounds of relaxation.

    ``arcs (*within, u, v, cost)``, ``sources (*within, node_id, ...)``: further columns of
    the sources tell searches apart.  Gives the columns of ``sources`` and the cost.
    """
    within, extra = list(within), [c for c in sources.columns if c not in (*within, "node_id")]
    key = [*within, *extra, "node_id"]
    hop = _composed(arcs.where("u <> v").groupBy(*within, "u", "v").agg(F.min(cost).cast("double").alias("t")), within, doublings)
    best = written(sources.select(*key).distinct().withColumns({"d": F.lit(0.0), "moved": F.lit(True)}))
    for _ in range(max_rounds):
        front = best.where("moved").select(*within, *extra, F.col("node_id").alias("u"), "d")
        if front.isEmpty():
            return best.select(*key, F.col("d").alias(cost))
        step = front.join(hop, [*within, "u"]).groupBy(*within, *extra, F.col("v").alias("node_id")).agg(F.min(F.col("d") + F.col("t")).alias("new"))
        both = best.drop("moved").join(step, key, "full")
        better = F.col("new").isNotNull() & (F.col("d").isNull() | (F.col("new") < F.col("d")))
        best = written(both.select(*key, F.when(better, F.col("new")).otherwise(F.col("d")).alias("d"), better.alias("moved")))
    raise RuntimeError("relaxation did not settle")
