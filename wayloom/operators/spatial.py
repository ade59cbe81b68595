"""Spatial joins between network nodes and areas.

Points and polygons meet in grid cells by an equi-join; only pairs in one cell
are tested.  Nothing is broadcast, so neither side is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayloom.operators.network import KX, KY, projected
from wayloom.session import written

CELL = 0.01
#: Degrees of latitude of a strip in which nodes meet edges.
STRIP = 0.001


def boundary_edges(points: DataFrame) -> DataFrame:
    """``area_id, ring_id, x1, y1, x2, y2``: edges of closed rings in (lon, lat)."""
    by = Window.partitionBy("area_id", "ring_id").orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return points.select("area_id", "ring_id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt("lon").alias("x2"), nxt("lat").alias("y2"))


def polygon_boxes(points: DataFrame) -> DataFrame:
    """``area_id, s, w, n, e``."""
    return points.groupBy("area_id").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))


def expand_box(boxes: DataFrame, metres: float) -> DataFrame:
    """Boxes grown on all sides."""
    dlat = F.lit(metres / KY)
    dlon = F.lit(metres) / (F.cos(F.radians((F.col("s") + F.col("n")) / 2)) * KX)
    grown = {"s": F.col("s") - dlat, "w": F.col("w") - dlon, "n": F.col("n") + dlat, "e": F.col("e") + dlon}
    return boxes.select(*[grown.get(c, F.col(c)).alias(c) for c in boxes.columns])


def union_box(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per area the smallest box around both."""
    o = b.select("area_id", *[F.col(c).alias(f"_{c}") for c in "swne"])
    both = a.join(o, "area_id")
    return both.select("area_id", *[F.least(c, f"_{c}").alias(c) for c in "sw"], *[F.greatest(c, f"_{c}").alias(c) for c in "ne"])


def in_box(nodes: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """``area_id`` with every node in the area's box."""
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = boxes.withColumn("cy", F.explode(steps("s", "n"))).withColumn("cx", F.explode(steps("w", "e")))
    keyed = nodes.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)})
    met = keyed.join(cells, ["cy", "cx"]).where("lat between s and n and lon between w and e")
    return met.select("area_id", *nodes.columns)


def points_in_areas(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """``area_id, node_id, ...`` of the nodes inside any ring of an area: even-odd, half-open in latitude.

    A node meets the edges of its own strip of latitude only.
    """
    near = in_box(nodes, polygon_boxes(points))
    lat, lon = F.col("lat"), F.col("lon")
    crosses = ((F.col("y1") > lat) != (F.col("y2") > lat)) & (lon < (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    strips = F.sequence(F.floor(F.least("y1", "y2") / STRIP), F.floor(F.greatest("y1", "y2") / STRIP))
    edges = boundary_edges(points).withColumn("strip", F.explode(strips))
    hits = near.withColumn("strip", F.floor(lat / STRIP)).join(edges, ["area_id", "strip"]).groupBy(*near.columns, "ring_id").agg(F.count_if(crosses).alias("k"))
    inside = hits.where("k % 2 = 1").select("area_id", "node_id").distinct()
    return near.join(inside, ["area_id", "node_id"], "left_semi")


def _cells_passed(edges: DataFrame, size: float) -> DataFrame:
    """``edges (ax, ay, bx, by, ...)`` once for each cell ``cx, cy`` that they pass through."""
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    at = lambda x: F.when(F.col("bx") == F.col("ax"), F.col("ay")).otherwise(F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / (F.col("bx") - F.col("ax")))
    rows = edges.withColumn("cx", F.explode(F.sequence(F.floor(left / size), F.floor(right / size))))
    y1, y2 = at(F.greatest(left, F.col("cx") * size)), at(F.least(right, (F.col("cx") + 1) * size))
    upright = F.col("ax") == F.col("bx")
    low, high = F.when(upright, F.least("ay", "by")).otherwise(F.least(y1, y2)), F.when(upright, F.greatest("ay", "by")).otherwise(F.greatest(y1, y2))
    return rows.withColumn("cy", F.explode(F.sequence(F.floor((low - 1e-6) / size), F.floor((high + 1e-6) / size))))


def distance_to_areas(nodes: DataFrame, points: DataFrame, cap_m: float, first_m: float = 128.0, max_rounds: int = 30) -> DataFrame:
    """``area_id, node_id, dist_m`` of nodes up to ``cap_m`` by the area's box: 0 inside, else metres to the boundary.

    Nodes meet the edges in their own and the eight cells around; what is found no farther than a
    cell's size is the nearest.  Other nodes go on to cells four times as large, so that a node meets
    edges of its surroundings only, and the few that are far from all edges meet far ones.
    """
    inner = points_in_areas(nodes, points).select("area_id", "node_id", F.lit(0.0).alias("dist_m"))
    near = in_box(nodes, expand_box(polygon_boxes(points), cap_m * 1.01 + 1)).join(inner, ["area_id", "node_id"], "left_anti")
    plane = polygon_boxes(points).join(points.groupBy("area_id").agg((F.cos(F.radians(F.avg("lat"))) * KX).alias("kx")), "area_id")
    px, py, kx = F.col("lon") * F.col("kx"), F.col("lat") * KY, F.col("kx")
    beyond = lambda p, lo, hi: F.greatest(lo - p, F.lit(0.0), p - hi)
    box_x, box_y = beyond(px, F.col("w") * kx, F.col("e") * kx), beyond(py, F.col("s") * KY, F.col("n") * KY)
    open_ = written(near.join(plane, "area_id").where(F.sqrt(box_x * box_x + box_y * box_y) <= cap_m).select("area_id", "node_id", px.alias("px"), py.alias("py")))
    edges = boundary_edges(points).join(plane, "area_id")
    ends = {"ax": F.col("x1") * kx, "ay": F.col("y1") * KY, "bx": F.col("x2") * kx, "by": F.col("y2") * KY}
    dx, dy = (F.col("x2") - F.col("x1")) * kx, (F.col("y2") - F.col("y1")) * KY
    edges = written(edges.select("area_id", *[c.alias(k) for k, c in ends.items()], dx.alias("dx"), dy.alias("dy")))
    l2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    t = F.when(l2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("ax")) * F.col("dx") + (F.col("py") - F.col("ay")) * F.col("dy")) / l2)))
    d = F.sqrt(F.pow(F.col("px") - F.col("ax") - t * F.col("dx"), 2) + F.pow(F.col("py") - F.col("ay") - t * F.col("dy"), 2))
    around, found, size = F.array(*[F.lit(k) for k in (-1, 0, 1)]), [inner], first_m
    for _ in range(max_rounds):
        cells = open_.withColumn("kx", F.explode(around)).withColumn("ky", F.explode(around))
        cells = cells.withColumns({"cx": F.floor(F.col("px") / size) + F.col("kx"), "cy": F.floor(F.col("py") / size) + F.col("ky")})
        met = cells.join(_cells_passed(edges, size), ["area_id", "cx", "cy"]).groupBy("area_id", "node_id").agg(F.min(d).alias("dist_m"))
        both = written(open_.join(met, ["area_id", "node_id"], "left"))
        sure = F.coalesce(F.col("dist_m") <= size * 0.999, F.lit(False))
        found.append(both.where(sure).select("area_id", "node_id", "dist_m"))
        open_ = both.where(~sure).drop("dist_m")
        if open_.isEmpty():
            return reduce(DataFrame.union, found)
        size *= 4
    raise RuntimeError("nodes without an edge of their area")


def clip(street: DataFrame, arcs: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streets and arcs of each area, both ends among its nodes."""
    keep = inside.select("area_id", "node_id")

    def both(x: DataFrame) -> DataFrame:
        at_u = x.join(keep.withColumnRenamed("node_id", "u"), "u")
        return at_u.join(keep.withColumnRenamed("node_id", "v"), ["area_id", "v"], "left_semi").select("area_id", *x.columns)

    return both(street), both(arcs)


def gateways(street: DataFrame, inside: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """``area_id, node_id``: nodes inside with a street to a node outside; ``reach`` bounds how far out that is."""
    ends = street.select("u", "v").union(street.select(F.col("v").alias("u"), F.col("u").alias("v")))
    keep = inside.select("area_id", "node_id")
    out = ends.join(keep.withColumnRenamed("node_id", "u"), "u").join(keep.withColumnRenamed("node_id", "v"), ["area_id", "v"], "left_anti")
    if reach is not None:
        out = out.join(reach.select("area_id", F.col("node_id").alias("v")), ["area_id", "v"], "left_semi")
    return out.select("area_id", F.col("u").alias("node_id")).distinct()


def street_class(dist_u: Column, dist_v: Column) -> Column:
    inner = (dist_u == 0).cast("int") + (dist_v == 0).cast("int")
    return F.when(inner == 2, "internal").when(inner == 1, "boundary").otherwise("external")


def tunnel_gateways(street: DataFrame, geom: DataFrame, inside: DataFrame, gates: DataFrame, tunnel_nodes: DataFrame, centre: DataFrame, tol_m: float = 2.0) -> DataFrame:
    """``area_id, node_id, tunnels``: gateways whose exit street touches a tunnel way, within ``tol_m``.

    ``tunnel_nodes``: ``lat, lon, name``.  Points of both kinds are projected around the area's
    ``centre`` and meet in cells of the tolerance's size, with their neighbours.
    """
    ends = street.select("street_id", "u", "v").union(street.select("street_id", F.col("v").alias("u"), F.col("u").alias("v")))
    keep = inside.select("area_id", "node_id")
    exits = ends.join(keep.withColumnRenamed("node_id", "u"), "u").join(keep.withColumnRenamed("node_id", "v"), ["area_id", "v"], "left_anti")
    exits = exits.withColumnRenamed("u", "node_id").join(gates, ["area_id", "node_id"], "left_semi")
    pts = exits.join(geom, "street_id").select("area_id", "node_id", F.explode("geom").alias("p")).select("area_id", "node_id", "p.lon", "p.lat")
    # tunnel nodes of an area: those in the box of its exit streets
    boxes = expand_box(polygon_boxes(pts), 2 * tol_m)
    near = projected(in_box(tunnel_nodes, boxes), centre).select("area_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "name")
    grid = lambda c: F.floor(F.col(c) / tol_m)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    pts = projected(pts, centre).withColumns({"cx": grid("x"), "cy": grid("y")})
    t = near.withColumn("kx", F.explode(around)).withColumn("ky", F.explode(around))
    t = t.select("area_id", "tx", "ty", "name", (grid("tx") + F.col("kx")).alias("cx"), (grid("ty") + F.col("ky")).alias("cy"))
    met = pts.join(t, ["area_id", "cx", "cy"]).where(F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) < tol_m)
    return met.groupBy("area_id", "node_id").agg(F.array_sort(F.collect_set("name")).alias("tunnels"))
