"""Derived tables that many queries share, built once a session and input and kept in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.functions import fixture, graphs as gr
from wayloom.operators import components as cc, elimination as el, network, spatial, strong, weak
from wayloom.operators.scenarios import graph_rows
from wayloom.session import written

MARGIN_M = 300.0
RADII = (0, 200, 400, 800)
_kept: dict[tuple, DataFrame] = {}
_sizes: dict[tuple, int] = {}


def table(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Build once, write, and read from there."""

    @wraps(fn)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _kept:
            _kept[key] = written(fn(spark, sf_dir), fn.__name__, keep=True)
        return _kept[key]

    return get


def forget(*keep: str) -> None:
    """Tables of other names are built again when they are next asked for, as after a change of the input."""
    for key in [k for k in _kept if k[2] not in keep]:
        del _kept[key]


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture.views(spark, sf_dir)


@table
def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir)["nodes"]


@table
def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir)["ways"]


@table
def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir)["boundary_pts"]


@table
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.segments(network.drivable(ways(spark, sf_dir)), raw_nodes(spark, sf_dir))


@table
def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.chains(segments(spark, sf_dir))


@table
def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.streets(chains(spark, sf_dir))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.arcs_of(streets(spark, sf_dir))


@table
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.network_nodes(chains(spark, sf_dir), raw_nodes(spark, sf_dir))


@table
def area_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_areas(nodes(spark, sf_dir), boundary(spark, sf_dir))


@table
def area_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clip(streets(spark, sf_dir), arcs(spark, sf_dir), area_nodes(spark, sf_dir))[0]


@table
def area_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clip(streets(spark, sf_dir), arcs(spark, sf_dir), area_nodes(spark, sf_dir))[1]


def within_margin(spark: SparkSession, sf_dir: str, margin_m: float = MARGIN_M) -> DataFrame:
    boxes = spatial.expand_box(spatial.polygon_boxes(boundary(spark, sf_dir)), margin_m)
    return spatial.in_box(nodes(spark, sf_dir), boxes).select("area_id", "node_id")


@table
def area_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean point of the raw nodes around each area."""
    boxes = spatial.expand_box(spatial.polygon_boxes(boundary(spark, sf_dir)), MARGIN_M)
    return network.centres(spatial.in_box(raw_nodes(spark, sf_dir), boxes))


def exits(spark: SparkSession, sf_dir: str, margin_m: float = MARGIN_M) -> DataFrame:
    return spatial.gateways(streets(spark, sf_dir), area_nodes(spark, sf_dir), within_margin(spark, sf_dir, margin_m))


@table
def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``area_id, node_id, node``: one number for each area's node, in the order of both."""
    return numbered(area_nodes(spark, sf_dir))


def numbered(nodes_: DataFrame) -> DataFrame:
    """Numbers come from sorted ranges, so the result has to be written before it is used twice."""
    order = ["area_id", "node_id"]
    return nodes_.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())


def keyed(ends: DataFrame, keys: DataFrame, **names: str) -> DataFrame:
    """``ends`` with the number of each column of node ids that is named."""
    for name, col in names.items():
        ends = ends.join(keys.select("area_id", F.col("node_id").alias(col), F.col("node").alias(name)), ["area_id", col])
    return ends


def named(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """``pairs (lo, hi, ...)`` of numbers as pairs of an area's node ids."""
    at = lambda c: keys.select("area_id", F.col("node_id").alias(f"_{c}"), F.col("node").alias(c))
    both = pairs.join(at("lo"), "lo").join(at("hi"), ["area_id", "hi"]).drop("lo", "hi")
    return both.withColumnsRenamed({"_lo": "lo", "_hi": "hi"})


@table
def key_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``area_id, a, b``: streets by the numbers of their ends."""
    own = area_streets(spark, sf_dir).select("area_id", F.col("u").alias("from"), F.col("v").alias("to"))
    return keyed(own, node_keys(spark, sf_dir), a="from", b="to").select("area_id", "a", "b")


@table
def key_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u, v, w``: arcs by the numbers of their ends, with their times."""
    own = area_arcs(spark, sf_dir).select("area_id", F.col("u").alias("from"), F.col("v").alias("to"), F.col("time_s").alias("w"))
    return keyed(own, node_keys(spark, sf_dir), u="from", v="to").select("u", "v", "w")


def _kept_graph(spark: SparkSession, sf_dir: str, name: str, arcs_: Callable[[], DataFrame]) -> el.Eliminated:
    """A graph's elimination, written once a session and input, a folder a level."""
    at = lambda what: (spark.sparkContext.applicationId, sf_dir, f"{name}_{what}")
    if at("core") not in _kept:
        g = el.eliminate(arcs_())
        own = [x.withColumn("level", F.lit(i)) for i, x in enumerate(g.levels)]
        none = g.core.select(F.col("u").alias("node"), F.col("v").alias("other"), "w", F.lit(True).alias("out"), F.lit(-1).alias("level")).limit(0)
        _kept[at("levels")] = written(el.union([none, *own]), f"{name}-levels", keep=True, by=("level",))
        _kept[at("core")] = written(g.core, f"{name}-core", keep=True)
        _sizes[at("core")] = len(g.levels)
    levels = _kept[at("levels")]
    return el.Eliminated(tuple(levels.where(F.col("level") == i).drop("level") for i in range(_sizes[at("core")])), _kept[at("core")])


def time_graph(spark: SparkSession, sf_dir: str) -> el.Eliminated:
    """Arcs with their times."""
    return _kept_graph(spark, sf_dir, "time_graph", lambda: key_arcs(spark, sf_dir))


def hop_graph(spark: SparkSession, sf_dir: str) -> el.Eliminated:
    """Streets both ways, each of length one."""
    s = key_streets(spark, sf_dir)
    return _kept_graph(spark, sf_dir, "hop_graph", lambda: s.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w")).union(s.select("b", "a", F.lit(1.0))))


def searched(g: el.Eliminated, sources: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns of ``sources (area_id, node_id, ...)`` but its node, with ``node_id`` and ``d`` of all nodes reached; other columns tell searches apart."""
    extra = [c for c in sources.columns if c not in ("area_id", "node_id")]
    own = keyed(sources, keys, node="node_id")
    found = el.distances(g, own.select(F.concat_ws("/", "area_id", *extra).alias("search"), "node", F.lit(0.0).alias("d")))
    names = own.select(F.concat_ws("/", "area_id", *extra).alias("search"), *extra).distinct()
    out = found.join(keys, "node").join(names, "search")
    return out.select("area_id", *extra, "node_id", "d")


def flagged_parts(keys: DataFrame, streets_: DataFrame, g: el.Eliminated) -> DataFrame:
    """``area_id, node_id, component, scc, giant, core`` of numbered nodes: components by star contraction, strong ones by elimination."""
    comp, scc = cc.components(streets_), strong.strong_components(g).withColumnRenamed("scc", "_scc")
    rows = keys.join(comp.withColumnRenamed("component", "_component"), "node", "left").join(scc, "node", "left")
    rows = written(rows.select("area_id", "node_id", *[F.coalesce(c, "node").alias(c) for c in ("_component", "_scc")]), "labels")
    for label, flag in (("_component", "giant"), ("_scc", "core")):
        # of the parts of an area the largest, and of such the one with the smallest number
        size = rows.groupBy("area_id", label).agg(F.count("*").alias("size"), F.min("node_id").alias(label[1:]))
        most = size.groupBy("area_id").agg(F.min_by(label, F.struct(-F.col("size"), label)).alias("most"))
        rows = rows.join(size.drop("size").join(most, "area_id").select("area_id", label, label[1:], (F.col(label) == F.col("most")).alias(flag)), ["area_id", label])
    return rows.select("area_id", "node_id", "component", "scc", "giant", "core")


@table
def area_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_parts(node_keys(spark, sf_dir), key_streets(spark, sf_dir), time_graph(spark, sf_dir))


def street_structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes with their numbers of streets, and the tour of a spanning forest of all areas."""
    return tuple(fn(spark, sf_dir) for fn in (_pairs, _tour))


@table
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.pairs_of(key_streets(spark, sf_dir))


@table
def _tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.tour_of(_pairs(spark, sf_dir))


@table
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateways in the giant undirected component."""
    return exits(spark, sf_dir).join(area_parts(spark, sf_dir).where("giant"), ["area_id", "node_id"], "left_semi")


def flagged(nodes_: DataFrame, parts_: DataFrame, gates_: DataFrame) -> DataFrame:
    """Nodes with their flags as one number."""
    own = nodes_.join(parts_.select("area_id", "node_id", "giant", "core"), ["area_id", "node_id"], "left")
    own = own.join(gates_.select("area_id", "node_id", F.lit(True).alias("gate")), ["area_id", "node_id"], "left")
    bit = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0)
    return own.withColumn("flags", F.lit(gr.INSIDE) + bit("gate", gr.GATEWAY) + bit("giant", gr.GIANT) + bit("core", gr.CORE))


@table
def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged graphs of all areas."""
    n = flagged(area_nodes(spark, sf_dir), area_parts(spark, sf_dir), gates(spark, sf_dir))
    return graph_rows(n, area_arcs(spark, sf_dir), area_streets(spark, sf_dir))


@table
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``area_id, node_id, dist_m`` up to the largest radius and the margin."""
    return spatial.distance_to_areas(nodes(spark, sf_dir), boundary(spark, sf_dir), max(RADII) + MARGIN_M + 1)


@table
def ring_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of all areas' surroundings: node ``t`` is the distance (infinite beyond), ``flags`` the first radius whose envelope has it."""
    boxes = spatial.polygon_boxes(boundary(spark, sf_dir))
    own = None
    for i, r in enumerate(RADII):
        some = spatial.in_box(nodes(spark, sf_dir), spatial.expand_box(boxes, r + MARGIN_M)).select("area_id", "node_id", F.lit(i).alias("flags"))
        own = some if own is None else own.union(some)
    own = own.groupBy("area_id", "node_id").agg(F.min("flags").alias("flags")).join(distances(spark, sf_dir), ["area_id", "node_id"], "left")
    own = own.withColumn("t", F.coalesce("dist_m", F.lit(float("inf"))))
    st, ar = spatial.clip(streets(spark, sf_dir), arcs(spark, sf_dir), own)
    return graph_rows(own, ar, st, node_t="t")
