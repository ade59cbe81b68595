"""All queries of the street-network part, by the id of the operation that each shows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wayloom.functions import graphs as gr
from wayloom.jobs import oracles, tables as t
from wayloom.operators import analysis as an, betweenness as bt, components, elimination as el, flow as fl, network as nw, scenarios as sc, spatial as sp, statistics as st, strong as sg, traversal as tr, weak as wk
from wayloom.session import shared_dir, written
from wayloom.sources import osm, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES
FRACTION = 0.2
FRACTIONS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
MARGINS = (200.0, 400.0, 800.0)
#: Draws of the sampling and simulation queries, and the size of sampled pieces.
DRAWS, PIECE = 40, 60
CLOSURES = (1, 2, 4, 8, 16)
RADIUS_LEVEL = 3
#: Rows of sources and nodes that a batch of betweenness holds at most, some sources more or less; a row takes some 115 bytes of disk on the way.
BATCH_ROWS = 1 << 26


def query(name: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        return fn

    return add


def r6(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks


@query("s1_read_elements")
def s1(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "osm")
    osm.write_elements(t.raw_nodes(spark, d), t.ways(spark, d), path)
    nodes, ways = osm.read_elements(spark, path)
    w = ways.select(F.lit("way").alias("kind"), F.col("way_id").alias("id"), F.size("nodes").cast("long").alias("n_points"), F.col("tags")["highway"].alias("highway"))
    return w.union(nodes.select(F.lit("node"), "node_id", F.lit(0).cast("long"), F.lit(None).cast("string")))


@query("s2_read_boundaries")
def s2(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "geojson")
    osm.write_boundaries(t.boundary(spark, d), path)
    return osm.read_boundaries(spark, path).select("area_id", F.col("ring_id").cast("int").alias("ring_id"), "seq", r6("lon", 9), r6("lat", 9))


def areas(spark: SparkSession, d: str) -> DataFrame:
    return osm.area_config(sp.polygon_boxes(t.boundary(spark, d)))


@query("s3_area_config")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return areas(spark, d).select("area_id", "key", "display_name", "od_rule", *[r6(c, 9) for c in "swne"])


@t.table
def small_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of each area's network."""
    n = t.area_parts(spark, d).groupBy("area_id").agg(F.count("*").alias("v"), F.count_if("core").alias("core"), F.count_if("giant").alias("giant"), F.count_distinct("component").alias("components"), F.count_distinct("scc").alias("sccs"))
    s = t.area_streets(spark, d).groupBy("area_id").agg(F.count("*").alias("streets"))
    a = t.area_arcs(spark, d).groupBy("area_id").agg(F.count("*").alias("arcs"))
    g = t.gates(spark, d).groupBy("area_id").agg(F.count("*").alias("n_gateways"))
    out = n.join(s, "area_id", "left").join(a, "area_id", "left").join(g, "area_id", "left")
    return out.na.fill(0, ["streets", "arcs", "n_gateways"])


METRICS = "area_id BIGINT, v BIGINT, core BIGINT, giant BIGINT, components BIGINT, sccs BIGINT, streets BIGINT, arcs BIGINT, n_gateways BIGINT"


@query("s4_collect_metrics")
def s4(spark: SparkSession, d: str) -> DataFrame:
    m, root = small_metrics(spark, d), _new(spark, "metrics")
    reports.write_metrics(m.where("area_id % 2 = 0"), f"{root}-even")
    reports.write_metrics(m.where("area_id % 2 = 1"), f"{root}-odd")
    return reports.read_metrics(spark, [f"{root}-even", f"{root}-odd"], METRICS, areas(spark, d)).select("area_id", "display_name", "v", "streets", "arcs")


@query("s5_metrics_json")
def s5(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "metrics")
    reports.write_metrics(small_metrics(spark, d), path)
    return spark.read.schema(METRICS).json(path).select("area_id", "v", "streets", "arcs", "n_gateways")


@query("s6_wide_csv")
def s6(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "wide")
    m = small_metrics(spark, d).select("area_id", st.percent(2 * F.col("streets") - F.col("arcs"), F.col("streets")).alias("one_way_pct"), F.when(F.col("area_id") > 0, F.col("v")).alias("v"))
    reports.write_wide_csv(m, path)
    back = spark.read.option("header", True).option("sep", ";").csv(path)
    return back.select(F.col("area_id").cast("long").alias("area_id"), F.coalesce("one_way_pct", F.lit("")).alias("one_way_pct"), F.coalesce("v", F.lit("")).alias("v"))


@query("s7_long_csv")
def s7(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "long")
    reports.write_long_csv(small_metrics(spark, d).select("area_id", "v", "streets", "arcs"), ["area_id"], path)
    return spark.read.option("header", True).schema("area_id BIGINT, metric STRING, value DOUBLE").csv(path)


# --- scalar projections and filters


@query("p1_drivable")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return nw.drivable(t.ways(spark, d)).select("way_id", F.col("tags")["highway"].alias("highway"))


@query("p2_direction")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return t.ways(spark, d).select("way_id", nw.direction(F.col("tags")).alias("dir"))


@query("p3_speed")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return t.ways(spark, d).select("way_id", nw.speed(F.col("tags")).alias("kmh"))


@query("p4_length")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return t.segments(spark, d).select("way_id", F.col("pos").cast("long").alias("pos"), r6("length_m"))


@query("p5_travel_time")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return t.segments(spark, d).select("way_id", F.col("pos").cast("long").alias("pos"), F.round(nw.travel_time(F.col("length_m"), F.col("kmh")), 6).alias("time_s"))


@query("p6_projection")
def p6(spark: SparkSession, d: str) -> DataFrame:
    around = sp.in_box(t.raw_nodes(spark, d), sp.expand_box(sp.polygon_boxes(t.boundary(spark, d)), t.MARGIN_M))
    return nw.projected(around, t.area_centres(spark, d)).select("area_id", "node_id", r6("x", 4), r6("y", 4))


@query("p7_expand_box")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return sp.expand_box(sp.polygon_boxes(t.boundary(spark, d)), t.MARGIN_M).select("area_id", *[r6(c, 9) for c in "swne"])


@query("p8_union_box")
def p8(spark: SparkSession, d: str) -> DataFrame:
    own = sp.polygon_boxes(t.boundary(spark, d))
    seen = t.area_nodes(spark, d).groupBy("area_id").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    return sp.union_box(sp.expand_box(seen, 100.0), own).select("area_id", *[r6(c, 9) for c in "swne"])


@query("p9_polygon_box")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return sp.polygon_boxes(t.boundary(spark, d)).select("area_id", *[r6(c, 9) for c in "swne"])


def touching(spark: SparkSession, d: str, boxes: DataFrame) -> DataFrame:
    """``area_id, way_id`` of the drivable ways with a point in an area's box."""
    hit = sp.in_box(t.raw_nodes(spark, d), boxes).select("area_id", "node_id")
    return nw.drivable(t.ways(spark, d)).select("way_id", F.explode("nodes").alias("node_id")).join(hit, "node_id").select("area_id", "way_id").distinct()


@query("p10_ways_in_box")
def p10(spark: SparkSession, d: str) -> DataFrame:
    ways = nw.drivable(t.ways(spark, d))
    return touching(spark, d, sp.polygon_boxes(t.boundary(spark, d))).join(ways.select("way_id", F.size("nodes").cast("long").alias("n_points")), "way_id").select("area_id", "way_id", "n_points")


@query("p11_window")
def p11(spark: SparkSession, d: str) -> DataFrame:
    inner = sp.expand_box(sp.polygon_boxes(t.boundary(spark, d)), -400.0)
    keep = sp.in_box(t.nodes(spark, d), inner).select("area_id", "node_id")
    s, a = sp.clip(t.streets(spark, d), t.arcs(spark, d), keep)
    both = a.select("area_id", "street_id").groupBy("area_id", "street_id").agg((F.count("*") > 1).alias("two_way"))
    return s.join(both, ["area_id", "street_id"]).select("area_id", "street_id", "two_way")


@query("p12_percent")
def p12(spark: SparkSession, d: str) -> DataFrame:
    m = small_metrics(spark, d)
    return m.select("area_id", st.percent(F.col("v") - F.col("core"), F.col("v")).alias("outside_core_pct"), st.percent(F.col("v"), F.col("v") - F.col("v")).alias("none"))


# --- network build


@query("n1_segments")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return t.segments(spark, d).select("way_id", F.col("pos").cast("long").alias("pos"), "a", "b", r6("length_m"), "kmh", "dir")


@query("n2_segment_arcs")
def n2(spark: SparkSession, d: str) -> DataFrame:
    return nw.segment_arcs(t.segments(spark, d))


@query("n3_intersections")
def n3(spark: SparkSession, d: str) -> DataFrame:
    s = t.segments(spark, d)
    return nw.degrees(s).join(nw.intersections(s), "node_id").select("node_id", "degree")


@query("n4_contract_chains")
def n4(spark: SparkSession, d: str) -> DataFrame:
    c = nw.chains(t.segments(spark, d))
    return c.select("u", "v", F.size("path").cast("long").alias("n_points"), r6("length_m"))


@query("n5_chain_aggregates")
def n5(spark: SparkSession, d: str) -> DataFrame:
    s = t.streets(spark, d)
    g = nw.geometry(s, t.raw_nodes(spark, d)).select("street_id", F.posexplode("geom").alias("rank", "p"))
    return s.join(g, "street_id").select("street_id", F.col("rank").cast("long").alias("rank"), r6("length_m"), r6("time_s"), "fwd", "bwd", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("n6_arcs")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return t.arcs(spark, d).select("street_id", "u", "v", r6("length_m"), r6("time_s"))


@query("n7_nodes")
def n7(spark: SparkSession, d: str) -> DataFrame:
    around = sp.in_box(t.nodes(spark, d), sp.expand_box(sp.polygon_boxes(t.boundary(spark, d)), t.MARGIN_M))
    return nw.projected(around, t.area_centres(spark, d)).select("area_id", "node_id", r6("lat", 9), r6("lon", 9), r6("x", 4), r6("y", 4))


@query("n8_build_stats")
def n8(spark: SparkSession, d: str) -> DataFrame:
    ways, boxes = nw.drivable(t.ways(spark, d)), sp.polygon_boxes(t.boundary(spark, d))
    own = touching(spark, d, boxes).join(ways.select("way_id", "tags"), "way_id")
    keep = sp.in_box(t.nodes(spark, d), boxes)
    return nw.build_stats(own, sp.clip(t.chains(spark, d).select("u", "v", "fwd", "bwd"), t.arcs(spark, d), keep)[0])


# --- spatial joins


@query("g1_points_in_areas")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return sp.points_in_areas(t.raw_nodes(spark, d), t.boundary(spark, d)).select("area_id", "node_id")


@query("g2_clip")
def g2(spark: SparkSession, d: str) -> DataFrame:
    s, a = sp.clip(t.streets(spark, d), t.arcs(spark, d), t.area_nodes(spark, d))
    n = t.area_nodes(spark, d).groupBy("area_id").agg(F.count("*").alias("nodes"))
    return n.join(s.groupBy("area_id").agg(F.count("*").alias("streets")), "area_id").join(a.groupBy("area_id").agg(F.count("*").alias("arcs")), "area_id")


def box_nodes(spark: SparkSession, d: str) -> DataFrame:
    return sp.in_box(t.nodes(spark, d), sp.polygon_boxes(t.boundary(spark, d)))


@query("g3_box_clip")
def g3(spark: SparkSession, d: str) -> DataFrame:
    s, a = sp.clip(t.streets(spark, d), t.arcs(spark, d), box_nodes(spark, d))
    return s.groupBy("area_id").agg(F.count("*").alias("streets")).join(a.groupBy("area_id").agg(F.count("*").alias("arcs")), "area_id")


@query("g4_distance")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return t.distances(spark, d).select("area_id", "node_id", r6("dist_m", 4))


@query("g5_gateways")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return t.gates(spark, d).select("area_id", "node_id", F.lit(t.MARGIN_M).alias("margin_m"))


@query("g6_rings")
def g6(spark: SparkSession, d: str) -> DataFrame:
    radii = spark.createDataFrame([(r,) for r in t.RADII], "r_m int")
    ring = t.distances(spark, d).join(F.broadcast(radii), F.col("dist_m") <= F.col("r_m"))
    s = t.streets(spark, d).select("street_id", "u", "v")
    at = lambda k: ring.select("area_id", "r_m", F.col("node_id").alias(k))
    inside = s.join(at("u"), "u").join(at("v"), ["area_id", "r_m", "v"], "left_semi")
    n = ring.groupBy("area_id", "r_m").agg(F.count("*").alias("nodes"))
    return n.join(inside.groupBy("area_id", "r_m").agg(F.count("*").alias("streets")), ["area_id", "r_m"])


@query("g7_ring_destinations")
def g7(spark: SparkSession, d: str) -> DataFrame:
    radii = spark.createDataFrame([(r,) for r in t.RADII], "r_m int")
    dist = t.distances(spark, d)
    ends = t.arcs(spark, d).select("u", "v", F.lit(True).alias("directed"))
    s = t.streets(spark, d)
    ends = ends.union(s.select("u", "v", F.lit(False))).union(s.select(F.col("v"), F.col("u"), F.lit(False)))
    at = lambda k: dist.select("area_id", F.col("node_id").alias(k), F.col("dist_m").alias(f"d_{k}"))
    out = ends.join(at("u"), "u").join(at("v"), ["area_id", "v"]).join(F.broadcast(radii)).where(f"d_u <= r_m and d_v > r_m and d_v <= r_m + {t.MARGIN_M} + 1")
    return out.select("area_id", "r_m", "directed", F.col("u").alias("node_id")).distinct()


@query("g8_street_class")
def g8(spark: SparkSession, d: str) -> DataFrame:
    dist = t.distances(spark, d)
    at = lambda k: dist.select("area_id", F.col("node_id").alias(k), F.col("dist_m").alias(f"d_{k}"))
    s = t.streets(spark, d).select("street_id", "u", "v").join(at("u"), "u").join(at("v"), ["area_id", "v"])
    return s.select("area_id", "street_id", sp.street_class(F.col("d_u"), F.col("d_v")).alias("class"))


@t.table
def tunnel_gates(spark: SparkSession, d: str) -> DataFrame:
    ways = nw.drivable(t.ways(spark, d)).where(F.col("tags")["tunnel"].isNotNull())
    pts = ways.select(F.explode("nodes").alias("node_id"), F.col("tags")["name"].alias("name")).join(t.raw_nodes(spark, d), "node_id")
    geom = nw.geometry(t.streets(spark, d), t.raw_nodes(spark, d))
    return sp.tunnel_gateways(t.streets(spark, d), geom, t.area_nodes(spark, d), t.gates(spark, d), pts.select("lat", "lon", "name"), t.area_centres(spark, d))


@query("g9_tunnel_gateways")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return tunnel_gates(spark, d).select("area_id", "node_id", F.explode("tunnels").alias("tunnel"))


# --- connectivity and traversal


@query("c1_undirected_edges")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return t.area_streets(spark, d).select("area_id", *nw.pair_key()).distinct()


@query("c2_degrees")
def c2(spark: SparkSession, d: str) -> DataFrame:
    n, a = t.area_nodes(spark, d).select("area_id", "node_id"), t.area_arcs(spark, d)
    count = lambda k, name: a.groupBy("area_id", F.col(k).alias("node_id")).agg(F.count("*").alias(name))
    out = n.join(count("u", "out_degree"), ["area_id", "node_id"], "left").join(count("v", "in_degree"), ["area_id", "node_id"], "left")
    out = out.join(nw.node_degrees(t.area_streets(spark, d)), ["area_id", "node_id"], "left").na.fill(0)
    return out.withColumn("dead_end", F.col("degree") == 1)


@query("c3_components")
def c3(spark: SparkSession, d: str) -> DataFrame:
    """Components of all areas at once, by star contraction over the whole table."""
    comp = components.components(t.key_streets(spark, d))
    out = t.node_keys(spark, d).join(comp, "node", "left").select("area_id", "node_id", F.coalesce("component", "node").alias("label"))
    size = out.groupBy("area_id", "label").agg(F.min("node_id").alias("component"), F.count("*").alias("size"))
    by = Window.partitionBy("area_id").orderBy(F.desc("size"), "component")
    giant = size.withColumn("giant", F.row_number().over(by) == 1)
    return out.join(giant, ["area_id", "label"]).select("area_id", "node_id", "component", "size", "giant")


def first_core(spark: SparkSession, d: str) -> DataFrame:
    return t.area_parts(spark, d).where("core").groupBy("area_id").agg(F.min("node_id").alias("node_id"))


@query("c4_reach")
def c4(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the first core node reaches, and nodes that reach it."""
    g, seeds = t.time_graph(spark, d), first_core(spark, d)
    both = [t.searched(x, seeds, t.node_keys(spark, d)).withColumn("backward", F.lit(back)) for x, back in ((g, False), (g.turned(), True))]
    return el.union(both).select("area_id", F.lit(0).alias("scenario"), "node_id", "backward")


@query("c5_strong_components")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return t.area_parts(spark, d).select("area_id", "node_id", "scc", "core")


def hops(spark: SparkSession, d: str, sources: DataFrame) -> DataFrame:
    found = t.searched(t.hop_graph(spark, d), sources.select("area_id", "node_id"), t.node_keys(spark, d))
    return found.select("area_id", "node_id", F.col("d").cast("int").alias("hops"))


@query("c6_hops_from_one")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return hops(spark, d, first_core(spark, d))


@t.table
def gate_hops(spark: SparkSession, d: str) -> DataFrame:
    return hops(spark, d, t.gates(spark, d))


@query("c7_hops_to_gateways")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return gate_hops(spark, d)


@t.table
def od(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, rule, o, d``: extreme x + y among well-joined core nodes, extreme x in a window of y, double sweep."""
    core = t.area_parts(spark, d).where("core").select("area_id", "node_id")
    places = nw.projected(t.area_nodes(spark, d).select("area_id", "node_id", "lat", "lon"), t.area_centres(spark, d)).select("area_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    at = core.join(nw.node_degrees(t.area_streets(spark, d)), ["area_id", "node_id"]).join(places, ["area_id", "node_id"])

    def extreme(rows: DataFrame, score, rule: str) -> DataFrame:
        top, low = F.min_by("node_id", F.struct(-score, "node_id")), F.min_by("node_id", F.struct(score, "node_id"))
        return rows.groupBy("area_id").agg(F.lit(rule).alias("rule"), top.alias("o"), low.alias("d"))

    def farthest(start: DataFrame) -> DataFrame:
        found = t.searched(t.time_graph(spark, d), start, t.node_keys(spark, d)).join(core, ["area_id", "node_id"], "left_semi")
        return written(found.groupBy("area_id").agg(F.min_by("node_id", F.struct(-F.round("d", 6), "node_id")).alias("node_id")), "far")

    middle = at.join(at.groupBy("area_id").agg(F.round(F.avg("y"), 6).alias("mid")), "area_id").where("y > mid")
    one = farthest(first_core(spark, d))
    two = farthest(one).withColumnRenamed("node_id", "d")
    sweep = one.join(two, "area_id").select("area_id", F.lit("sweep"), F.col("node_id"), "d")
    return extreme(at.where("degree >= 3"), F.round(F.col("x") + F.col("y"), 5), "corner").union(extreme(middle, F.col("x"), "window")).union(sweep)


@t.table
def od_times(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, rule, node_id, time_s``: times from the origin of every rule."""
    start = od(spark, d).select("area_id", "rule", F.col("o").alias("node_id"))
    return t.searched(t.time_graph(spark, d), start, t.node_keys(spark, d)).withColumnRenamed("d", "time_s")


@query("c8_shortest_times")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return od_times(spark, d).join(od(spark, d).select("area_id", "rule", "o"), ["area_id", "rule"]).select("area_id", "rule", "o", "node_id", r6("time_s", 5))


@query("c9_relaxation_check")
def c9(spark: SparkSession, d: str) -> DataFrame:
    """Times over eliminated nodes against those by plain rounds of relaxation."""
    plain = tr.relax(t.area_arcs(spark, d), od(spark, d).select("area_id", "rule", F.col("o").alias("node_id")))
    key = ["area_id", "rule", "node_id"]
    both = od_times(spark, d).join(plain.select(*key, F.col("time_s").alias("plain_s")), key, "full")
    return both.groupBy("area_id", "rule").agg(F.count("*").alias("nodes"), F.count_if(F.abs(F.col("plain_s") - F.col("time_s")) < 1e-6).alias("equal"))


@t.table
def od_paths(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, rule, pos, node_id``: the nodes of each rule's least-time path in order."""
    search = F.concat_ws("/", "area_id", "rule").alias("search")
    keys = t.node_keys(spark, d)
    dist = written(od_times(spark, d).join(keys, ["area_id", "node_id"]).select(search, "node", F.col("time_s").alias("d")), "dist")
    ends = t.keyed(od(spark, d).withColumnRenamed("d", "node_id"), keys, node="node_id").join(dist.select("search", "node"), ["node"]).where(F.col("search") == F.concat_ws("/", "area_id", "rule"))
    legs = el.paths(el.predecessors(dist, t.key_arcs(spark, d)), ends.select("search", "node"))
    named = od(spark, d).select(search, "rule")
    return legs.join(named, "search").join(keys, "node").select("area_id", "rule", F.col("pos").cast("int").alias("pos"), "node_id")


@query("c10_shortest_paths")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return od_paths(spark, d)


@t.table
def all_routes(spark: SparkSession, d: str) -> DataFrame:
    return an.routes(t.graph(spark, d), od(spark, d))


@query("c11_alternative_routes")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return all_routes(spark, d).select("area_id", "rule", "o", "d", r6("time_s"), "closed_lo", "closed_hi", r6("alt_time_s"), "extra_pct", "bridges")


@query("c12_od_rules")
def c12(spark: SparkSession, d: str) -> DataFrame:
    return od(spark, d)


# --- structural weak points


@t.table
def weak(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, what, lo, hi``; an articulation has its node twice."""
    pairs, tour = t.street_structure(spark, d)
    found = wk.bridges(pairs, tour).select(F.lit("bridge").alias("what"), "lo", "hi")
    found = found.union(wk.articulations(pairs, tour).select(F.lit("articulation"), "node", F.col("node")))
    return t.named(found, t.node_keys(spark, d)).select("area_id", "what", "lo", "hi")


def core_closures(core: DataFrame, streets: DataFrame) -> DataFrame:
    """``group, lo, hi``: pairs with a street and nodes (twice) of the cores ``(group, node)``."""
    inside = lambda c: core.select(F.col("node").alias(c))
    pairs = streets.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    pairs = pairs.join(core.withColumnRenamed("node", "lo"), "lo").join(inside("hi"), "hi", "left_semi")
    return pairs.select("group", "lo", "hi").union(core.select("group", "node", "node"))


def keyed_core(parts: DataFrame, keys: DataFrame) -> DataFrame:
    return written(parts.where("core").join(keys, ["area_id", "node_id"]).select(F.col("area_id").alias("group"), "node"), "core")


@t.table
def strong(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, what, lo, hi`` of the strong cores."""
    keys = t.node_keys(spark, d)
    core = keyed_core(t.area_parts(spark, d), keys)
    found = sg.breaking_closures(t.time_graph(spark, d), t.key_arcs(spark, d), core, core_closures(core, t.key_streets(spark, d)))
    what = F.when(F.col("lo") == F.col("hi"), "articulation").otherwise("bridge")
    return t.named(found.select(what.alias("what"), "lo", "hi"), keys).select("area_id", "what", "lo", "hi")


@query("w1_bridges")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return weak(spark, d).where("what = 'bridge'").select("area_id", "lo", "hi")


@query("w2_articulations")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return weak(spark, d).where("what = 'articulation'").select("area_id", F.col("lo").alias("node_id"))


@query("w3_strong_bridges")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return strong(spark, d).where("what = 'bridge'").select("area_id", "lo", "hi")


@query("w4_strong_articulations")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return strong(spark, d).where("what = 'articulation'").select("area_id", F.col("lo").alias("node_id"))


def crossed(spark: SparkSession, d: str) -> DataFrame:
    key = ["area_id", "what", "lo", "hi"]
    both = weak(spark, d).withColumn("w", F.lit(True)).join(strong(spark, d).withColumn("s", F.lit(True)), key, "full")
    kind = F.when(F.col("w") & F.col("s"), "both").when(F.col("s"), "strong_only").otherwise("weak_only")
    return both.select(*key, kind.alias("kind"))


@query("w5_weak_by_strong")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return crossed(spark, d).groupBy("area_id", "what", "kind").agg(F.count("*").alias("n"))


@t.table
def candidates(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, node_id, dist, gate, place, n``: the giant component of each area with gateways; inner nodes in the order of their hops from them."""
    gates = t.gates(spark, d).select("area_id", "node_id", F.lit(True).alias("gate"))
    giant = t.area_parts(spark, d).where("giant").join(gates.select("area_id").distinct(), "area_id", "left_semi").select("area_id", "node_id")
    rows = giant.join(gates, ["area_id", "node_id"], "left").join(gate_hops(spark, d), ["area_id", "node_id"], "left")
    rows = rows.select("area_id", "node_id", F.coalesce("hops", F.lit(0)).alias("dist"), F.coalesce("gate", F.lit(False)).alias("gate"))
    size = giant.groupBy("area_id").agg(F.count("*").alias("n"))
    by = Window.partitionBy("area_id", "gate").orderBy(F.desc("dist"), "node_id")
    return rows.withColumn("place", F.when(~F.col("gate"), F.row_number().over(by))).join(size, "area_id")


def within_fraction(frac: float):
    """Whether a candidate is in the source region of a fraction of its area's nodes."""
    return F.coalesce(F.col("place") <= F.greatest(F.lit(1), F.bround(F.lit(frac) * F.col("n"))), F.lit(False))


@t.table
def lone_cuts(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, frac, lo, hi, side, side_pct``: streets that alone part the source region from all gateways."""
    pairs, tour = t.street_structure(spark, d)
    keys = t.node_keys(spark, d)
    nodes = candidates(spark, d).join(keys, ["area_id", "node_id"]).join(tour.select("node", "top"), "node")
    found = wk.single_cuts(pairs, tour, nodes, {str(i): within_fraction(f) for i, f in enumerate(FRACTIONS)})
    frac = F.element_at(F.array(*map(F.lit, FRACTIONS)), F.col("pick").cast("int") + 1)
    return t.named(found, keys).select("area_id", frac.alias("frac"), "lo", "hi", F.col("side").cast("long").alias("side"), F.round(100 * F.col("side") / F.col("n"), 1).alias("side_pct"))


@query("w6_single_street_cuts")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return lone_cuts(spark, d).where(f"frac = {FRACTION}").select("area_id", "lo", "hi", "side", "side_pct")


@query("w7_other_single_failures")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return an.other_failures(t.graph(spark, d), od(spark, d))


@t.table
def path_shares(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, u, v, share, n`` of the strong core's arcs, and of its nodes where ``v`` is null."""
    core = t.area_parts(spark, d).where("core").select("area_id", "node_id").join(t.node_keys(spark, d), ["area_id", "node_id"])
    size = core.groupBy("area_id").agg(F.count("*").alias("n"))
    rows = size.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    keys = core.select("node")
    arcs = t.key_arcs(spark, d).join(keys.withColumnRenamed("node", "u"), "u", "left_semi").join(keys.withColumnRenamed("node", "v"), "v", "left_semi")
    # between nodes of a strong component no path leaves it, so the whole graph's elimination serves
    nodes, pairs = bt.betweenness(t.time_graph(spark, d), written(arcs), keys, batches=rows // BATCH_ROWS + 1, keep=keys)
    at = lambda c, to: core.select("area_id", F.col("node").alias(c), F.col("node_id").alias(to))
    own = nodes.join(at("node", "u"), "node").select("area_id", "u", F.lit(None).cast("long").alias("v"), "share")
    named = pairs.withColumnsRenamed({"u": "_u", "v": "_v"}).join(at("_u", "u"), "_u").join(at("_v", "v"), ["area_id", "_v"]).select("area_id", "u", "v", "share")
    return own.union(named).join(size, "area_id")


def node_scores(spark: SparkSession, d: str) -> DataFrame:
    n, share = F.col("n"), F.col("share")
    own = path_shares(spark, d).where("v is null")
    return own.select("area_id", F.col("u").alias("node_id"), F.when(n > 2, share / ((n - 1) * (n - 2))).otherwise(share).alias("score"), "n")


def arc_scores(spark: SparkSession, d: str) -> DataFrame:
    n, share = F.col("n"), F.col("share")
    return path_shares(spark, d).where("v is not null").select("area_id", "u", "v", F.when(n > 1, share / (n * (n - 1))).otherwise(share).alias("score"))


@query("w8_cut_ends_central")
def w8(spark: SparkSession, d: str) -> DataFrame:
    ends = lone_cuts(spark, d).select("area_id", "frac", F.explode(F.array("lo", "hi")).alias("node_id")).distinct()
    top = st.top_k(node_scores(spark, d), ["area_id"], [F.desc(F.round("score", 9)), "node_id"], 5).select("area_id", "node_id", F.lit(1).alias("top"))
    got = ends.join(top, ["area_id", "node_id"], "left").groupBy("area_id", "frac").agg((F.count("*") == F.count("top")).alias("central"))
    grid = t.area_nodes(spark, d).select("area_id").distinct().join(F.broadcast(spark.createDataFrame([(f,) for f in FRACTIONS], "frac double")))
    return grid.join(got, ["area_id", "frac"], "left").select("area_id", "frac", F.coalesce("central", F.lit(False)).alias("central"))


# --- centrality


@query("b1_node_betweenness")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return node_scores(spark, d).select("area_id", "node_id", r6("score", 9))


def street_scores(spark: SparkSession, d: str) -> DataFrame:
    return arc_scores(spark, d).groupBy("area_id", *nw.pair_key()).agg(F.sum("score").alias("score"))


@query("b2_street_betweenness")
def b2(spark: SparkSession, d: str) -> DataFrame:
    return street_scores(spark, d).select("area_id", "lo", "hi", r6("score", 9))


@t.table
def top_scores(spark: SparkSession, d: str) -> DataFrame:
    return node_scores(spark, d).groupBy("area_id").agg(F.max("score").alias("score"), F.min_by("node_id", F.struct(-F.round("score", 9), "node_id")).alias("node_id"), F.count("*").alias("n"))


@query("b3_maximum")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return top_scores(spark, d).select("area_id", r6("score", 9), "node_id", "n")


@query("b4_top_streets")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return st.top_k(street_scores(spark, d).withColumn("score", F.round("score", 9)), ["area_id"], [F.desc("score"), "lo", "hi"], 10)


@query("b5_scale_check")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return top_scores(spark, d).select("area_id", F.round(F.col("score") * F.sqrt("n"), 6).alias("scaled"))


@query("b6_plain_betweenness")
def b6(spark: SparkSession, d: str) -> DataFrame:
    return an.plain_betweenness_max(t.graph(spark, d)).select("area_id", r6("score", 9))


# --- flow and cut


@query("f1_unit_capacities")
def f1(spark: SparkSession, d: str) -> DataFrame:
    s = t.area_streets(spark, d)
    both = s.select("area_id", F.col("u").alias("a"), F.col("v").alias("b")).union(s.select("area_id", "v", "u"))
    return both.groupBy("area_id", "a", "b").agg(F.count("*").alias("cap"))


def directed_caps(spark: SparkSession, d: str) -> DataFrame:
    giant = t.area_parts(spark, d).where("giant").select("area_id", "node_id")
    a = t.area_arcs(spark, d).join(giant.withColumnRenamed("node_id", "u"), ["area_id", "u"], "left_semi").join(giant.withColumnRenamed("node_id", "v"), ["area_id", "v"], "left_semi")
    return a.groupBy("area_id", F.col("u").alias("a"), F.col("v").alias("b")).agg(F.count("*").alias("cap"))


@query("f2_directed_capacities")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return directed_caps(spark, d)


@t.table
def regions(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).where(within_fraction(FRACTION)).select("area_id", "node_id", "dist")


@query("f3_split_capacities")
def f3(spark: SparkSession, d: str) -> DataFrame:
    free = regions(spark, d).select("area_id", "node_id").union(t.gates(spark, d).select("area_id", "node_id")).distinct().withColumn("free", F.lit(True))
    giant = t.area_parts(spark, d).where("giant").select("area_id", "node_id").join(free, ["area_id", "node_id"], "left")
    big = F.lit(gr.BIG).cast("long")
    inner = giant.select("area_id", (2 * F.col("node_id")).alias("a"), (2 * F.col("node_id") + 1).alias("b"), F.when(F.col("free"), big).otherwise(F.lit(1)).alias("cap"))
    return inner.union(directed_caps(spark, d).select("area_id", 2 * F.col("a") + 1, 2 * F.col("b"), big))


def _numbered_streets(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, u, v, cap``: a unit a street, both ways, by numbers of nodes."""
    s = t.key_streets(spark, d)
    one = F.lit(1).alias("cap")
    return s.select("area_id", F.col("a").alias("u"), F.col("b").alias("v"), one).union(s.select("area_id", "b", "a", one))


def _access_ends(spark: SparkSession, d: str, fracs: tuple[float, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``area_id, frac, node`` of the source regions and of the gateways, and ``area_id, node`` of the giant components that have such."""
    own = candidates(spark, d).join(t.node_keys(spark, d), ["area_id", "node_id"])
    own = own.withColumn("frac", F.explode(F.array(*[F.struct(F.lit(f).alias("frac"), within_fraction(f).alias("source")) for f in fracs])))
    pick = lambda of: own.where(of).select("area_id", F.col("frac.frac").alias("frac"), "node")
    return pick("frac.source"), pick("gate"), own.select("area_id", "node").distinct()


def _solved(arcs: DataFrame, sources: DataFrame, sinks: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Settled rows of the problems that ``key`` tells apart, and ``problem`` with ``key``."""
    name = F.concat_ws("/", *key).alias("problem")
    rows = fl.least_cuts(arcs.select(name, "u", "v", "cap"), sources.select(name, "node"), sinks.select(name, "node"))
    return rows, sinks.select(name, *key).distinct()


@t.table
def counts4(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, unit, directed, flow, cut_size, cut_capacity`` from the source region to the gateways, for streets and for intersections."""
    sources, gates, giant = _access_ends(spark, d, (FRACTION,))
    way = t.key_arcs(spark, d).select("u", "v").join(t.node_keys(spark, d).select("area_id", F.col("node").alias("u")), "u").select("area_id", "u", "v", F.lit(1).alias("cap"))
    inside = lambda c: giant.select("area_id", F.col("node").alias(c))
    both = _numbered_streets(spark, d).withColumn("directed", F.lit(False)).union(way.withColumn("directed", F.lit(True)))
    both = written(both.join(inside("u"), ["area_id", "u"], "left_semi").join(inside("v"), ["area_id", "v"], "left_semi"), "arcs")
    # an intersection is entered at twice its number and left at the next
    free = sources.select("area_id", "node").union(gates.select("area_id", "node")).withColumn("free", F.lit(True))
    big, modes = F.lit(gr.BIG), F.array(F.lit(False), F.lit(True))
    through = giant.join(free, ["area_id", "node"], "left").select("area_id", (2 * F.col("node")).alias("u"), (2 * F.col("node") + 1).alias("v"), F.when(F.col("free"), big).otherwise(1).alias("cap"), F.explode(modes).alias("directed"))
    between = both.where("u <> v").select("area_id", (2 * F.col("u") + 1).alias("u"), (2 * F.col("v")).alias("v"), big.alias("cap"), "directed").distinct()
    arcs = both.withColumn("unit", F.lit("streets")).unionByName(between.unionByName(through).withColumn("unit", F.lit("intersections")))

    def ends(nodes: DataFrame, last: int) -> DataFrame:
        place = F.when(F.col("unit") == "streets", F.col("node")).otherwise(2 * F.col("node") + last)
        units = F.array(F.lit("streets"), F.lit("intersections"))
        return nodes.select("area_id", "node", F.explode(units).alias("unit")).select("*", F.explode(modes).alias("directed")).withColumn("node", place)

    key = ("area_id", "unit", "directed")
    rows, names = _solved(arcs, ends(sources, 0), ends(gates, 1), *key)
    every = t.area_nodes(spark, d).select("area_id").distinct().select("area_id", F.explode(F.array(F.lit("streets"), F.lit("intersections"))).alias("unit")).select("*", F.explode(modes).alias("directed"))
    found = every.join(names, list(key), "left").join(fl.values(rows), "problem", "left")
    return found.select(*key, "flow", "cut_size", "cut_capacity").na.fill(0)


@query("f4_flow_equals_cut")
def f4(spark: SparkSession, d: str) -> DataFrame:
    """The flow of each scenario and the capacity of the cut that it returns, which are equal."""
    return counts4(spark, d).select("area_id", "unit", "directed", "flow", "cut_capacity", (F.col("flow") == F.col("cut_capacity")).alias("equal"))


@query("f5_od_cut")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return an.od_cuts(t.graph(spark, d), od(spark, d)).select("area_id", "rule", "o", "d", "flow", F.size("cut").alias("cut_size"))


@query("f6_source_region")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return regions(spark, d)


def _access(spark: SparkSession, d: str, fracs: tuple[float, ...]) -> DataFrame:
    """``area_id, frac, flow, cut_size, n_source, n_gateways, side, cut_capacity`` from the source regions to the gateways, by streets."""
    sources, gates, giant = _access_ends(spark, d, fracs)
    streets = _numbered_streets(spark, d).join(giant.withColumnRenamed("node", "u"), ["area_id", "u"], "left_semi")
    arcs = streets.withColumn("frac", F.explode(F.array(*map(F.lit, fracs))))
    rows, names = _solved(arcs, sources, gates, "area_id", "frac")
    size = lambda nodes, n: nodes.groupBy("area_id", "frac").agg(F.count("*").alias(n))
    every = t.area_nodes(spark, d).select("area_id").distinct().withColumn("frac", F.explode(F.array(*map(F.lit, fracs))))
    found = every.join(names, ["area_id", "frac"], "left").join(fl.values(rows), "problem", "left")
    found = found.join(size(sources, "n_source"), ["area_id", "frac"], "left").join(size(gates, "n_gateways"), ["area_id", "frac"], "left")
    return found.select("area_id", "frac", "flow", "cut_size", "n_source", "n_gateways", "side", "cut_capacity").na.fill(0)


@t.table
def access_flow(spark: SparkSession, d: str) -> DataFrame:
    """At the one fraction that most queries ask for."""
    return _access(spark, d, (FRACTION,))


@t.table
def access_flows(spark: SparkSession, d: str) -> DataFrame:
    return _access(spark, d, FRACTIONS)


@query("f7_access_flow")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return access_flow(spark, d).select("area_id", "frac", "flow", "cut_size", "n_source", "n_gateways", "side")


@query("f8_region_flow")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return an.region_flow(t.graph(spark, d), FRACTION)


@query("f9_four_counts")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return counts4(spark, d).select("area_id", "unit", "directed", "flow", "cut_size")


@query("f10_all_pairs_cuts")
def f10(spark: SparkSession, d: str) -> DataFrame:
    one = an.cut_summary(an.undirected_cuts(t.graph(spark, d))).withColumn("kind", F.lit("undirected"))
    return one.unionByName(an.cut_summary(an.directed_cuts(t.graph(spark, d))).withColumn("kind", F.lit("directed")))


@t.table
def ring_values(spark: SparkSession, d: str) -> DataFrame:
    return an.ring_flows(t.ring_graph(spark, d), regions(spark, d), t.RADII)


@query("f11_ring_flow")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return ring_values(spark, d)


@t.table
def ring_cut_streets(spark: SparkSession, d: str) -> DataFrame:
    return an.ring_cuts(t.ring_graph(spark, d), regions(spark, d), t.RADII)


@query("f12_cut_near_destination")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return ring_cut_streets(spark, d).where("side = 'destination'").select("area_id", "r_m", "u", "v")


@query("f13_cut_composition")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return ring_cut_streets(spark, d).groupBy("area_id", "r_m", "side").pivot("class", ["internal", "boundary", "external"]).agg(F.count(F.lit(1))).na.fill(0)


@query("f14_critical_streets")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return an.critical_streets(t.ring_graph(spark, d), regions(spark, d), t.RADII)


@query("f15_flow_bound")
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Ring flows and the flow to the boundary, which bounds them."""
    v = ring_values(spark, d)
    base = v.where("r_m = 0 and dest_rule = 'any'").select("area_id", "unit", "directed", F.col("flow").alias("most"))
    return v.where("r_m > 0").join(base, ["area_id", "unit", "directed"]).select("area_id", "r_m", "dest_rule", "unit", "directed", "flow", "most", (F.col("flow") <= F.col("most")).alias("within"))


@t.table
def continuing(spark: SparkSession, d: str) -> DataFrame:
    return an.continuation(t.ring_graph(spark, d), regions(spark, d), t.RADII)


@query("f16_continuing_gateways")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return continuing(spark, d).select("area_id", "r_m", "n_exits", "n_continuing", F.array_join(F.col("dead").cast("array<string>"), ",").alias("dead"))


@query("f17_drop_decomposition")
def f17(spark: SparkSession, d: str) -> DataFrame:
    c = continuing(spark, d)
    steps = c.select("area_id", "r_m", F.posexplode(F.array("flow_all", "flow_continuing", "flow_edge")).alias("step", "flow"))
    by = Window.partitionBy("area_id", "r_m").orderBy("step")
    return steps.withColumn("drop", F.lag("flow").over(by) - F.col("flow"))


@query("f18_flow_without_tunnels")
def f18(spark: SparkSession, d: str) -> DataFrame:
    tunnel = tunnel_gates(spark, d).select("area_id", "node_id")
    rest = t.gates(spark, d).join(tunnel, ["area_id", "node_id"], "left_anti")
    g = sc.graph_rows(t.flagged(t.area_nodes(spark, d), t.area_parts(spark, d), rest), t.area_arcs(spark, d), t.area_streets(spark, d))
    new = an.access(g, (FRACTION,)).select("area_id", F.col("flow").alias("flow_without"), F.col("n_gateways").alias("gateways_left"))
    n = tunnel.groupBy("area_id").agg(F.count("*").alias("tunnel_gateways"))
    old = access_flow(spark, d).select("area_id", "flow", "n_gateways")
    return old.join(n, "area_id", "left").join(new, "area_id", "left").na.fill(0)


# --- sweeps, samples, simulation, statistics


@query("x1_margin_sweep")
def x1(spark: SparkSession, d: str) -> DataFrame:
    giant = t.area_parts(spark, d).where("giant").select("area_id", "node_id")
    out = None
    for m in MARGINS:
        gates = t.exits(spark, d, m).join(giant, ["area_id", "node_id"], "left_semi")
        g = sc.graph_rows(t.flagged(t.area_nodes(spark, d), t.area_parts(spark, d), gates), t.area_arcs(spark, d), t.area_streets(spark, d))
        own = an.access(g, (0.15, 0.20, 0.25)).select("area_id", F.lit(m).alias("margin_m"), F.col("frac").alias("f"), F.col("n_gateways").alias("gateways"), "flow", "n_source")
        out = own if out is None else out.union(own)
    return out


@query("x2_fraction_sweep")
def x2(spark: SparkSession, d: str) -> DataFrame:
    lone = lone_cuts(spark, d).groupBy("area_id", "frac").agg(F.count("*").alias("single_cuts"))
    return access_flows(spark, d).select("area_id", "frac", "flow", "n_source").join(lone, ["area_id", "frac"], "left").na.fill(0)


def indicators(spark: SparkSession, d: str, clip: str) -> DataFrame:
    nodes_ = t.area_nodes(spark, d) if clip == "polygon" else box_nodes(spark, d)
    s, a = sp.clip(t.streets(spark, d), t.arcs(spark, d), nodes_)
    keys = written(t.numbered(nodes_), "keys")
    ends = lambda x, **names: t.keyed(x.withColumnsRenamed({"u": "from", "v": "to"}), keys, **names)
    by_key = written(ends(s, a="from", b="to").select("a", "b"), "streets")
    g = el.eliminate(ends(a, u="from", v="to").select("u", "v", F.col("time_s").alias("w")))
    parts = written(t.flagged_parts(keys, by_key, g), "parts")
    out = sp.gateways(t.streets(spark, d), nodes_, t.within_margin(spark, d))
    gates = out.join(parts.where("giant"), ["area_id", "node_id"], "left_semi")
    g = written(sc.graph_rows(t.flagged(nodes_, parts, gates), a, s), "clip")
    n = parts.groupBy("area_id").agg(F.count("*").alias("v"), F.count_if("core").alias("core"))
    pairs = an.strong_candidates(g).where("lo <> hi").groupBy("area_id").agg(F.count("*").alias("pairs"))
    found = an.strong_points(g).groupBy("area_id").agg(F.count_if(F.col("what") == "bridge").alias("sb"), F.count_if(F.col("what") == "articulation").alias("sa"))
    top = an.betweenness(g)[0].groupBy("area_id").agg(F.max("score").alias("top"))
    rows = n.join(s.groupBy("area_id").agg(F.count("*").alias("streets")), "area_id").join(pairs, "area_id", "left").join(found, "area_id", "left").join(top, "area_id", "left")
    rows = rows.join(an.access(g, (FRACTION,)).select("area_id", "flow", F.col("n_gateways").alias("gateways")), "area_id", "left").na.fill(0, ["sb", "sa"])
    pct = lambda a_, b_: st.percent(F.col(a_), F.col(b_))
    return rows.select(
        "area_id", F.lit(clip).alias("clip"), "v", "streets", "core", st.percent(F.col("v") - F.col("core"), F.col("v")).alias("out_pct"), pct("sb", "pairs").alias("strong_bridge_pct"),
        pct("sa", "core").alias("strong_artic_pct"), "gateways", "flow", F.round(100 * F.col("top"), 1).alias("betweenness_max_pct"),
    )


@query("x3_clip_comparison")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return indicators(spark, d, "polygon").union(indicators(spark, d, "box"))


@query("x4_tie_robustness")
def x4(spark: SparkSession, d: str) -> DataFrame:
    draws = an.tie_orders(t.graph(spark, d), DRAWS, FRACTION)
    return draws.groupBy("area_id", "unit", "directed").agg(F.count("*").alias("draws"), F.min("flow").alias("min_flow"), F.max("flow").alias("max_flow"), F.count_distinct("flow").alias("values"), F.count_distinct("region").alias("regions"))


@query("x4_tie_counts")
def x4b(spark: SparkSession, d: str) -> DataFrame:
    return an.tie_counts(t.graph(spark, d), FRACTION)


@t.table
def samples(spark: SparkSession, d: str) -> DataFrame:
    return an.pieces(t.graph(spark, d), PIECE, DRAWS)


@query("x5_ball_pieces")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where("how = 'ball'").select("area_id", "draw", F.explode("piece").alias("node_id"))


@query("x6_random_pieces")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where("how = 'random'").select("area_id", "draw", F.explode("piece").alias("node_id"))


@query("x7_piece_flows")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("area_id", "how", "draw", "flow", "n_gateways")


@query("x8_piece_summary")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return st.piece_summary(samples(spark, d), ["area_id", "how"], "flow")


@query("x9_hill_climb")
def x9(spark: SparkSession, d: str) -> DataFrame:
    low = st.top_k(samples(spark, d), ["area_id"], ["flow", "how", "draw"], 5)
    starts = low.select("area_id", (F.col("place") - 1).alias("scenario"), "piece")
    ended = an.hill_climb(t.graph(spark, d), starts, 60)
    return ended.groupBy("area_id").agg(F.min("first_flow").alias("first_flow"), F.min("flow").alias("flow"), F.min_by("n_gateways", F.struct("flow", "scenario")).alias("n_gateways"), F.min_by("n_nodes", F.struct("flow", "scenario")).alias("n_nodes"))


@query("x10_size_control")
def x10(spark: SparkSession, d: str) -> DataFrame:
    ref = top_scores(spark, d).agg(F.min_by("score", "area_id").alias("ref"))  # the first area is the reference
    big = F.col("core") >= 0.85 * PIECE
    ge = (F.col("top") >= F.col("ref") - 1e-12).cast("int")
    rows = samples(spark, d).join(F.broadcast(ref)).groupBy("area_id", "how").agg(F.count("*").alias("n"), F.round(F.avg(ge), 3).alias("ge_share"), F.count_if(big).alias("n_big"), F.round(F.avg(F.when(big, ge)), 3).alias("ge_share_big"), F.round(F.max("top"), 9).alias("top"))
    return rows


@query("x11_matched_pieces")
def x11(spark: SparkSession, d: str) -> DataFrame:
    got = an.matched_pieces(t.graph(spark, d), 30, 5, 10, 60)
    return got.groupBy("area_id", "how").agg(F.count("*").alias("n"), F.round(F.avg("top"), 6).alias("mean_top"), F.round(F.stddev_pop("top"), 6).alias("sd_top"), F.min("core").alias("min_core"), F.max("core").alias("max_core"))


@query("x12_rewiring")
def x12(spark: SparkSession, d: str) -> DataFrame:
    null = an.rewirings(t.graph(spark, d), 5).groupBy("area_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n"))
    seen = an.plain_betweenness_max(t.graph(spark, d)).withColumnRenamed("score", "seen")
    return null.join(seen, "area_id").select("area_id", "n", r6("mean"), r6("seen"), F.when(F.col("sd") > 1e-12, F.round((F.col("seen") - F.col("mean")) / F.col("sd"), 2)).alias("z"))


@t.table
def resilience_rows(spark: SparkSession, d: str) -> DataFrame:
    return an.resilience(t.graph(spark, d), strong(spark, d))


@query("x13_resilience")
def x13(spark: SparkSession, d: str) -> DataFrame:
    r = resilience_rows(spark, d)
    v = F.sort_array(F.collect_list("parted"))
    mid = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    g = r.groupBy("area_id", "what").agg(F.count("*").alias("n"), v.alias("v"), F.count_if(F.col("detours") == 0).alias("binary"), F.sum("detours").alias("detours"), F.max(F.array_max("extra_min")).alias("extra_max"))
    return g.select("area_id", "what", "n", F.array_min("v").alias("min_parted"), mid(F.col("v")).alias("median_parted"), F.array_max("v").alias("max_parted"), "binary", "detours", F.round("extra_max", 6).alias("extra_max_min"))


# --- closures


def _world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t.ring_graph(spark, d), regions(spark, d)


@query("d1_world")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return an.worlds(*_world(spark, d), RADIUS_LEVEL, t.RADII[RADIUS_LEVEL])


@t.table
def pool(spark: SparkSession, d: str) -> DataFrame:
    return an.pools(*_world(spark, d), RADIUS_LEVEL, t.RADII[RADIUS_LEVEL])


def losses(spark: SparkSession, d: str, closures: DataFrame) -> DataFrame:
    return an.closure_losses(*_world(spark, d), closures, RADIUS_LEVEL, t.RADII[RADIUS_LEVEL])


@t.table
def lone_damage(spark: SparkSession, d: str) -> DataFrame:
    rows = an.numbered(pool(spark, d), "lo", "hi")
    got = losses(spark, d, rows.select("area_id", "scenario", F.array(F.struct("lo", "hi")).alias("closed")))
    return rows.join(got, ["area_id", "scenario"]).select("area_id", "lo", "hi", "source_loss", "interior_loss")


@query("d2_closure_loss")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return lone_damage(spark, d).select("area_id", "lo", "hi", r6("source_loss"), r6("interior_loss"))


@t.table
def indicator_sets(spark: SparkSession, d: str) -> DataFrame:
    """``name, area_id, lo, hi``: streets that each indicator names, within the pool."""
    p = pool(spark, d)
    inside = lambda rows, name: rows.select("area_id", "lo", "hi").join(p, ["area_id", "lo", "hi"], "left_semi").select(F.lit(name).alias("name"), "area_id", "lo", "hi")
    acc = an.access_cut_streets(*_world(spark, d))
    sets = inside(strong(spark, d).where("what = 'bridge'"), "strong_bridges").union(inside(weak(spark, d).where("what = 'bridge'"), "weak_bridges"))
    return sets.union(inside(acc.where("what = 'cut'"), "flow_cut")).union(inside(acc.where("what = 'critical'"), "flow_critical"))


@t.table
def ranked_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool by street betweenness: ``place`` from 1."""
    s = pool(spark, d).join(street_scores(spark, d), ["area_id", "lo", "hi"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("area_id").orderBy(F.desc("score"), "lo", "hi")))


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """``area_id, strategy, k, draw, closed``: k streets, preferred ones first, in the order of a hash of each draw."""
    p = pool(spark, d)
    names = spark.createDataFrame([(n,) for n in ("random", "strong_bridges", "weak_bridges", "flow_cut", "flow_critical")], "strategy string")
    draws = spark.range(DRAWS).select(F.col("id").cast("int").alias("draw"))
    ks = spark.createDataFrame([(k,) for k in CLOSURES], "k int")
    pref = indicator_sets(spark, d).select(F.col("name").alias("strategy"), "area_id", "lo", "hi", F.lit(1).alias("pref"))
    rows = p.join(F.broadcast(names)).join(pref, ["strategy", "area_id", "lo", "hi"], "left").join(F.broadcast(draws))
    order = [F.desc(F.coalesce("pref", F.lit(0))), F.md5(F.concat_ws("|", F.lit("13"), "strategy", "draw", "lo", "hi"))]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("area_id", "strategy", "draw").orderBy(*order))).where(f"place <= {max(CLOSURES)}")
    return rows.join(F.broadcast(ks), F.col("place") <= F.col("k")).groupBy("area_id", "strategy", "k", "draw").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("closed"))


@t.table
def drawn_sets(spark: SparkSession, d: str) -> DataFrame:
    return drawn(spark, d)


@query("d3_drawn_closures")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return drawn_sets(spark, d).select("area_id", "strategy", "k", "draw", F.posexplode("closed").alias("pos", "c")).select("area_id", "strategy", "k", "draw", "pos", "c.lo", "c.hi")


@t.table
def greedy_order(spark: SparkSession, d: str) -> DataFrame:
    return an.greedy(*_world(spark, d), RADIUS_LEVEL, t.RADII[RADIUS_LEVEL], max(CLOSURES))


@query("d4_strategies")
def d4(spark: SparkSession, d: str) -> DataFrame:
    ks = F.broadcast(spark.createDataFrame([(k,) for k in CLOSURES], "k int"))
    chosen = ranked_pool(spark, d).select("area_id", F.lit("betweenness").alias("strategy"), "place", "lo", "hi").union(greedy_order(spark, d).select("area_id", F.lit("greedy"), "step", "lo", "hi"))
    fixed = chosen.join(ks, F.col("place") <= F.col("k")).groupBy("area_id", "strategy", "k").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("closed")).withColumn("draw", F.lit(0))
    rows = an.numbered(drawn_sets(spark, d).unionByName(fixed), "strategy", "k", "draw")
    got = losses(spark, d, rows.select("area_id", "scenario", "closed"))
    return st.loss_summary(rows.select("area_id", "scenario", "strategy", "k").join(got, ["area_id", "scenario"]), ["area_id", "strategy", "k"])


@query("d5_greedy_attack")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return greedy_order(spark, d).select("area_id", "step", "lo", "hi", r6("source_loss"), r6("interior_loss"))


@query("d6_precision_recall")
def d6(spark: SparkSession, d: str) -> DataFrame:
    hit = lone_damage(spark, d).select("area_id", "lo", "hi", (F.col("source_loss") > 1e-12).alias("damage"))
    n = hit.groupBy("area_id").agg(F.count_if("damage").alias("n_damage"))
    top = ranked_pool(spark, d).join(n, "area_id").where("place <= n_damage").select(F.lit("betweenness_top").alias("name"), "area_id", "lo", "hi")
    sets = indicator_sets(spark, d).union(top).join(hit, ["area_id", "lo", "hi"]).groupBy("area_id", "name").agg(F.count("*").alias("size"), F.count_if("damage").alias("hits"))
    return sets.join(n, "area_id").select("area_id", "name", "size", "hits", F.round(F.col("hits") / F.col("size"), 6).alias("precision"), F.when(F.col("n_damage") > 0, F.round(F.col("hits") / F.col("n_damage"), 6)).alias("recall"))


@query("d7_spearman")
def d7(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked_pool(spark, d).join(lone_damage(spark, d), ["area_id", "lo", "hi"]).withColumn("source_loss", F.round("source_loss", 9))
    return st.spearman(rows, ["area_id"], "score", "source_loss")


@query("d8_jaccard")
def d8(spark: SparkSession, d: str) -> DataFrame:
    sets = ["flow_critical", "flow_cut", "strong_bridges", "weak_bridges"]
    every = pool(spark, d).select(F.lit("pool").alias("name"), "area_id", "lo", "hi")
    return st.jaccard(indicator_sets(spark, d).union(every), sets, ["area_id"], ["lo", "hi"])


# --- reports


@t.table
def metrics(spark: SparkSession, d: str) -> DataFrame:
    w = weak(spark, d).groupBy("area_id").agg(F.count_if(F.col("what") == "bridge").alias("bridges"))
    s = strong(spark, d).groupBy("area_id").agg(F.count_if(F.col("what") == "bridge").alias("strong_bridges"), F.count_if(F.col("what") == "articulation").alias("strong_artics"))
    pairs = an.strong_candidates(t.graph(spark, d)).where("lo <> hi").groupBy("area_id").agg(F.count("*").alias("core_pairs"))
    flow = access_flow(spark, d).select("area_id", "flow")
    out = small_metrics(spark, d)
    for x in (w, s, pairs, flow, top_scores(spark, d).select("area_id", F.col("score").alias("top"))):
        out = out.join(x, "area_id", "left")
    mid = x13(spark, d).select("area_id", "what", "median_parted").groupBy("area_id").pivot("what", ["bridge", "articulation"]).agg(F.first("median_parted"))
    return out.join(mid.select("area_id", F.col("bridge").alias("mid_b"), F.col("articulation").alias("mid_a")), "area_id", "left").na.fill(0, ["bridges", "strong_bridges", "strong_artics", "core_pairs", "flow"])


@query("r1_comparison_table")
def r1(spark: SparkSession, d: str) -> DataFrame:
    c, pct = F.col, st.percent
    two_way = c("arcs") - c("streets")
    pairs = c("core") * (c("core") - 1)
    rows = {
        "v": c("v"), "streets": c("streets"), "one_way_pct": pct(c("streets") - two_way, c("streets")), "core": c("core"), "gateways": c("n_gateways"), "access_flow": c("flow"),
        "betweenness_max_pct": F.round(100 * c("top"), 2), "outside_core_pct": pct(c("v") - c("core"), c("v")), "bridge_pct": pct(c("bridges"), c("streets")),
        "strong_bridge_pct": pct(c("strong_bridges"), c("core_pairs")), "strong_artic_pct": pct(c("strong_artics"), c("core")),
        "median_parted_bridge_pct": pct(c("mid_b"), pairs), "median_parted_artic_pct": pct(c("mid_a"), pairs),
    }
    # a row an indicator and area: any number of areas
    return reports.long_rows(metrics(spark, d).select("area_id", *[v.alias(k) for k, v in rows.items()]), ["area_id"], "indicator", "value")


@query("r2_one_way_share")
def r2(spark: SparkSession, d: str) -> DataFrame:
    two_way = F.col("arcs") - F.col("streets")
    return small_metrics(spark, d).select("area_id", two_way.alias("two_way"), st.percent(F.col("streets") - two_way, F.col("streets")).alias("one_way_pct"))


@query("r3_cross_table")
def r3(spark: SparkSession, d: str) -> DataFrame:
    """A row a cell of the table, also such as have none."""
    cells = spark.createDataFrame([(w, k) for w in ("bridge", "articulation") for k in ("both", "strong_only", "weak_only")], "what string, kind string")
    grid = areas(spark, d).select("area_id").join(F.broadcast(cells))
    return grid.join(w5(spark, d), ["area_id", "what", "kind"], "left").na.fill(0, ["n"])


@query("r4_flow_histogram")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return st.histogram(samples(spark, d), ["area_id"], "flow")


@query("r5_route_lines")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """Points of the streets along each route, in travel order."""
    p = od_paths(spark, d)
    legs = p.withColumnRenamed("node_id", "a").join(p.select("area_id", "rule", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("b")), ["area_id", "rule", "pos"])
    s = t.area_streets(spark, d)
    by = Window.partitionBy("area_id", "u", "v").orderBy("time_s", "street_id")
    lines = s.where("fwd").select("area_id", "u", "v", "time_s", "street_id", "path").union(s.where("bwd").select("area_id", "v", "u", "time_s", "street_id", F.reverse("path")))
    first = lines.withColumn("nth", F.row_number().over(by)).where("nth = 1").select("area_id", F.col("u").alias("a"), F.col("v").alias("b"), F.col("path").alias("line"))
    return legs.join(first, ["area_id", "a", "b"], "left").select("area_id", "rule", "pos", F.posexplode(F.coalesce("line", F.array("a", "b"))).alias("rank", "node_id"))


@query("r6_scc_sizes")
def r6_(spark: SparkSession, d: str) -> DataFrame:
    size = t.area_parts(spark, d).groupBy("area_id", "scc").agg(F.count("*").alias("size"))
    trivial = size.groupBy("area_id").agg(F.count_if(F.col("size") == 1).alias("trivial"))
    by = Window.partitionBy("area_id").orderBy(F.desc("size"), "scc")
    return size.where("size > 1").withColumn("place", F.row_number().over(by).cast("long")).join(trivial, "area_id").select("area_id", "place", "scc", "size", "trivial")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["c5_strong_components"](spark, sf_dir)
