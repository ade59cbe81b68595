"""Network build: tagged ways to contracted, directed, travel-time-weighted streets.

One network is built over the whole input and clipped afterwards, so that an
area's streets don't depend on where its envelope was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayloom.session import cut

# fixed values: drivable road classes with the speed (km/h) of each where none is stated
CLASS_SPEED = {
    "motorway": 90, "trunk": 80, "primary": 60, "secondary": 50, "tertiary": 40, "unclassified": 40, "residential": 30, "living_street": 20, "road": 30,
    "motorway_link": 60, "trunk_link": 50, "primary_link": 40, "secondary_link": 40, "tertiary_link": 30,
}
DEFAULT_SPEED = 30
EARTH_M = 6371000.0
KX, KY = 111320.0, 110540.0


def drivable(ways: DataFrame) -> DataFrame:
    """Ways of a drivable class."""
    return ways.where(F.col("tags")["highway"].isin(*CLASS_SPEED))


def direction(tags: Column) -> Column:
    """1 along the way's points, -1 against them, 0 both ways."""
    said = F.lower(F.coalesce(tags["oneway"], F.lit("")))
    return (
        F.when(said.isin("yes", "true", "1"), 1)
        .when(said.isin("-1", "reverse"), -1)
        .when(tags["junction"] == "roundabout", 1)
        .when(tags["highway"].isin("motorway", "motorway_link", "trunk_link"), 1)
        .otherwise(0)
    )


def speed(tags: Column) -> Column:
    """Stated speed (its first token, unit ignored), else that of the class."""
    first = F.regexp_extract(tags["maxspeed"], r"^\s*(\S+)", 1)
    table = F.create_map(*[x for k, v in CLASS_SPEED.items() for x in (F.lit(k), F.lit(float(v)))])
    own = F.try_element_at(table, F.coalesce(tags["highway"], F.lit("residential")))
    return F.coalesce(first.try_cast("double"), own, F.lit(float(DEFAULT_SPEED)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle length in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def travel_time(length_m: Column, kmh: Column) -> Column:
    return length_m / (kmh * 1000 / 3600)


def centres(nodes: DataFrame) -> DataFrame:
    """``area_id, lat0, lon0``: the mean point of each area's nodes."""
    return nodes.groupBy("area_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))


def projected(nodes: DataFrame, centre: DataFrame) -> DataFrame:
    """``nodes`` of areas with planar ``x, y`` in metres around each area's centre."""
    x = (F.col("lon") - F.col("lon0")) * F.cos(F.radians("lat0")) * KX
    return nodes.join(centre, "area_id").select(*nodes.columns, x.alias("x"), ((F.col("lat") - F.col("lat0")) * KY).alias("y"))


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id, pos, a, b, length_m, kmh, dir``: pieces between consecutive points of nonzero length."""
    ends = ways.select("way_id", "nodes", speed(F.col("tags")).alias("kmh"), direction(F.col("tags")).alias("dir"), F.posexplode("nodes").alias("pos", "a"))
    ends = ends.withColumn("b", F.get("nodes", F.col("pos") + 1)).where("b is not null").drop("nodes")
    at = lambda k: nodes.select(F.col("node_id").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"))
    both = ends.join(at("a"), "a").join(at("b"), "b")
    length = haversine(*[F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")])
    return both.withColumn("length_m", length).where("length_m > 0").select("way_id", "pos", "a", "b", "length_m", "kmh", "dir")


def segment_arcs(segs: DataFrame) -> DataFrame:
    """Directed node pairs that some segment allows."""
    ahead = segs.where("dir >= 0").select("a", "b")
    return ahead.union(segs.where("dir <= 0").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(segs: DataFrame) -> DataFrame:
    """``node_id, degree`` by segments."""
    return segs.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def intersections(segs: DataFrame) -> DataFrame:
    """Nodes where chains end: degree other than 2, or the smallest node of a network that is one ring."""
    deg = degrees(segs)
    one = deg.agg(F.count_if(F.col("degree") != 2).alias("n"), F.min("node_id").alias("node_id")).where("n = 0 and node_id is not null").select("node_id")
    return deg.where("degree <> 2").select("node_id").union(one)


def chains(segs: DataFrame, rounds: int = 40) -> DataFrame:
    """Contracted chains ``u, v, length_m, time_s, fwd, bwd, path`` by pointer doubling over half-segments.

    Every half-segment points to the half-segment that follows it through a node
    of degree 2; each round doubles the reach of those that have not arrived, in
    rows of one size.  How far each is from its chain's end gives the order of the
    path, which is put together once.  Isolated rings are never reached from an end
    and vanish.
    """
    arcs = segment_arcs(segs)
    lo_hi = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    first = segs.select("*", *lo_hi).groupBy("lo", "hi").agg(F.min_by("kmh", F.struct("way_id", "pos")).alias("pair_kmh"))
    timed = segs.select("*", *lo_hi).join(first, ["lo", "hi"]).withColumn("time_s", travel_time(F.col("length_m"), F.col("pair_kmh")))
    yes = arcs.withColumn("yes", F.lit(True))
    back = yes.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("yes").alias("no"))
    timed = timed.join(yes, ["a", "b"], "left").join(back, ["a", "b"], "left")
    sid = F.struct("way_id", "pos")
    ab, ba = F.coalesce("yes", F.lit(False)), F.coalesce("no", F.lit(False))
    half = timed.select(sid.alias("sid"), F.lit(0).alias("side"), "a", "b", "length_m", "time_s", ab.alias("fwd"), ba.alias("bwd")).union(
        timed.select(sid.alias("sid"), F.lit(1).alias("side"), F.col("b").alias("a"), F.col("a").alias("b"), "length_m", "time_s", ba.alias("fwd"), ab.alias("bwd"))
    )
    half = cut(half.withColumn("hid", F.xxhash64("sid", "side")))
    ends = cut(intersections(segs))
    through = half.join(ends, half.b == ends.node_id, "left_anti")
    follow = half.select(F.col("a").alias("_a"), F.col("sid").alias("_sid"), F.col("hid").alias("next"))
    nxt = through.join(follow, (through.b == F.col("_a")) & (through.sid != F.col("_sid"))).select("hid", "next")
    heads = ends.select(F.col("node_id").alias("a"), F.lit(True).alias("head"))
    state = half.join(nxt, "hid", "left").join(heads, "a", "left")
    state = cut(state.select("hid", "sid", "head", "a", "b", "length_m", "time_s", "fwd", "bwd", "next", F.lit(1).cast("long").alias("n"), F.struct("hid", "sid", F.col("b").alias("before")).alias("last")))
    for _ in range(rounds):
        if state.where("next is not null and head").isEmpty():
            break
        to = state.select(
            F.col("hid").alias("next"), F.col("b").alias("b2"), F.col("length_m").alias("l2"), F.col("time_s").alias("t2"), F.col("fwd").alias("f2"), F.col("bwd").alias("k2"),
            F.col("next").alias("n2"), F.col("n").alias("m2"), F.col("last").alias("last2"),
        )
        moving = state.where("next is not null").join(to, "next").select(
            "hid", "sid", "head", "a", F.col("b2").alias("b"), (F.col("length_m") + F.col("l2")).alias("length_m"), (F.col("time_s") + F.col("t2")).alias("time_s"),
            (F.col("fwd") & F.col("f2")).alias("fwd"), (F.col("bwd") & F.col("k2")).alias("bwd"), F.col("n2").alias("next"), (F.col("n") + F.col("m2")).alias("n"), F.col("last2").alias("last"),
        )
        state = cut(state.where("next is null").unionByName(moving))
    else:
        raise RuntimeError("chains did not reach their ends")
    done = state.where("next is null and head").join(ends.withColumnRenamed("node_id", "b"), "b", "left_semi")
    # of the two directions, that which starts at the smaller (node, segment)
    whole = done.where(F.struct("a", "sid") <= F.struct(F.col("b").alias("a"), F.col("last.sid").alias("sid")))
    # a half-segment begins where the chain still has n of them ahead
    steps = state.where("next is null").select(F.col("last.hid").alias("_last"), "n", "a").groupBy("_last").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))).alias("steps"))
    whole = whole.join(steps, F.col("last.hid") == F.col("_last"))
    return whole.select(
        F.col("a").alias("u"), F.col("b").alias("v"), F.col("sid.way_id").alias("way_id"), F.col("sid.pos").alias("pos"), "length_m", "time_s", "fwd", "bwd",
        F.concat(F.col("steps.a"), F.array("b")).alias("path"),
    )


def street_id(way_id: str = "way_id", pos: str = "pos") -> Column:
    """One number for a way's segment: ways have less than 2^20 points."""
    return F.shiftleft(F.col(way_id).cast("long"), 20) + F.col(pos)


def streets(chained: DataFrame) -> DataFrame:
    """Kept chains as undirected streets; loops and chains open in neither direction go."""
    kept = chained.where("u <> v and (fwd or bwd)")
    return kept.select(street_id().alias("street_id"), "u", "v", "length_m", "time_s", "fwd", "bwd", "path")


def arcs_of(street: DataFrame) -> DataFrame:
    """Directed arcs of the kept streets."""
    cols = ["street_id", "length_m", "time_s"]
    return street.where("fwd").select("u", "v", *cols).union(street.where("bwd").select(F.col("v").alias("u"), F.col("u").alias("v"), *cols))


def network_nodes(chained: DataFrame, nodes: DataFrame) -> DataFrame:
    """End nodes of all chains, discarded ones too."""
    ends = chained.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id")


def geometry(street: DataFrame, nodes: DataFrame) -> DataFrame:
    """``street_id, geom``: the points of each street in order, by longitude and latitude."""
    pts = street.select("street_id", F.posexplode("path").alias("rank", "node_id")).join(nodes, "node_id")
    line = F.array_sort(F.collect_list(F.struct("rank", "lon", "lat")))
    return pts.groupBy("street_id").agg(F.transform(line, lambda p: F.struct(p["lon"], p["lat"])).alias("geom"))


def build_stats(ways: DataFrame, chained: DataFrame) -> DataFrame:
    """A row an area: ways, those with a stated speed, chains kept, loops, mixed, parallel pairs, share discarded.

    Ways ``(area_id, way_id, tags)`` and chains ``(area_id, u, v, fwd, bwd)`` are those of each area.
    """
    w = ways.groupBy("area_id").agg(F.count("*").alias("ways"), F.count_if(F.col("tags")["maxspeed"].isNotNull()).alias("with_maxspeed"))
    loop, open_ = F.col("u") == F.col("v"), F.col("fwd") | F.col("bwd")
    c = chained.groupBy("area_id").agg(F.count_if(~loop & open_).alias("kept"), F.count_if(loop).alias("loops"), F.count_if(~loop & ~open_).alias("mixed"))
    pairs = chained.where(~loop & open_).groupBy("area_id", F.least("u", "v"), F.greatest("u", "v")).agg(F.count("*").alias("n")).where("n > 1")
    p = pairs.groupBy("area_id").agg(F.count("*").alias("parallel_pairs"))
    out = w.join(c, "area_id", "left").join(p, "area_id", "left").na.fill(0)
    every = F.col("kept") + F.col("loops") + F.col("mixed")
    return out.withColumn("discarded_pct", F.when(every > 0, F.round(100 * (F.col("loops") + F.col("mixed")) / every, 1)))


def pair_key(u: str = "u", v: str = "v") -> list[Column]:
    return [F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi")]


def node_degrees(street: DataFrame, by: Window | None = None) -> DataFrame:
    """``area_id, node_id, degree`` by streets."""
    return street.select("area_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("area_id", "node_id").agg(F.count("*").alias("degree"))
