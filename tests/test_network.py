"""Network build, spatial joins and statistics on hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from wayloom.operators import components, network as nw, spatial as sp, statistics as st, traversal as tr


def built(spark, ways, at=None):
    """Chains of ways given as {id: (points, tags)}; node k lies k * 0.001 degrees east unless told."""
    ids = sorted({p for pts, _ in ways.values() for p in pts})
    at = at or {}
    nodes = spark.createDataFrame([(i, *at.get(i, (0.0, i * 0.001))) for i in ids], "node_id long, lat double, lon double")
    rows = spark.createDataFrame([(k, pts, {"highway": "residential", **tags}) for k, (pts, tags) in ways.items()], "way_id long, nodes array<long>, tags map<string,string>")
    return nw.segments(rows, nodes), nodes, rows


def ends(*stubs):
    """Two dead ends at each node, so that it stays."""
    return {900 + 10 * n + k: ([n, 500 + 10 * n + k], {}) for n in stubs for k in (1, 2)}


def chains(spark, ways, at=None):
    return nw.chains(built(spark, ways, at)[0]).collect()


def main_chains(rows):
    return [r for r in rows if r.u < 100 and r.v < 100]


def stats(ways, chained):
    one = F.lit(1).alias("area_id")
    return nw.build_stats(ways.select(one, "way_id", "tags"), chained.select(one, "u", "v", "fwd", "bwd")).first()


def test_long_ways_and_street_ids(spark):
    """A way of 1500 points with ends along it: no two streets share an id, paths are in order."""
    pts = list(range(1000, 2500))
    ways = {7: (pts, {}), 8: (list(range(3000, 3020)), {})} | {10_000 + k: ([1000 + 100 * k, 90_000 + k], {}) for k in range(1, 15)} | {20_000 + k: ([3000 + k, 95_000 + k], {}) for k in range(1, 19)}
    at = {i: (0.0, i * 1e-4) for i in range(1000, 4000)} | {90_000 + k: (0.01, 0.001 * k) for k in range(20)} | {95_000 + k: (0.02, 0.001 * k) for k in range(20)}
    rows = nw.streets(nw.chains(built(spark, ways, at)[0])).collect()
    assert len({r.street_id for r in rows}) == len(rows) > 40
    long = [r for r in rows if r.u in range(1100, 2500) and r.v in range(1100, 2500)]
    assert {(r.u, r.v) for r in long} >= {(1000 + 100 * k, 1100 + 100 * k) for k in range(1, 14)}
    assert all(r.path == list(range(r.u, r.v + 1)) for r in long)


def test_two_far_cities_are_projected_apart(spark):
    nodes = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 0.0, 10.01), (2, 3, 60.0, 10.0), (2, 4, 60.0, 10.01)], "area_id long, node_id long, lat double, lon double")
    x = {r.node_id: r.x for r in nw.projected(nodes, nw.centres(nodes)).collect()}
    assert x[2] - x[1] == pytest.approx(1113.2, abs=0.1) and x[4] - x[3] == pytest.approx(556.6, abs=0.1)


def test_unfinished_chains_raise(spark):
    segs = built(spark, {1: (list(range(10, 60)), {})})[0]
    with pytest.raises(RuntimeError):
        nw.chains(segs, rounds=2)


def test_shape_points_contract(spark):
    segs, _, _ = built(spark, {1: ([1, 10, 11, 2], {})} | ends(1, 2))
    total = sum(r.length_m for r in segs.where("way_id = 1").collect())
    (row,) = main_chains(nw.chains(segs).collect())
    assert (row.u, row.v, row.path) == (1, 2, [1, 10, 11, 2]) and row.length_m == pytest.approx(total) and row.fwd and row.bwd


def test_mixed_chain_is_dropped_but_keeps_its_ends(spark):
    ways = {1: ([1, 10], {"oneway": "yes"}), 2: ([2, 10], {"oneway": "yes"})} | ends(1, 2)
    segs, nodes, rows = built(spark, ways)
    c = nw.chains(segs)
    (row,) = main_chains(c.collect())
    assert not row.fwd and not row.bwd
    assert stats(rows, c).mixed == 1
    assert {1, 2} <= {r.node_id for r in nw.network_nodes(c, nodes).collect()}


def test_loop_is_counted(spark):
    segs, _, rows = built(spark, {1: ([1, 10, 11, 1], {})} | ends(1), {10: (0.001, 0.0), 11: (0.001, 0.001)})
    c = nw.chains(segs)
    assert stats(rows, c).loops == 1 and not main_chains(nw.streets(c).collect())


def test_isolated_ring_vanishes(spark):
    at = {20: (0.1, 0.1), 21: (0.1, 0.101), 22: (0.101, 0.1)}
    rows = chains(spark, {1: ([20, 21, 22, 20], {})} | ends(1), at)
    assert not {20, 21, 22} & {n for r in rows for n in r.path}


def test_whole_network_is_a_ring(spark):
    at = {20: (0.1, 0.1), 21: (0.1, 0.101), 22: (0.101, 0.1)}
    (row,) = chains(spark, {1: ([20, 21, 22, 20], {})}, at)
    assert row.u == row.v == 20


def test_direction_is_by_pair(spark):
    rows = chains(spark, {1: ([1, 2], {"oneway": "yes"}), 2: ([2, 1], {"oneway": "yes"})} | ends(1, 2))
    assert [(r.fwd, r.bwd) for r in main_chains(rows)] == [(True, True)] * 2


def test_tags(spark):
    rows = [({"oneway": "no", "junction": "roundabout", "highway": "residential"}, 1, 30.0), ({"highway": "primary", "maxspeed": "30 mph"}, 0, 30.0), ({"highway": "primary", "maxspeed": "50;60"}, 0, 60.0), ({"highway": "road"}, 0, 30.0), ({"highway": "motorway", "oneway": "-1"}, -1, 90.0), ({}, 0, 30.0)]
    df = spark.createDataFrame([(t, d, s) for t, d, s in rows], "tags map<string,string>, d int, s double")
    for r in df.select("d", "s", nw.direction(df.tags).alias("dir"), nw.speed(df.tags).alias("kmh")).collect():
        assert (r.dir, r.kmh) == (r.d, r.s)


def l_shape(spark):
    pts = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    return spark.createDataFrame([(1, 0, i, x * 0.01, y * 0.01) for i, (x, y) in enumerate(pts)], "area_id long, ring_id int, seq int, lon double, lat double")


def test_concave_polygon_and_distance(spark):
    nodes = spark.createDataFrame([(1, 0.02, 0.02), (2, 0.005, 0.025), (3, 0.025, 0.005), (4, 5.0, 5.0)], "node_id long, lat double, lon double")
    assert {r.node_id for r in sp.points_in_areas(nodes, l_shape(spark)).collect()} == {2, 3}
    dist = {r.node_id: r.dist_m for r in sp.distance_to_areas(nodes, l_shape(spark), 3000.0).collect()}
    assert dist[2] == dist[3] == 0 and 4 not in dist and dist[1] == pytest.approx(0.01 * nw.KY, rel=0.01)


def test_distances_by_cells_equal_all_edges(spark):
    """A star of random spikes with a hole and an upright edge; nodes near, far, and in its gulfs."""
    import random

    rng = random.Random(3)
    turn = [(k / 23 * 2 * math.pi, rng.uniform(0.002, 0.02)) for k in range(23)]
    rings = [[(r * math.cos(a), 0.3 + r * math.sin(a)) for a, r in turn], [(0.0305, 0.3), (0.0305, 0.304), (0.034, 0.304), (0.034, 0.3)]]
    pts = [(7, k, i, x, y) for k, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]])]
    own = {k: (rng.uniform(-0.05, 0.06), rng.uniform(0.26, 0.34)) for k in range(400)}
    nodes = spark.createDataFrame([(k, y, x) for k, (x, y) in own.items()], "node_id long, lat double, lon double")
    points = spark.createDataFrame(pts, "area_id long, ring_id int, seq int, lon double, lat double")
    inside = {r.node_id for r in sp.points_in_areas(nodes, points).collect()}
    kx = math.cos(math.radians(sum(p[4] for p in pts) / len(pts))) * nw.KX
    flat = lambda p: (p[0] * kx, p[1] * nw.KY)

    def apart(p, a, b):
        (px, py), (ax, ay), (bx, by) = flat(p), flat(a), flat(b)
        l2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / l2))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    xs, ys = [flat(p[3:])[0] for p in pts], [flat(p[3:])[1] for p in pts]
    want = {}
    for k, p in own.items():
        x, y = flat(p)
        if k in inside:
            want[k] = 0.0
        elif math.hypot(max(min(xs) - x, 0, x - max(xs)), max(min(ys) - y, 0, y - max(ys))) <= 1500:
            want[k] = min(apart(p, a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]))
    for first in (20.0, 128.0):
        got = {r.node_id: r.dist_m for r in sp.distance_to_areas(nodes, points, 1500.0, first).collect()}
        assert got.keys() == want.keys() and inside and max(want.values()) > 500
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_components_match_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_relaxation(spark):
    arcs = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 1, 3, 5.0), (1, 3, 3, 1.0), (2, 1, 9, 4.0)], "area_id long, u long, v long, time_s double")
    got = {(r.area_id, r.node_id): r.time_s for r in tr.relax(arcs, spark.createDataFrame([(1, 1), (2, 1)], "area_id long, node_id long")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): 0, (2, 9): 4}


def test_statistics(spark):
    rows = spark.createDataFrame([(1, float(v), float(w)) for v, w in zip([1, 2, 2, 4], [1, 3, 3, 9])], "k int, a double, b double")
    s = st.piece_summary(rows, ["k"], "a").first()
    assert (s.n, s["min"], s["median"], s["p95"], s["max"], s.le_3, s.le_1) == (4, 1, 2, 2, 4, 0.75, 0.25)
    assert st.spearman(rows, ["k"], "a", "b").first().rho == 1.0
    flat = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "k int, a double, b double")
    assert st.spearman(flat, ["k"], "a", "b").first().rho is None
    m = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 2)], "k int, name string, item int")
    assert {(r.a, r.b): r.jaccard for r in st.jaccard(m, ["x", "y", "z", "zz"], ["k"], ["item"]).collect()}[("x", "y")] == 0.5
    assert {(r.a, r.b): r.jaccard for r in st.jaccard(m, ["x", "y", "z", "zz"], ["k"], ["item"]).collect()}[("z", "zz")] is None
