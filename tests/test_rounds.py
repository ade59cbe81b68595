"""Operators that work in rounds over whole tables, against brute force on small graphs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import elimination as el, strong, weak


def arcs_of(spark, arcs):
    return spark.createDataFrame([(u, v, float(w)) for u, v, w in arcs], "u long, v long, w double")


def random_arcs(rng, n, m, base=0):
    return [(base + rng.randrange(n), base + rng.randrange(n), rng.choice([1, 1, 2, 3.5])) for _ in range(m)]


def shortest(arcs, sources):
    d = dict.fromkeys(sources, 0.0)
    for _ in range(len(arcs) + 1):
        moved = False
        for u, v, w in arcs:
            if u in d and d[u] + w < d.get(v, math.inf):
                d[v], moved = d[u] + w, True
        if not moved:
            return d


def reach(arcs, s):
    return set(shortest([(u, v, 0) for u, v, _ in arcs], [s]))


def components(arcs):
    """Smallest node of each node's strong component."""
    nodes = {x for a in arcs for x in a[:2]}
    ahead = {x: reach(arcs, x) for x in nodes}
    return {x: min(y for y in nodes if y in ahead[x] and x in ahead[y]) for x in nodes}


GRAPHS = [(random.Random(k), n, m, fill) for k, (n, m, fill) in enumerate([(20, 28, el.FILL), (30, 80, 1)])]


@pytest.mark.parametrize("rng,n,m,fill", GRAPHS)
def test_distances_and_paths(spark, rng, n, m, fill):
    arcs = random_arcs(rng, n, m) + random_arcs(rng, n, m, 1000)
    table = arcs_of(spark, arcs)
    starts = {0: [arcs[0][0]], 1: [arcs[0][0], arcs[1][0], arcs[-1][0]]}
    src = spark.createDataFrame([(k, x, 0.0) for k, v in starts.items() for x in v], "search int, node long, d double")
    g = el.eliminate(table, fill)
    got = {(r.search, r.node): r.d for r in el.distances(g, src).collect()}
    assert got == {(k, x): d for k, v in starts.items() for x, d in shortest(arcs, v).items()}
    back = {(r.search, r.node): r.d for r in el.distances(g.turned(), src).collect()}
    assert back == {(k, x): d for k, v in starts.items() for x, d in shortest([(b, a, w) for a, b, w in arcs], v).items()}
    dist = el.distances(g, src)
    forest = el.predecessors(dist, table)
    far = {k: max((d, x) for (j, x), d in got.items() if j == k)[1] for k in starts}
    legs = el.paths(forest, spark.createDataFrame(list(far.items()), "search int, node long")).collect()
    for k, target in far.items():
        path = [r.node for r in sorted((r for r in legs if r.search == k), key=lambda r: r.pos)]
        assert path[0] in starts[k] and path[-1] == target
        assert sum(min(w for u, v, w in arcs if (u, v) == step) for step in zip(path, path[1:])) == got[k, target]


@pytest.mark.parametrize("rng,n,m,fill", [*GRAPHS, (random.Random(5), 12, 20, -9)])
def test_strong_components(spark, rng, n, m, fill):
    arcs = random_arcs(rng, n, m) + random_arcs(rng, n, m, 1000)
    g = el.eliminate(arcs_of(spark, arcs), fill)
    got = {r.node: r.scc for r in strong.strong_components(g).collect()}
    want = components([a for a in arcs if a[0] != a[1]])
    assert got == want


def test_long_rings_and_hubs_take_few_rounds(spark):
    n, hub = 600, 50_000
    ring = spark.range(n).select(F.col("id").alias("u"), ((F.col("id") + 1) % n).alias("v"), F.lit(1.0).alias("w"))
    spokes = spark.range(n).select(F.lit(hub).cast("long").alias("u"), (F.col("id") + 60_000).alias("v"), F.lit(2.0).alias("w"))
    link = spark.createDataFrame([(5, hub, 1.0)], "u long, v long, w double")
    g = el.eliminate(ring.union(spokes).union(link))
    assert len(g.levels) < 30 and g.core.count() < 50
    scc = strong.strong_components(g).groupBy("scc").count().orderBy(F.desc("count")).limit(2).collect()
    assert [r["count"] for r in scc] == [n, 1]
    dist = el.distances(g, spark.createDataFrame([(0, 0, 0.0)], "search int, node long, d double"))
    assert dist.where(f"node = {n - 1}").first().d == n - 1 and dist.where("node >= 60000").agg(F.min("d"), F.max("d"), F.count("*")).first() == (8.0, 8.0, n)


def together(nodes, edges):
    """Smallest node of each node's component."""
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def random_edges(rng, n, m, base=0):
    return [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("rng,n,m", [(random.Random(k), n, m) for k, (n, m) in enumerate([(30, 34), (20, 60)])])
def test_bridges_and_articulations(spark, rng, n, m):
    edges = random_edges(rng, n, m) + random_edges(rng, n, m, 100)
    pairs, tour = weak.structure(spark.createDataFrame(edges, "a long, b long"))
    plain = [e for e in edges if e[0] != e[1]]
    nodes = {x for e in plain for x in e}
    base = together(nodes, plain)
    count = lambda ns, es: len(set(together(ns, es).values()))
    every = {tuple(sorted(e)) for e in plain}
    bridges = {p for p in every if sum(tuple(sorted(e)) == p for e in plain) == 1 and count(nodes, [e for e in plain if tuple(sorted(e)) != p]) > count(nodes, plain)}
    assert {(r.lo, r.hi) for r in weak.bridges(pairs, tour).collect()} == bridges
    cuts = {x for x in nodes if count(nodes - {x}, [e for e in plain if x not in e]) > count(nodes, plain)}
    assert {r.node for r in weak.articulations(pairs, tour).collect()} == cuts
    # intervals are subtrees: sums over the root's is the component's size
    sums = {r.node: r.n for r in weak.over_subtrees(tour, spark.createDataFrame([(x,) for x in nodes], "node long"), {"n": ("sum", F.lit(1))}).collect()}
    for r in tour.where("before is null").collect():
        assert sums[r.node] == sum(base[x] == base[r.node] for x in nodes)


def test_no_edges(spark):
    empty = spark.createDataFrame([], "a long, b long")
    pairs, tour = weak.structure(empty)
    assert weak.bridges(pairs, tour).count() == weak.articulations(pairs, tour).count() == 0
    g = el.eliminate(spark.createDataFrame([(1, 1, 1.0)], "u long, v long, w double"))
    assert strong.strong_components(g).count() == 0


@pytest.mark.parametrize("rng,n,m", [(random.Random(k), n, m) for k, (n, m) in enumerate([(8, 16), (70, 110)])])
def test_breaking_closures(spark, rng, n, m):
    arcs = [(i, (i + 1) % n, 1) for i in range(n)] + random_arcs(rng, n, m - n) + [(100 + i, 100 + (i + 1) % 5, 1) for i in range(5)] + [(104, 103, 1), (300, 301, 1)]
    arcs += [(a, b, 1) for a, b in [(7, 3), (3, 7)]]
    table = arcs_of(spark, arcs)
    g = el.eliminate(table)
    scc = components([a for a in arcs if a[0] != a[1]])
    core = [(0, x) for x in range(n)] + [(1, 100 + x) for x in range(5)]
    assert len({scc[x] for _, x in core}) == 2
    inside = {x: k for k, x in core}
    pairs = {tuple(sorted(a[:2])) for a in arcs if a[0] != a[1] and a[0] in inside and a[1] in inside}
    closures = [(inside[a], a, b) for a, b in pairs] + [(k, x, x) for k, x in core]

    def broken(group, lo, hi):
        left = [a for a in arcs if (tuple(sorted(a[:2])) != (lo, hi) if lo != hi else lo not in a[:2])]
        rest = [x for k, x in core if k == group and (x != lo or lo != hi)]
        return any(y not in reach(left, rest[0]) for y in rest) or any(rest[0] not in reach(left, y) for y in rest)

    got = strong.breaking_closures(g, table, spark.createDataFrame(core, "group long, node long"), spark.createDataFrame(closures, "group long, lo long, hi long")).collect()
    assert {tuple(r) for r in got} == {c for c in closures if broken(*c)}


def test_single_cuts(spark):
    """A chain of two rings and a tail: bridges part sources from gates or not, whichever side is below."""
    ring = lambda x: [(x, x + 1), (x + 1, x + 2), (x + 2, x)]
    edges = [*ring(0), (2, 10), (10, 11), (11, 11), *ring(20), (11, 20), (21, 30), (2, 40)]
    sources, gates = {"a": {0, 1}, "b": {30}, "c": {0, 40}, "d": {20}}, {22, 30}
    nodes = sorted({x for e in edges for x in e})
    flags = [(x, x in gates, *[x in s for s in sources.values()]) for x in nodes]
    pairs, tour = weak.structure(spark.createDataFrame(edges, "a long, b long"))
    table = spark.createDataFrame(flags, "node long, gate boolean, a boolean, b boolean, c boolean, d boolean").join(tour.select("node", "top"), "node")
    got = {tuple(r) for r in weak.single_cuts(pairs, tour, table, {k: F.col(k) for k in sources}).collect()}
    want = set()
    for k, own in sources.items():
        for lo, hi in {tuple(sorted(e)) for e in edges if e[0] != e[1]}:
            label = together(nodes, [e for e in edges if tuple(sorted(e)) != (lo, hi)])
            side = {x for x in nodes if label[x] in {label[s] for s in own}}
            if not side & gates:
                want.add((k, lo, hi, len(side), len(nodes)))
    assert want and got == want


def test_single_cuts_join_bridges_once(spark):
    """More picks are more columns of one join of the bridges, not another join each."""
    pairs, tour = weak.structure(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    nodes = tour.select("node", "top", (F.col("node") == 0).alias("gate"))

    def joins(n):
        found = weak.single_cuts(pairs, tour, nodes, {str(k): F.col("node") == 2 for k in range(n)})
        assert {tuple(r) for r in found.collect()} == {(str(k), lo, lo + 1, 2 - lo, 3) for k in range(n) for lo in (0, 1)}
        return found._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert joins(8) == joins(1)
