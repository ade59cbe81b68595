"""Per-area analyses over scenario rows: weak points, centrality, flows, rings, samples and closures.

Each function takes the table of area graphs (``scenarios.graph_rows``) and
returns a DataFrame; the graph work inside a task is in ``functions.graphs``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wayloom.functions import graphs as gr
from wayloom.functions.graphs import CORE, GATEWAY, GIANT, AreaGraph
from wayloom.operators.scenarios import per_area, per_scenario
from wayloom.session import find_package

INF = float("inf")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a running ``scenario`` number an area."""
    return rows.withColumn("scenario", F.row_number().over(Window.partitionBy("area_id").orderBy(*order)) - 1)


def params(graph: DataFrame, values: Iterable[tuple], schema: str) -> DataFrame:
    """Every area with every row of a small table of parameters."""
    values = list(values)
    table = graph.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(values)], f"scenario int, {schema}")
    return graph.select("area_id").distinct().join(F.broadcast(table))


def _pair(g: AreaGraph, p: tuple[int, int]) -> tuple[int, int]:
    return int(g.ids[p[0]]), int(g.ids[p[1]])


# --- weak points


def weak_points(graph: DataFrame) -> DataFrame:
    """``what`` (bridge or articulation), ``lo``, ``hi``; an articulation has its node twice."""

    def run(g: AreaGraph):
        bridges, cuts = gr.bridges_and_articulations(g.n, list(zip(g.su, g.sv)))
        yield from (("bridge", *_pair(g, p)) for p in sorted(bridges))
        yield from (("articulation", *_pair(g, (u, u))) for u in sorted(cuts))

    return per_area(graph, run, "what string, lo long, hi long")


def _strong(g: AreaGraph, pairs: list[tuple[int, int]]) -> list[bool]:
    """Which closures (a pair, or a node twice) break the strong core: some core node is not reached from, or doesn't reach, a fixed one."""
    core = g.flagged(CORE)
    if not core:
        return [False] * len(pairs)
    closed: dict[tuple[int, int], int] = {}
    shut: dict[int, int] = {}
    for i, (a, b) in enumerate(pairs):
        if a == b:
            shut[a] = shut.get(a, 0) | 1 << i
        else:
            closed[a, b] = closed.get((a, b), 0) | 1 << i
    every = (1 << len(pairs)) - 1
    fixed = core[0]
    ok = every
    other = shut.get(fixed, 0)  # where the fixed node itself is gone, the next one stands in
    for seed, wanted in ((fixed, every & ~other), (core[1] if len(core) > 1 else fixed, other)):
        if not wanted:
            continue
        arcs = list(zip(g.au, g.av))
        ahead = gr.reach(g.n, arcs, [seed], closed, shut, len(pairs))
        back = gr.reach(g.n, [(v, u) for u, v in arcs], [seed], closed, shut, len(pairs))
        good = every
        for v in core:
            good &= (ahead[v] & back[v]) | shut.get(v, 0)
        ok &= good | ~wanted
    return [not (ok >> i) & 1 for i in range(len(pairs))]


def strong_candidates(graph: DataFrame) -> DataFrame:
    """Pairs of streets and nodes of the strong cores, numbered: ``lo, hi``."""
    core = graph.where(f"kind = {gr.NODE} and flags & {CORE} > 0").select("area_id", F.col("u").alias("n"))
    street = graph.where(f"kind = {gr.STREET} and u <> v").select("area_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
    pairs = street.join(core.withColumnRenamed("n", "lo"), ["area_id", "lo"], "left_semi").join(core.withColumnRenamed("n", "hi"), ["area_id", "hi"], "left_semi")
    return numbered(pairs.select("area_id", "lo", "hi").union(core.select("area_id", F.col("n").alias("lo"), F.col("n").alias("hi"))), "lo", "hi")


def strong_points(graph: DataFrame) -> DataFrame:
    """Strong bridges and strong articulations, as ``weak_points``; one row a closure, many closures at once as bits."""

    def run(g: AreaGraph, some: pd.DataFrame):
        pairs = [(g.at[a], g.at[b]) for a, b in zip(some.lo, some.hi)]
        for (a, b), broken in zip(pairs, _strong(g, pairs)):
            yield ("bridge" if a != b else "articulation", *_pair(g, (a, b)), broken)

    return per_scenario(graph, strong_candidates(graph), run, "what string, lo long, hi long, broken boolean", chunk=512).where("broken").drop("broken")


def _seeds(g: AreaGraph, frac: float) -> tuple[set[int], set[int], list[int]]:
    keep, gates = set(g.flagged(GIANT)), set(g.flagged(GATEWAY))
    dist = gr.hops(g.around(keep), sorted(gates))
    return keep, gates, gr.source_region(keep, gates, dist, frac) if gates else []


def single_cuts(graph: DataFrame, fracs: tuple[float, ...] = (0.2,)) -> DataFrame:
    """Streets that alone part the source region from all gateways, with the source side's size."""

    def run(g: AreaGraph, some: pd.DataFrame):
        for frac in some.frac:
            keep, gates, source = _seeds(g, frac)
            if not source:
                continue
            edges = [(u, v) for u, v in zip(g.su, g.sv) if u in keep and v in keep and u != v]
            many = Counter((min(e), max(e)) for e in edges)
            alone = sorted(p for p, k in many.items() if k == 1)
            closed = {p: 1 << i for i, p in enumerate(alone)}
            got = gr.reach(g.n, edges + [(v, u) for u, v in edges], source, closed, None, len(alone))
            meets = 0
            for v in gates:
                meets |= got[v]
            for i, p in enumerate(alone):
                if not meets >> i & 1:
                    side = sum(got[v] >> i & 1 for v in keep)
                    yield (float(frac), *_pair(g, p), side, round(100 * side / len(keep), 1), len(source))

    return per_scenario(graph, params(graph, [(f,) for f in fracs], "frac double"), run, "frac double, lo long, hi long, side long, side_pct double, n_source long")


# --- centrality


def betweenness(graph: DataFrame, flag: int = CORE, chunk: int = 64) -> tuple[DataFrame, DataFrame]:
    """Node and arc betweenness inside the flagged nodes: sources are spread over tasks, their sums are added."""
    sources = numbered(graph.where(f"kind = {gr.NODE} and flags & {flag} > 0").select("area_id", F.col("u").alias("node")), "node")

    def run(g: AreaGraph, some: pd.DataFrame):
        by_node, by_arc = gr.betweenness(g.out(set(g.flagged(flag))), [g.at[x] for x in some.node])
        yield from ((int(g.ids[u]), None, s) for u, s in by_node.items())
        yield from ((*_pair(g, a), s) for a, s in by_arc.items())

    part = per_scenario(graph, sources, run, "u long, v long, s double", chunk)
    size = sources.groupBy("area_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    zero = sources.select("area_id", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(0.0).alias("s"))
    total = part.union(zero).groupBy("area_id", "u", "v").agg(F.sum("s").alias("s")).join(size, "area_id")
    per_node = total.where("v is null").select("area_id", F.col("u").alias("node_id"), F.when(n > 2, F.col("s") / ((n - 1) * (n - 2))).otherwise(F.col("s")).alias("score"), "n")
    return per_node, total.where("v is not null").select("area_id", "u", "v", F.when(n > 1, F.col("s") / (n * (n - 1))).otherwise(F.col("s")).alias("score"))


def plain_betweenness_max(graph: DataFrame, flag: int = CORE) -> DataFrame:
    """Largest unweighted undirected betweenness of the flagged nodes."""

    def run(g: AreaGraph):
        keep = set(g.flagged(flag))
        yield (_plain_max([[(v, 1.0) for v in a] for a in g.around(keep)], sorted(keep)),)

    return per_area(graph, run, "score double")


def _plain_max(out: list[list[tuple[int, float]]], nodes: list[int]) -> float:
    n = len(nodes)
    by_node, _ = gr.betweenness(out, nodes)
    return max(by_node.values(), default=0.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0


# --- flows


def access(graph: DataFrame, fracs: tuple[float, ...] = (0.2,)) -> DataFrame:
    """Access flow from the source region to the gateways, for each fraction."""

    def run(g: AreaGraph, some: pd.DataFrame):
        for frac in some.frac:
            r = gr.access_flow(g, set(g.flagged(GIANT)), set(g.flagged(GATEWAY)), frac)
            yield float(frac), r["flow"], len(r["cut"]), len(r["source"]), len(r["gates"]), r["side"], r["capacity"]

    return per_scenario(graph, params(graph, [(f,) for f in fracs], "frac double"), run, "frac double, flow long, cut_size long, n_source long, n_gateways long, side long, cut_capacity long")


def source_regions(graph: DataFrame, frac: float = 0.2) -> DataFrame:
    """``node_id, dist`` of each area's source region."""

    def run(g: AreaGraph):
        keep, gates, source = _seeds(g, frac)
        dist = gr.hops(g.around(keep), sorted(gates))
        return ((int(g.ids[u]), dist.get(u, 0)) for u in source)

    return per_area(graph, run, "node_id long, dist int")


def access_cut(graph: DataFrame, frac: float = 0.2) -> DataFrame:
    """The streets of each area's minimum cut nearest the source: ``u`` on the source side."""

    def run(g: AreaGraph):
        r = gr.access_flow(g, set(g.flagged(GIANT)), set(g.flagged(GATEWAY)), frac)
        return (_pair(g, p) for p in r["cut"])

    return per_area(graph, run, "u long, v long")


def region_flow(graph: DataFrame, frac: float = 0.2) -> DataFrame:
    """Flow along the longest axis of the strong core: between the nodes nearest two far poles."""

    def run(g: AreaGraph):
        keep = set(g.flagged(CORE))
        if len(keep) < 2:
            return
        adj, nodes = g.around(keep), sorted(keep)
        far = lambda d: min(d, key=lambda u: (-d[u], u))
        one = far(gr.hops(adj, [nodes[0]]))
        d1 = gr.hops(adj, [one])
        two = far(d1)
        d2 = gr.hops(adj, [two])
        k = max(1, gr.banker(frac * len(nodes)))
        near = lambda d: sorted(nodes, key=lambda u: (d.get(u, 1 << 30), u))
        src = near(d1)[:k]
        snk = [u for u in near(d2) if u not in set(src)][:k]
        f = gr.street_flow(g, keep, False)
        value = f.run(src, snk)
        yield int(g.ids[one]), int(g.ids[two]), value, len(f.cut()), len(src), len(snk)

    return per_area(graph, run, "pole1 long, pole2 long, flow long, cut_size long, n_source long, n_sink long")


MODES = (("streets", False), ("streets", True), ("intersections", False), ("intersections", True))


def _value(g: AreaGraph, keep: set[int], src, dst, unit: str, directed: bool) -> tuple[int, gr.Flow]:
    if unit == "streets":
        f = gr.street_flow(g, keep, directed)
        return f.run(src, dst), f
    f = gr.crossing_flow(g, keep, set(src) | set(dst), directed)
    return f.run([2 * u for u in src], [2 * v + 1 for v in dst]), f


def four_counts(graph: DataFrame, frac: float = 0.2) -> DataFrame:
    """Routes counted by streets and by intersections, undirected and directed, with the sizes of their cuts."""

    def run(g: AreaGraph, some: pd.DataFrame):
        keep, gates, source = _seeds(g, frac)
        for unit, directed in zip(some.unit, some.directed):
            value, f = _value(g, keep, source, sorted(gates), unit, directed) if source else (0, None)
            cut = len(f.cut()) if f else 0
            yield unit, bool(directed), value, cut, (f.cut_capacity() if f else 0)

    return per_scenario(graph, params(graph, MODES, "unit string, directed boolean"), run, "unit string, directed boolean, flow long, cut_size long, cut_capacity long")


def tie_orders(graph: DataFrame, draws: int, frac: float = 0.2, seed: int = 7) -> DataFrame:
    """The four counts under shuffled orders of ties in the source region, and the region's digest."""

    def run(g: AreaGraph, some: pd.DataFrame):
        keep, gates = set(g.flagged(GIANT)), set(g.flagged(GATEWAY))
        if not gates:
            return
        dist = gr.hops(g.around(keep), sorted(gates))
        for draw in some.draw:
            src = gr.source_region(keep, gates, dist, frac, lambda u: gr.draw_key(seed, draw, int(g.ids[u])))
            region = gr.draw_key(*sorted(int(g.ids[u]) for u in src))
            for unit, directed in MODES:
                yield int(draw), unit, directed, _value(g, keep, src, sorted(gates), unit, directed)[0], region

    return per_scenario(graph, params(graph, [(i,) for i in range(draws)], "draw int"), run, "draw int, unit string, directed boolean, flow long, region string", chunk=16)


def tie_counts(graph: DataFrame, frac: float = 0.2) -> DataFrame:
    """How many candidates tie at the source region's last distance, and how many places are left for them."""

    def run(g: AreaGraph):
        keep, gates, src = _seeds(g, frac)
        if not src:
            return
        dist = gr.hops(g.around(keep), sorted(gates))
        last = dist.get(src[-1], 0)
        inner = [dist.get(u, 0) for u in keep - gates]
        above = sum(d > last for d in inner)
        yield len(src), last, sum(d == last for d in inner), above, len(src) - above

    return per_area(graph, run, "k long, last_dist int, tied long, above long, places long")


def undirected_cuts(graph: DataFrame) -> DataFrame:
    """Minimum cut of every unordered pair of the giant component, counted by value and by whether an end has one street."""

    def run(g: AreaGraph):
        nodes = g.flagged(GIANT)
        keep = set(nodes)
        edges = [(u, v) for u, v in zip(g.su, g.sv) if u in keep and v in keep]
        deg = Counter(u for e in edges for u in e)
        tally = Counter((c, min(deg[u], deg[v]) == 1) for (u, v), c in gr.all_cuts(g.n, nodes, edges).items())
        yield from ((c, lim, k) for (c, lim), k in sorted(tally.items()))

    return per_area(graph, run, "cut int, end_of_one boolean, pairs long")


def directed_cuts(graph: DataFrame) -> DataFrame:
    """The same for every ordered pair of the strong core; sources are spread over tasks."""
    sources = numbered(graph.where(f"kind = {gr.NODE} and flags & {CORE} > 0").select("area_id", F.col("u").alias("node")), "node")

    def run(g: AreaGraph, some: pd.DataFrame):
        nodes = g.flagged(CORE)
        keep = set(nodes)
        f = gr.street_flow(g, keep, True)
        size = list(f.cap)
        outs, ins = Counter(), Counter()
        for u, v in zip(g.au, g.av):
            if u in keep and v in keep:
                outs[u] += 1
                ins[v] += 1
        tally: Counter = Counter()
        for s in (g.at[x] for x in some.node):
            for t in nodes:
                if s != t:
                    most = min(outs[s], ins[t])
                    tally[1 if most == 1 else gr.pair_cut(f, size, s, t, most), most == 1] += 1
        yield from ((c, lim, k) for (c, lim), k in sorted(tally.items()))

    part = per_scenario(graph, sources, run, "cut int, end_of_one boolean, pairs long", chunk=16)
    return part.groupBy("area_id", "cut", "end_of_one").agg(F.sum("pairs").alias("pairs"))


def cut_summary(tally: DataFrame) -> DataFrame:
    """Shares, mean and range of a tally of cuts."""
    n, one = F.sum("pairs"), F.sum(F.when(F.col("cut") == 1, F.col("pairs")).otherwise(0))
    lim = F.sum(F.when(F.col("end_of_one"), F.col("pairs")).otherwise(0))
    both = F.sum(F.when((F.col("cut") == 1) & F.col("end_of_one"), F.col("pairs")).otherwise(0))
    return tally.groupBy("area_id").agg(
        n.alias("n_pairs"), F.round(100 * one / n, 1).alias("cut_1_pct"), F.round(F.sum(F.col("cut") * F.col("pairs")) / n, 2).alias("mean_cut"), F.min("cut").alias("min_cut"), F.max("cut").alias("max_cut"),
        F.round(100 * lim / n, 1).alias("end_of_one_pct"), F.coalesce(F.round(100 * both / F.nullif(one, F.lit(0)), 1), F.lit(0.0)).alias("explained_pct"),
    )


# --- origins, destinations and routes


def od_pairs(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rule, o, d`` for each area: extreme x + y among well-joined core nodes, extreme x in a window of y, double sweep."""
    core = graph.where(f"kind = {gr.NODE} and flags & {CORE} > 0").select("area_id", F.col("u").alias("node_id"))
    deg = graph.where(f"kind = {gr.STREET}").select("area_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("area_id", "node_id").agg(F.count("*").alias("degree"))
    at = core.join(deg, ["area_id", "node_id"]).join(nodes.select("area_id", "node_id", "x", "y"), ["area_id", "node_id"])

    def extreme(rows: DataFrame, score, rule: str) -> DataFrame:
        top, low = F.min_by("node_id", F.struct(-score, "node_id")), F.min_by("node_id", F.struct(score, "node_id"))
        return rows.groupBy("area_id").agg(F.lit(rule).alias("rule"), top.alias("o"), low.alias("d"))

    middle = at.join(at.groupBy("area_id").agg(F.avg("y").alias("mid")), "area_id").where("y > mid")
    found = extreme(at.where("degree >= 3"), F.col("x") + F.col("y"), "corner").union(extreme(middle, F.col("x"), "window"))

    def sweep(g: AreaGraph):
        keep = g.flagged(CORE)
        if keep:
            far = lambda d: min((u for u in keep), key=lambda u: (-d.get(u, -1.0), u))
            b = far(gr.times(g.out(), keep[0])[0])
            yield "sweep", int(g.ids[b]), int(g.ids[far(gr.times(g.out(), b)[0])])

    return found.union(per_area(graph, sweep, "rule string, o long, d long"))


def routes(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least-time route of each pair, and the alternative when a street near its middle, no bridge, is closed."""

    def run(g: AreaGraph, some: pd.DataFrame):
        bridges, _ = gr.bridges_and_articulations(g.n, list(zip(g.su, g.sv)))
        out = g.out()
        for rule, o, d in zip(some.rule, some.o, some.d):
            if o not in g.at or d not in g.at:
                continue
            a, b = g.at[o], g.at[d]
            dist, prev = gr.times(out, a)
            path = gr.route(prev, a, b)
            legs = [(min(x), max(x)) for x in zip(path, path[1:])]
            order = sorted(range(len(legs)), key=lambda i: abs(i - len(legs) / 2))
            closed = next((legs[i] for i in order if legs[i] not in bridges), None)
            other, back = gr.times(out, a, {closed} if closed else set())
            alt = gr.route(back, a, b)
            cost, new = dist.get(b), other.get(b)
            extra = round(100 * (new - cost) / cost, 1) if new is not None and cost else None
            yield (
                rule, int(o), int(d), cost, [int(g.ids[u]) for u in path], *(_pair(g, closed) if closed else (None, None)), new,
                [int(g.ids[u]) for u in alt], extra, sum(x in bridges for x in legs),
            )

    return per_scenario(graph, numbered(pairs, "rule"), run, "rule string, o long, d long, time_s double, path array<long>, closed_lo long, closed_hi long, alt_time_s double, alt_path array<long>, extra_pct double, bridges long")


def od_cuts(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """Minimum cut by streets of one origin and destination."""

    def run(g: AreaGraph, some: pd.DataFrame):
        keep = set(range(g.n))
        for rule, o, d in zip(some.rule, some.o, some.d):
            if o in g.at and d in g.at and o != d:
                f = gr.street_flow(g, keep, False)
                value = f.run([g.at[o]], [g.at[d]])
                yield rule, int(o), int(d), value, [list(_pair(g, p)) for p in f.cut()]

    return per_scenario(graph, numbered(pairs, "rule"), run, "rule string, o long, d long, flow long, cut array<array<long>>")


def other_failures(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """Streets of the route, outside the reported cut, whose closure alone parts origin and destination."""

    def run(g: AreaGraph, some: pd.DataFrame):
        edges = [(u, v) for u, v in zip(g.su, g.sv) if u != v]
        both = edges + [(v, u) for u, v in edges]
        for rule, o, d in zip(some.rule, some.o, some.d):
            if o not in g.at or d not in g.at or o == d:
                continue
            a, b = g.at[o], g.at[d]
            f = gr.street_flow(g, set(range(g.n)), False)
            f.run([a], [b])
            cut = {(min(p), max(p)) for p in f.cut()}
            way = gr.route(gr.times(g.out(), a)[1], a, b)
            legs = [(min(x), max(x)) for x in zip(way, way[1:])]
            some_legs = sorted(set(legs) - cut)
            got = gr.reach(g.n, both, [a], {x: 1 << i for i, x in enumerate(some_legs)}, None, max(1, len(some_legs)))
            yield from ((rule, *_pair(g, x)) for i, x in enumerate(some_legs) if not got[b] >> i & 1)

    return per_scenario(graph, numbered(pairs, "rule"), run, "rule string, lo long, hi long")


def shortest_times(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """Times from each origin to every node."""

    def run(g: AreaGraph, some: pd.DataFrame):
        for rule, o in zip(some.rule, some.o):
            if o in g.at:
                yield from ((rule, int(o), int(g.ids[u]), t) for u, t in gr.times(g.out(), g.at[o])[0].items())

    return per_scenario(graph, numbered(pairs, "rule"), run, "rule string, o long, node_id long, time_s double")


def resilience(graph: DataFrame, strong: DataFrame) -> DataFrame:
    """Of each strong bridge and articulation: ordered core pairs that it parts, and what the detours of the others add (minutes)."""

    def run(g: AreaGraph, some: pd.DataFrame):
        core, out = g.flagged(CORE), g.out()
        goals = set(core)
        into: list[list[tuple[int, float]]] = [[] for _ in range(g.n)]
        for u, pairs in enumerate(out):
            for v, t in pairs:
                into[v].append((u, t))
        base, tree, kids = {}, {}, {}
        for s in core:
            base[s], tree[s] = gr.times(out, s)
            kids[s] = gr.below(tree[s])
        for what, lo, hi in zip(some.what, some.lo, some.hi):
            a, b = g.at[lo], g.at[hi]
            parted, extra = 0, []
            for s in core:
                old = base[s]
                if a == b:
                    parted += s != a and a in old
                    if a == s or a not in kids[s]:
                        continue  # leaving the closed node stays possible; no other least-time path goes through it
                    new = gr.retimed(out, into, old, kids[s], a, None, a)
                elif tree[s].get(b) == a:
                    new = gr.retimed(out, into, old, kids[s], b, (a, b), None)
                elif tree[s].get(a) == b:
                    new = gr.retimed(out, into, old, kids[s], a, (a, b), None)
                else:
                    continue  # the tree of least times doesn't use it
                for t, now in new.items():
                    if t in goals:
                        if now is None:
                            parted += 1
                        elif now > old[t] + 1e-9:
                            extra.append((now - old[t]) / 60)
            yield what, int(lo), int(hi), parted, len(extra), sorted(extra)

    return per_scenario(graph, numbered(strong, "what", "lo", "hi"), run, "what string, lo long, hi long, parted long, detours long, extra_min array<double>", chunk=48)


# --- rings


class Ring:
    """An area with what lies within a radius of it, as seen by its flows."""

    def __init__(self, g: AreaGraph, level: int, radius: float, dist: list[float]):
        self.g, self.dist = g, dist
        net = {u for u in range(g.n) if g.flags[u] <= level}
        self.net = net
        self.ring = {u for u in net if dist[u] <= radius}
        self.inner = {u for u in net if dist[u] == 0}
        arcs = [(u, v) for u, v in zip(g.au, g.av) if u in net and v in net]
        roads = [(u, v) for u, v in zip(g.su, g.sv) if u in net and v in net]
        scc = set(next(iter(gr.strong_components(g.n, arcs, sorted(net))), []))
        giant = set(next(iter(gr.components(g.n, roads, sorted(net))), []))
        leave = lambda pairs, good: {u for u, v in pairs if u in self.ring and v not in self.ring and dist[v] < INF and (good is None or v in good)}
        roads2 = roads + [(v, u) for u, v in roads]
        self.dest = {
            ("scc", True): leave(arcs, scc), ("any", True): leave(arcs, None), ("scc", False): leave(roads2, giant), ("any", False): leave(roads2, None),
        }
        self.arcs = [(u, v) for u, v in arcs if u in self.ring and v in self.ring and u != v]


def ring_of(g: AreaGraph, level: int, radii: tuple[int, ...], rows: pd.DataFrame | None = None) -> Ring:
    return Ring(g, level, radii[level], g.dist)


class RingGraph(AreaGraph):
    """An area graph whose nodes carry distances."""

    def __init__(self, rows: pd.DataFrame):
        super().__init__(rows)
        nodes = rows[rows.kind == gr.NODE].sort_values("u", kind="stable")
        self.dist = nodes["t"].to_numpy(float).tolist()


def per_ring(graph: DataFrame, scenarios: DataFrame, sources: DataFrame, fn, schema: str, chunk: int = 4) -> DataFrame:
    """As ``per_scenario`` for surroundings; ``sources`` (area_id, node_id) are marked by a negative key in the graph."""
    find_package(graph.sparkSession)
    mark = graph.join(sources.select("area_id", F.col("node_id").alias("u"), F.lit(-1).cast("long").alias("_m")), ["area_id", "u"], "left")
    mark = mark.select("area_id", "kind", "u", "v", "t", F.when(F.col("kind") == gr.NODE, F.col("_m")).otherwise(F.col("key")).alias("key"), "flags")
    cells = scenarios.withColumn("chunk", F.floor(F.col("scenario") / chunk))
    shipped = mark.join(cells.select("area_id", "chunk").distinct(), "area_id").withColumnsRenamed({"area_id": "g_area", "chunk": "g_chunk"})
    cols = ["area_id", *[c.split()[0] for c in schema.split(",")]]

    def run(key: tuple, rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(some):
            return pd.DataFrame([], columns=cols)
        g = RingGraph(rows)
        own = rows[(rows.kind == gr.NODE) & (rows.key == -1)].u
        src = sorted(g.at[int(x)] for x in own)
        return pd.DataFrame([(key[0], *r) for r in fn(g, src, some.sort_values("scenario", kind="stable"))], columns=cols)

    return shipped.groupBy("g_area", "g_chunk").cogroup(cells.groupBy("area_id", "chunk")).applyInPandas(run, f"area_id long, {schema}")


def ring_flows(graph: DataFrame, sources: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Flow from the source region to ring destinations, by radius, destination rule and way of counting."""
    modes = (("streets", True), ("streets", False), ("intersections", True))
    rows = [(i, radii[i], rule, unit, d) for i in range(len(radii)) for rule in ("scc", "any") for unit, d in modes]

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        rings: dict[int, Ring] = {}
        for level, radius, rule, unit, directed in zip(some.level, some.r_m, some.rule, some.unit, some.directed):
            ring = rings.setdefault(level, None) or Ring(g, level, radius, g.dist)
            rings[level] = ring
            dest = sorted(ring.dest[rule, bool(directed)])
            value = _value(g, ring.ring, src, dest, unit, directed)[0] if src and dest else 0
            yield int(radius), rule, unit, bool(directed), value, len(dest), len(ring.ring)

    return per_ring(graph, params(graph, rows, "level int, r_m int, rule string, unit string, directed boolean"), sources, run, "r_m int, dest_rule string, unit string, directed boolean, flow long, n_dest long, n_ring long", 6)


def _class(ring: Ring, p: tuple[int, int]) -> str:
    return ("external", "boundary", "internal")[(ring.dist[p[0]] == 0) + (ring.dist[p[1]] == 0)]


def ring_cuts(graph: DataFrame, sources: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Streets of the cuts nearest the source and nearest the destination: ``side, u, v, class``."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        for level, radius in zip(some.level, some.r_m):
            ring = Ring(g, level, radius, g.dist)
            dest = sorted(ring.dest["scc", True])
            if not src or not dest:
                continue
            f = gr.street_flow(g, ring.ring, True)
            f.run(src, dest)
            yield from ((int(radius), "source", *_pair(g, p), _class(ring, p)) for p in f.cut())
            b = gr.street_flow(g, ring.ring, True, backward=True)
            b.run(dest, src)
            yield from ((int(radius), "destination", *_pair(g, (v, u)), _class(ring, (u, v))) for u, v in b.cut())

    return per_ring(graph, params(graph, enumerate(radii), "level int, r_m int"), sources, run, "r_m int, side string, u long, v long, class string", 1)


def _critical(g: AreaGraph, ring: Ring, src: list[int], dest: list[int]) -> dict[tuple[int, int], int]:
    """Pairs whose closure lowers the directed flow, and by how much; only pairs that carry flow can."""
    if not src or not dest:
        return {}
    f = gr.street_flow(g, ring.ring, True)
    value = f.run(src, dest)
    out = {}
    for p in sorted({(min(a), max(a)) for a in f.carried()}):
        less = value - gr.street_flow(g, ring.ring, True, drop=p).run(src, dest)
        if less > 0:
            out[p] = less
    return out


def critical_streets(graph: DataFrame, sources: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """``r_m, lo, hi, drop, class``."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        for level, radius in zip(some.level, some.r_m):
            ring = Ring(g, level, radius, g.dist)
            for p, less in _critical(g, ring, src, sorted(ring.dest["scc", True])).items():
                yield int(radius), *_pair(g, p), less, _class(ring, p)

    return per_ring(graph, params(graph, enumerate(radii), "level int, r_m int"), sources, run, "r_m int, lo long, hi long, drop long, class string", 1)


def _continuing(g: AreaGraph, ring: Ring) -> tuple[set[int], set[int]]:
    """Inner nodes with an arc out of the area, and those from which it leads on to an outer destination."""
    outer = {u for u in ring.ring if ring.dist[u] > 0}
    back = [(v, u) for u, v in ring.arcs if u in outer and v in outer]
    goals = ring.dest["scc", True] & outer
    on = gr.reach(g.n, back, goals)
    # of a net, arcs into the ring's outer part
    exits = [(u, v) for u, v in ring.arcs if ring.dist[u] == 0 and v in outer]
    return {u for u, _ in exits}, {u for u, v in exits if on[v]}


def continuation(graph: DataFrame, sources: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Gateways with an exit, those that continue, and the flow to all, to those, and to the outer edge."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        base = Ring(g, 0, 0, g.dist)
        flow = lambda keep, dest: gr.street_flow(g, keep, True).run(src, sorted(dest)) if src and dest else 0
        every = flow(base.ring, base.dest["any", True])
        for level, radius in zip(some.level, some.r_m):
            ring = Ring(g, level, radius, g.dist)
            exits, on = _continuing(g, ring)
            yield int(radius), len(exits), len(on), [int(g.ids[u]) for u in sorted(exits - on)], every, flow(ring.inner, on), flow(ring.ring, ring.dest["scc", True])

    rows = [(i, r) for i, r in enumerate(radii) if r]
    return per_ring(graph, params(graph, rows, "level int, r_m int"), sources, run, "r_m int, n_exits long, n_continuing long, dead array<long>, flow_all long, flow_continuing long, flow_edge long", 1)


# --- closures


class World:
    """The ring of a simulation: who reaches a destination while streets are closed."""

    def __init__(self, g: RingGraph, src: list[int], level: int, radius: int):
        self.g, self.ring = g, Ring(g, level, radius, g.dist)
        self.back = [(v, u) for u, v in self.ring.arcs]
        self.dest = sorted(self.ring.dest["scc", True])
        self.pool = sorted({(min(a), max(a)) for a in self.ring.arcs if g.dist[a[0]] == 0 and g.dist[a[1]] == 0})
        base = gr.reach(g.n, self.back, self.dest)
        self.src = [u for u in src if base[u]]
        self.inner = sorted(u for u in self.ring.inner if base[u])

    def losses(self, closures: list[Iterable[tuple[int, int]]]) -> list[tuple[float, float]]:
        """Lost shares of the source region and of the interior, for each set of closed pairs."""
        if not closures:
            return []
        closed: dict[tuple[int, int], int] = {}
        for i, pairs in enumerate(closures):
            for p in pairs:
                closed[p] = closed.get(p, 0) | 1 << i
        got = gr.reach(self.g.n, self.back, self.dest, closed, None, len(closures))
        share = lambda nodes, i: 1 - sum(got[u] >> i & 1 for u in nodes) / len(nodes) if nodes else 0.0
        return [(share(self.src, i), share(self.inner, i)) for i in range(len(closures))]


def pools(graph: DataFrame, sources: DataFrame, level: int, radius: int) -> DataFrame:
    """``lo, hi``: removable streets of each area's world."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        return (_pair(g, p) for p in World(g, src, level, radius).pool)

    return per_ring(graph, params(graph, [(0,)], "x int"), sources, run, "lo long, hi long")


def worlds(graph: DataFrame, sources: DataFrame, level: int, radius: int) -> DataFrame:
    """Sizes of each area's world: ring, destinations, pool, source and interior nodes that reach a destination."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        w = World(g, src, level, radius)
        yield len(w.ring.ring), len(w.dest), len(w.pool), len(src), len(w.src), len(w.ring.inner), len(w.inner)

    return per_ring(graph, params(graph, [(0,)], "x int"), sources, run, "n_ring long, n_dest long, n_pool long, n_source long, n_source_ok long, n_interior long, n_interior_ok long")


def closure_losses(graph: DataFrame, sources: DataFrame, closures: DataFrame, level: int, radius: int, chunk: int = 256) -> DataFrame:
    """``scenario, source_loss, interior_loss`` of each set ``(area_id, scenario, closed: array<struct<lo, hi>>)``."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        w = World(g, src, level, radius)
        sets = [[(g.at[p["lo"]], g.at[p["hi"]]) for p in c] for c in some.closed]
        for scenario, (a, b) in zip(some.scenario, w.losses(sets)):
            yield int(scenario), a, b

    return per_ring(graph, closures, sources, run, "scenario long, source_loss double, interior_loss double", chunk)


def greedy(graph: DataFrame, sources: DataFrame, level: int, radius: int, steps: int) -> DataFrame:
    """``step, lo, hi, source_loss, interior_loss``: each step closes the street that adds most; stops at full loss."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        w, closed = World(g, src, level, radius), []
        for step in range(1, steps + 1):
            rest = [p for p in w.pool if p not in closed]
            if not rest:
                return
            got = w.losses([[*closed, p] for p in rest])
            i = min(range(len(rest)), key=lambda j: (-got[j][0], -got[j][1], rest[j]))
            closed.append(rest[i])
            yield step, *_pair(g, rest[i]), *got[i]
            if got[i][0] >= 1:
                return

    return per_ring(graph, params(graph, [(0,)], "x int"), sources, run, "step int, lo long, hi long, source_loss double, interior_loss double")


def access_cut_streets(graph: DataFrame, sources: DataFrame) -> DataFrame:
    """``what, lo, hi``: streets of the directed access flow's cut, and internal streets critical to it."""

    def run(g: RingGraph, src: list[int], some: pd.DataFrame):
        ring = Ring(g, 0, 0, g.dist)
        dest = sorted(ring.dest["any", True])
        if not src or not dest:
            return
        f = gr.street_flow(g, ring.ring, True)
        f.run(src, dest)
        yield from (("cut", *_pair(g, p)) for p in sorted({(min(x), max(x)) for x in f.cut()}))
        yield from (("critical", *_pair(g, p)) for p in _critical(g, ring, src, dest) if _class(ring, p) == "internal")

    return per_ring(graph, params(graph, [(0,)], "x int"), sources, run, "what string, lo long, hi long")


# --- samples


def _piece(g: AreaGraph, adj: list[list[int]], nodes: list[int], how: str, size: int, seed: int, area: int, draw: int) -> list[int]:
    start = min(nodes, key=lambda u: gr.draw_key(seed, area, how, draw, int(g.ids[u])))
    if how == "ball":
        return gr.grow_ball(adj, start, size)
    return gr.grow_random(adj, start, size, lambda step, v: gr.draw_key(seed, area, draw, step, int(g.ids[v])))


def _piece_flow(g: AreaGraph, part: set[int], always: set[int], around: list[list[int]], frac: float = 0.2) -> tuple[int, int]:
    """Access flow of a piece; its gateways have a neighbour outside it on the full network."""
    gates = {u for u in part if u in always or any(v not in part for v in around[u])}
    r = gr.access_flow(g, part, gates, frac)
    return r["flow"], len(r["gates"])


def _outward(g: AreaGraph) -> set[int]:
    """Nodes with a street to outside the area."""
    return set(g.flagged(GATEWAY))


def pieces(graph: DataFrame, size: int, draws: int, seed: int = 7, measure: bool = True) -> DataFrame:
    """Connected pieces by ball and by random growth: their nodes, flow, gateways, strong core and its largest betweenness."""
    rows = [(how, i) for how in ("ball", "random") for i in range(draws)]

    def run(g: AreaGraph, some: pd.DataFrame):
        keep = set(g.flagged(GIANT))
        adj, nodes, out = g.around(keep), sorted(keep), _outward(g)
        area = int(some.area_id.iloc[0])
        for how, draw in zip(some.how, some.draw):
            part = set(_piece(g, adj, nodes, how, size, seed, area, int(draw)))
            flow, gates = _piece_flow(g, part, out, adj)
            core = gr.strong_components(g.n, [(u, v) for u, v in zip(g.au, g.av) if u in part and v in part], sorted(part))[0]
            by_node, _ = gr.betweenness(g.out(set(core)), core) if measure else ({}, {})
            m = len(core)
            top = max(by_node.values(), default=0.0) / ((m - 1) * (m - 2)) if m > 2 else 0.0
            yield how, int(draw), [int(g.ids[u]) for u in sorted(part)], flow, gates, m, top

    return per_scenario(graph, params(graph, rows, "how string, draw int"), run, "how string, draw int, piece array<long>, flow long, n_gateways long, core long, top double", chunk=16)


def matched_pieces(graph: DataFrame, target: int, tolerance: int, wanted: int, tries: int, seed: int = 7) -> DataFrame:
    """The first ``wanted`` pieces by draw whose strong core has about the target's size, of at most ``tries`` draws."""
    rows = [(how, i) for how in ("ball", "random") for i in range(tries)]

    def run(g: AreaGraph, some: pd.DataFrame):
        keep = set(g.flagged(GIANT))
        adj, nodes = g.around(keep), sorted(keep)
        area = int(some.area_id.iloc[0])
        for how, draw in zip(some.how, some.draw):
            size = target + int(gr.draw_key(seed, area, how, draw, "size"), 16) % (target + 1)
            part = set(_piece(g, adj, nodes, how, size, seed, area, int(draw)))
            core = gr.strong_components(g.n, [(u, v) for u, v in zip(g.au, g.av) if u in part and v in part], sorted(part))[0]
            m = len(core)
            if abs(m - target) <= tolerance:
                by_node, _ = gr.betweenness(g.out(set(core)), core)
                yield how, int(draw), m, max(by_node.values(), default=0.0) / ((m - 1) * (m - 2)) if m > 2 else 0.0

    found = per_scenario(graph, params(graph, rows, "how string, draw int"), run, "how string, draw int, core long, top double", chunk=16)
    by = Window.partitionBy("area_id", "how").orderBy("draw")
    return found.withColumn("nth", F.row_number().over(by)).where(f"nth <= {wanted}")


def hill_climb(graph: DataFrame, starts: DataFrame, steps: int, seed: int = 7) -> DataFrame:
    """From each start ``(area_id, scenario, piece)`` swap one node at a time while the flow doesn't rise."""

    def run(g: AreaGraph, some: pd.DataFrame):
        keep = set(g.flagged(GIANT))
        adj, out = g.around(keep), _outward(g)
        area = int(some.area_id.iloc[0])
        for scenario, piece in zip(some.scenario, some.piece):
            part = {g.at[int(x)] for x in piece}
            first, gates = _piece_flow(g, part, out, adj)
            flow = first
            for step in range(steps):
                if flow <= 1:
                    break
                rim = sorted({v for u in part for v in adj[u]} - part)
                if not rim:
                    break
                pick = lambda items, what: items[int(gr.draw_key(seed, area, scenario, step, what), 16) % len(items)]
                new = (part - {pick(sorted(part), "out")}) | {pick(rim, "in")}
                if not gr.is_connected(adj, new):
                    continue
                value, n = _piece_flow(g, new, out, adj)
                if value <= flow:
                    part, flow, gates = new, value, n
            yield int(scenario), first, flow, gates, len(part)

    return per_scenario(graph, starts, run, "scenario long, first_flow long, flow long, n_gateways long, n_nodes long", chunk=2)


def rewirings(graph: DataFrame, draws: int, swaps: int = 2, seed: int = 7) -> DataFrame:
    """Largest plain betweenness of degree-preserving, connected rewirings of each strong core."""

    def run(g: AreaGraph, some: pd.DataFrame):
        core = g.flagged(CORE)
        keep = set(core)
        pairs = g.pairs(keep)
        for draw in some.draw:
            edges, have = list(pairs), set(pairs)
            adj = [set(a) for a in g.around(keep)]
            for k in range(swaps * len(edges)):
                if len(edges) < 2:
                    break
                h = int(gr.draw_key(seed, draw, k), 16)
                i, j = h % len(edges), (h >> 40) % len(edges)
                (a, b), (c, d) = edges[i], edges[j]
                if h >> 100 & 1:
                    c, d = d, c
                one, two = (min(a, d), max(a, d)), (min(c, b), max(c, b))
                if len({a, b, c, d}) < 4 or one in have or two in have:
                    continue
                for x, y in ((a, b), (c, d)):
                    adj[x].discard(y)
                    adj[y].discard(x)
                for x, y in (one, two):
                    adj[x].add(y)
                    adj[y].add(x)
                if gr.is_connected([list(x) for x in adj], keep):
                    have -= {edges[i], edges[j]}
                    edges[i], edges[j] = one, two
                    have |= {one, two}
                else:
                    for x, y in (one, two):
                        adj[x].discard(y)
                        adj[y].discard(x)
                    for x, y in ((a, b), (c, d)):
                        adj[x].add(y)
                        adj[y].add(x)
            yield int(draw), _plain_max([[(v, 1.0) for v in sorted(x)] for x in adj], core)

    return per_scenario(graph, params(graph, [(i,) for i in range(draws)], "draw int"), run, "draw int, score double", chunk=1)


