"""Hand-made graphs with known answers, and brute force by removal and subsets."""

import itertools
import random

import pandas as pd
import pytest

from wayloom.functions import graphs as gr


def area(streets, one_way=(), flags=None, times=None):
    """An area graph from undirected streets; those in ``one_way`` have one arc."""
    nodes = sorted({u for s in streets for u in s[:2]})
    rows = [(gr.NODE, u, None, None, None, (flags or {}).get(u, gr.INSIDE | gr.GIANT | gr.CORE)) for u in nodes]
    for k, s in enumerate(streets):
        t = (times or {}).get(k, 1.0)
        rows.append((gr.STREET, s[0], s[1], 10.0, k, None))
        rows.append((gr.ARC, s[0], s[1], t, k, None))
        if k not in one_way:
            rows.append((gr.ARC, s[1], s[0], t, k, None))
    return gr.AreaGraph(pd.DataFrame(rows, columns=["kind", "u", "v", "t", "key", "flags"]))


def named(g, pairs):
    return {tuple(int(g.ids[x]) for x in p) for p in pairs}


def test_path():
    g = area([(1, 2), (2, 3), (3, 4)])
    bridges, cuts = gr.bridges_and_articulations(g.n, list(zip(g.su, g.sv)))
    assert named(g, bridges) == {(1, 2), (2, 3), (3, 4)}
    assert {int(g.ids[u]) for u in cuts} == {2, 3}
    by_node, _ = gr.betweenness(g.out(), range(g.n))
    assert by_node[g.at[2]] / ((4 - 1) * (4 - 2)) == pytest.approx(4 / 6)


def test_parallel_streets():
    g = area([(1, 2), (1, 2), (2, 3)])
    assert named(g, gr.bridges_and_articulations(g.n, list(zip(g.su, g.sv)))[0]) == {(2, 3)}
    f = gr.street_flow(g, {0, 1, 2}, False)
    assert f.run([g.at[1]], [g.at[2]]) == 2 and len(f.cut()) == 1 and f.cut_capacity() == 2


def test_one_way_cycle():
    from wayloom.operators.analysis import _strong

    g = area([(1, 2), (2, 3), (3, 4), (4, 1)], one_way={0, 1, 2, 3})
    assert len(gr.strong_components(g.n, zip(g.au, g.av))) == 1
    assert not gr.bridges_and_articulations(g.n, list(zip(g.su, g.sv)))[0]
    pairs = g.pairs() + [(u, u) for u in range(g.n)]
    assert _strong(g, pairs) == [True] * 8


def test_two_triangles():
    flags = {u: gr.INSIDE | gr.GIANT | (gr.GATEWAY if u == 6 else 0) for u in range(1, 7)}
    g = area([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)], flags=flags)
    bridges, cuts = gr.bridges_and_articulations(g.n, list(zip(g.su, g.sv)))
    assert named(g, bridges) == {(3, 4)} and {int(g.ids[u]) for u in cuts} == {3, 4}
    r = gr.access_flow(g, set(range(g.n)), {g.at[6]}, 0.2)
    assert r["flow"] == 1 and r["side"] == 3 and r["source"] == [g.at[1]] and named(g, r["cut"]) == {(3, 4)}


def test_equal_times_share():
    g = area([(1, 2), (2, 4), (1, 3), (3, 4)], one_way={0, 1, 2, 3})
    by_node, by_arc = gr.betweenness(g.out(), [g.at[1]])
    assert by_node[g.at[2]] == pytest.approx(0.5) and by_node[g.at[3]] == pytest.approx(0.5)
    assert by_arc[g.at[1], g.at[2]] == pytest.approx(1.5)


def test_bow_tie_counts():
    g = area([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)])
    keep, src, dst = set(range(5)), [g.at[1]], [g.at[5]]
    assert gr.street_flow(g, keep, False).run(src, dst) == 2
    f = gr.crossing_flow(g, keep, set(src) | set(dst), False)
    assert f.run([2 * u for u in src], [2 * v + 1 for v in dst]) == 1
    assert [int(g.ids[a // 2]) for a, b in f.cut()] == [3]


def _random(seed, n=9, m=14):
    rng = random.Random(seed)
    pairs = [tuple(rng.sample(range(n), 2)) for _ in range(m)]
    return area(pairs + [(i, i + 1) for i in range(n - 1)], one_way={k for k in range(m) if rng.random() < 0.4}, times={k: rng.random() + 0.1 for k in range(m + n)})


@pytest.mark.parametrize("seed", range(8))
def test_weak_points_by_removal(seed):
    g = _random(seed, m=4)
    edges = list(zip(g.su, g.sv))
    whole = len(gr.components(g.n, edges))
    bridges, cuts = gr.bridges_and_articulations(g.n, edges)
    for p in g.pairs():
        rest = list(edges)
        k = next(i for i, e in enumerate(rest) if (min(e), max(e)) == p)
        del rest[k]
        assert (len(gr.components(g.n, rest)) > whole) == (p in bridges)
    for u in range(g.n):
        rest = [e for e in edges if u not in e]
        assert (len(gr.components(g.n, rest, [v for v in range(g.n) if v != u])) > whole) == (u in cuts)


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_smallest_cut(seed):
    g = _random(seed, n=6, m=6)
    arcs = [(u, v) for u, v in zip(g.au, g.av) if u != v]
    for s, t in itertools.permutations(range(6), 2):
        f = gr.street_flow(g, set(range(6)), True)
        value = f.run([s], [t])
        rest = [x for x in range(6) if x not in (s, t)]
        best = min(sum(u in side and v not in side for u, v in arcs) for k in range(5) for c in itertools.combinations(rest, k) for side in [{s, *c}])
        assert value == best == f.cut_capacity()


@pytest.mark.parametrize("seed", range(6))
def test_cut_tree(seed):
    g = _random(seed, n=7, m=6)
    edges = list(zip(g.su, g.sv))
    got = gr.all_cuts(g.n, list(range(g.n)), edges)
    for s, t in itertools.combinations(range(g.n), 2):
        assert got[s, t] == gr.street_flow(g, set(range(g.n)), False).run([s], [t])


@pytest.mark.parametrize("seed", range(6))
def test_many_closures_at_once(seed):
    g = _random(seed)
    arcs, pairs = list(zip(g.au, g.av)), g.pairs()
    got = gr.reach(g.n, arcs, [0], {p: 1 << i for i, p in enumerate(pairs)}, None, len(pairs))
    for i, p in enumerate(pairs):
        alone = gr.reach(g.n, [a for a in arcs if (min(a), max(a)) != p], [0])
        assert [x >> i & 1 for x in got] == alone


def test_source_region_rounds_half_to_even():
    assert [gr.banker(x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert gr.source_region(range(5), {0}, {1: 3, 2: 3, 3: 1}, 0.5) == [1, 2]


def test_pieces_are_connected():
    g = _random(3)
    adj = g.around()
    for size in (1, 3, 6):
        assert gr.is_connected(adj, set(gr.grow_ball(adj, 0, size)))
        part = gr.grow_random(adj, 0, size, lambda step, v: gr.draw_key(step, v))
        assert len(part) == size and gr.is_connected(adj, set(part))


@pytest.mark.parametrize("seed", range(8))
def test_retimed_equals_starting_over(seed):
    g = _random(seed)
    out = g.out()
    into = [[] for _ in range(g.n)]
    for u, pairs in enumerate(out):
        for v, t in pairs:
            into[v].append((u, t))
    for s in range(g.n):
        dist, prev = gr.times(out, s)
        kids = gr.below(prev)
        for v, u in prev.items():
            pair = (min(u, v), max(u, v))
            again = gr.times(out, s, {pair})[0]
            for t, now in gr.retimed(out, into, dist, kids, v, pair, None).items():
                assert now == pytest.approx(again.get(t)) if now is not None else t not in again
            if v in kids:
                again = gr.times(out, s, set(), v)[0]
                for t, now in gr.retimed(out, into, dist, kids, v, None, v).items():
                    assert now == pytest.approx(again.get(t)) if now is not None else t not in again
