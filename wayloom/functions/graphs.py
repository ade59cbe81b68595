"""Graph work inside one area, on plain arrays; pure functions that tests can call without Spark.

An area has hundreds or thousands of nodes, a cluster thousands of areas times
scenarios: each task gets an area's graph once with a chunk of its scenarios.
Many closures are followed at once as bits of one integer a node.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd

BIG = 10**9
EPS = 1e-9
NODE, ARC, STREET = 0, 1, 2
#: Flags of nodes.
INSIDE, GATEWAY, GIANT, CORE = 1, 2, 4, 8


def draw_key(*parts: object) -> str:
    """The order in which a draw takes its items."""
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


class AreaGraph:
    """Nodes 0..n-1 by rising id; arcs with times; streets with their numbers."""

    def __init__(self, rows: pd.DataFrame):
        nodes = rows[rows.kind == NODE].sort_values("u", kind="stable")
        self.ids = nodes.u.to_numpy(np.int64)
        self.flags = nodes["flags"].to_numpy(np.int64)
        self.n = len(self.ids)
        self.at = {int(x): i for i, x in enumerate(self.ids)}
        arcs = rows[rows.kind == ARC].sort_values(["u", "v", "t", "key"], kind="stable")
        self.au, self.av = ([self.at[x] for x in arcs[c].tolist()] for c in ("u", "v"))
        self.t = arcs["t"].to_numpy(float).tolist()
        streets = rows[rows.kind == STREET].sort_values(["key", "u", "v"], kind="stable")
        self.su, self.sv = ([self.at[x] for x in streets[c].tolist()] for c in ("u", "v"))
        self.skey = streets.key.tolist()
        self.length = streets.t.tolist()

    def flagged(self, flag: int) -> list[int]:
        return np.nonzero(self.flags & flag)[0].tolist()

    def out(self, keep: set[int] | None = None) -> list[list[tuple[int, float]]]:
        """Least-time arcs to each neighbour, inside ``keep``."""
        best: list[dict[int, float]] = [{} for _ in range(self.n)]
        for u, v, t in zip(self.au, self.av, self.t):
            if u != v and (keep is None or (u in keep and v in keep)) and t < best[u].get(v, float("inf")):
                best[u][v] = t
        return [sorted(b.items()) for b in best]

    def pairs(self, keep: set[int] | None = None) -> list[tuple[int, int]]:
        """Unordered street pairs inside ``keep``, without repeats."""
        return sorted({(min(u, v), max(u, v)) for u, v in zip(self.su, self.sv) if keep is None or (u in keep and v in keep)})

    def around(self, keep: set[int] | None = None) -> list[list[int]]:
        """Neighbours by streets."""
        adj: list[set[int]] = [set() for _ in range(self.n)]
        for u, v in zip(self.su, self.sv):
            if u != v and (keep is None or (u in keep and v in keep)):
                adj[u].add(v)
                adj[v].add(u)
        return [sorted(a) for a in adj]


def components(n: int, edges: Iterable[tuple[int, int]], nodes: Iterable[int] | None = None) -> list[list[int]]:
    """Connected components, largest first, then by smallest node."""
    adj: list[list[int]] = [[] for _ in range(n)]
    for u, v in edges:
        adj[u].append(v)
        adj[v].append(u)
    seen, out = [False] * n, []
    for s in range(n) if nodes is None else nodes:
        if not seen[s]:
            seen[s], part = True, [s]
            for u in part:
                for v in adj[u]:
                    if not seen[v]:
                        seen[v] = True
                        part.append(v)
            out.append(sorted(part))
    return sorted(out, key=lambda p: (-len(p), p[0]))


def strong_components(n: int, arcs: Iterable[tuple[int, int]], nodes: Iterable[int] | None = None) -> list[list[int]]:
    """Strongly connected components, largest first, then by smallest node."""
    adj: list[list[int]] = [[] for _ in range(n)]
    for u, v in arcs:
        adj[u].append(v)
    number, low, on, stack, out, count = [0] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n) if nodes is None else nodes:
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        stack.append(root)
        on[root] = True
        work = [(root, iter(adj[root]))]
        while work:
            u, it = work[-1]
            for v in it:
                if not number[v]:
                    count += 1
                    number[v] = low[v] = count
                    stack.append(v)
                    on[v] = True
                    work.append((v, iter(adj[v])))
                    break
                if on[v]:
                    low[u] = min(low[u], number[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == number[u]:
                    part = []
                    while True:
                        v = stack.pop()
                        on[v] = False
                        part.append(v)
                        if v == u:
                            break
                    out.append(sorted(part))
    return sorted(out, key=lambda p: (-len(p), p[0]))


def bridges_and_articulations(n: int, edges: list[tuple[int, int]]) -> tuple[set[tuple[int, int]], set[int]]:
    """Bridges as pairs (parallels are none) and articulation points, by low links."""
    adj: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, (u, v) in enumerate(edges):
        if u != v:
            adj[u].append((v, i))
            adj[v].append((u, i))
    number, low = [0] * n, [0] * n
    bridges: set[tuple[int, int]] = set()
    cuts: set[int] = set()
    count = 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        branches, work = 0, [(root, -1, iter(adj[root]))]
        while work:
            u, via, it = work[-1]
            for v, i in it:
                if i == via:
                    continue
                if number[v]:
                    low[u] = min(low[u], number[v])
                else:
                    count += 1
                    number[v] = low[v] = count
                    work.append((v, i, iter(adj[v])))
                    break
            else:
                work.pop()
                if work:
                    p = work[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] > number[p]:
                        bridges.add((min(p, u), max(p, u)))
                    if p == root:
                        branches += 1
                    elif low[u] >= number[p]:
                        cuts.add(p)
        if branches > 1:
            cuts.add(root)
    return bridges, cuts


def reach(n: int, arcs: Iterable[tuple[int, int]], seeds: Iterable[int], closed: dict[tuple[int, int], int] | None = None, shut: dict[int, int] | None = None, scenarios: int = 1) -> list[int]:
    """For each node the scenarios, as bits, in which it is reached from the seeds.

    ``closed``: unordered pair to the scenarios in which both its directions are shut;
    ``shut``: node to the scenarios in which it can't be entered.
    """
    every = (1 << scenarios) - 1
    adj: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    closed, shut = closed or {}, shut or {}
    for u, v in arcs:
        if u != v:
            adj[u].append((v, every & ~closed.get((min(u, v), max(u, v)), 0) & ~shut.get(v, 0)))
    got = [0] * n
    queue, waiting = deque(), [False] * n
    for s in seeds:
        got[s] = every & ~shut.get(s, 0)
        if not waiting[s]:
            waiting[s] = True
            queue.append(s)
    while queue:
        u = queue.popleft()
        waiting[u] = False
        for v, open_ in adj[u]:
            more = got[u] & open_ & ~got[v]
            if more:
                got[v] |= more
                if not waiting[v]:
                    waiting[v] = True
                    queue.append(v)
    return got


def hops(adj: list[list[int]], seeds: Iterable[int]) -> dict[int, int]:
    """Edges to the nearest seed."""
    dist = dict.fromkeys(seeds, 0)
    queue = deque(dist)
    while queue:
        u = queue.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    return dist


def times(out: list[list[tuple[int, float]]], source: int, closed: frozenset | set = frozenset(), shut: int | None = None) -> tuple[dict[int, float], dict[int, int]]:
    """Least times from a node and the node before each; closed pairs both ways, ``shut`` can't be entered."""
    dist: dict[int, float] = {}
    prev: dict[int, int] = {}
    seen, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, t in out[u]:
            if v == shut or v in dist or (closed and (min(u, v), max(u, v)) in closed):
                continue
            if d + t < seen.get(v, float("inf")):
                seen[v] = d + t
                prev[v] = u
                heapq.heappush(heap, (d + t, v))
    return dist, prev


def below(prev: dict[int, int]) -> dict[int, list[int]]:
    """Children in a tree of least times."""
    kids: dict[int, list[int]] = {}
    for v, u in prev.items():
        kids.setdefault(u, []).append(v)
    return kids


def retimed(out: list[list[tuple[int, float]]], into: list[list[tuple[int, float]]], dist: dict[int, float], kids: dict[int, list[int]], top: int, closed: tuple[int, int] | None, shut: int | None) -> dict[int, float | None]:
    """New least times of what hangs below ``top`` in the tree, after a closure; None where there is no way left.

    Other nodes keep their times, so only the cut-off part is worked out again, from its rim.
    """
    part = [top] if shut != top else list(kids.get(top, ()))
    for u in part:
        part += kids.get(u, ())
    members = set(part)
    if shut is not None:
        members.discard(shut)
    shuts = lambda u, v: u == shut or v == shut or (closed is not None and (min(u, v), max(u, v)) == closed)
    seen: dict[int, float] = {}
    for v in members:
        for u, t in into[v]:
            if u not in members and u in dist and not shuts(u, v):
                seen[v] = min(seen.get(v, float("inf")), dist[u] + t)
    heap = [(d, v) for v, d in seen.items()]
    heapq.heapify(heap)
    new: dict[int, float | None] = {}
    while heap:
        d, u = heapq.heappop(heap)
        if u in new:
            continue
        new[u] = d
        for v, t in out[u]:
            if v in members and v not in new and not shuts(u, v) and d + t < seen.get(v, float("inf")):
                seen[v] = d + t
                heapq.heappush(heap, (d + t, v))
    return {v: new.get(v) for v in members}


def route(prev: dict[int, int], source: int, target: int) -> list[int]:
    """Nodes from source to target; empty where there is no way."""
    path = [target]
    while path[-1] != source:
        if path[-1] not in prev:
            return []
        path.append(prev[path[-1]])
    return path[::-1]


def betweenness(out: list[list[tuple[int, float]]], sources: Iterable[int]) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    """Sums over the sources of the shares of least-time paths through nodes and arcs; ties within 1e-9 share."""
    by_node: dict[int, float] = {}
    by_arc: dict[tuple[int, int], float] = {}
    for s in sources:
        order, before, ways, dist, seen, heap = [], {s: []}, {s: 1.0}, {}, {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in dist:
                continue
            dist[u] = d
            order.append(u)
            for v, t in out[u]:
                if v in dist:
                    continue
                nd, best = d + t, seen.get(v)
                if best is None or nd < best - EPS:
                    seen[v], ways[v], before[v] = nd, ways[u], [u]
                    heapq.heappush(heap, (nd, v))
                elif abs(nd - best) <= EPS:
                    ways[v] += ways[u]
                    before[v].append(u)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                c = ways[u] / ways[v] * (1 + share[v])
                share[u] += c
                by_arc[u, v] = by_arc.get((u, v), 0.0) + c
            if v != s:
                by_node[v] = by_node.get(v, 0.0) + share[v]
    return by_node, by_arc


class Flow:
    """Max flow between node sets by augmenting paths; capacities add over parallels."""

    def __init__(self, n: int):
        self.n = n
        self.adj: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.slot: dict[tuple[int, int], int] = {}

    def add(self, u: int, v: int, c: int) -> None:
        k = self.slot.get((u, v))
        if k is None:
            self.slot[u, v] = k = len(self.to)
            self.slot[v, u] = k + 1
            self.to += [v, u]
            self.cap += [0, 0]
            self.adj[u].append(k)
            self.adj[v].append(k + 1)
        self.cap[k] += c

    def run(self, sources: Iterable[int], sinks: Iterable[int], most: int | None = None) -> int:
        """The value; afterwards ``side`` is what the residual reaches from the sources."""
        s, t = self.n, self.n + 1
        self.s, self.t = s, t
        for u in sources:
            self.add(s, u, BIG)
        for v in sinks:
            self.add(v, t, BIG)
        self.start = list(self.cap)
        value, adj, to, cap = 0, self.adj, self.to, self.cap
        while most is None or value < most:
            via = {s: -1}
            queue = deque((s,))
            while queue and t not in via:
                u = queue.popleft()
                for k in adj[u]:
                    v = to[k]
                    if cap[k] > 0 and v not in via:
                        via[v] = k
                        queue.append(v)
            if t not in via:
                break
            least, v = BIG, t
            while v != s:
                least = min(least, cap[via[v]])
                v = to[via[v] ^ 1]
            v = t
            while v != s:
                cap[via[v]] -= least
                cap[via[v] ^ 1] += least
                v = to[via[v] ^ 1]
            value += least
        self.side = set(via) if most is None or value < most else None
        return value

    def reset(self) -> None:
        self.cap[:] = self.start

    def cut(self) -> list[tuple[int, int]]:
        """Arcs that leave the source side, super arcs left out."""
        return sorted(
            (u, v) for (u, v), k in self.slot.items()
            if self.start[k] > 0 and u < self.n and v < self.n and u in self.side and v not in self.side
        )

    def cut_capacity(self) -> int:
        return sum(self.start[k] for (u, v), k in self.slot.items() if u in self.side and v not in self.side)

    def carried(self) -> dict[tuple[int, int], int]:
        """Net flow of arcs between real nodes."""
        return {(u, v): self.start[k] - self.cap[k] for (u, v), k in self.slot.items() if u < self.n and v < self.n and self.start[k] - self.cap[k] > 0}


def street_flow(g: AreaGraph, keep: set[int], directed: bool, drop: tuple[int, int] | None = None, backward: bool = False) -> Flow:
    """One unit a street both ways, or one an arc."""
    f = Flow(g.n)
    for u, v in zip(g.au, g.av) if directed else zip(g.su, g.sv):
        if u in keep and v in keep and u != v and (drop is None or (min(u, v), max(u, v)) != drop):
            if backward:
                u, v = v, u
            f.add(u, v, 1)
            if not directed:
                f.add(v, u, 1)
    return f


def crossing_flow(g: AreaGraph, keep: set[int], free: set[int], directed: bool) -> Flow:
    """One unit a node, but for the free ones; node v is entered at 2v and left at 2v+1."""
    f = Flow(2 * g.n)
    for v in keep:
        f.add(2 * v, 2 * v + 1, BIG if v in free else 1)
    done = set()
    for u, v in zip(g.au, g.av) if directed else zip(g.su, g.sv):
        for a, b in ((u, v),) if directed else ((u, v), (v, u)):
            if u in keep and v in keep and u != v and (a, b) not in done:
                done.add((a, b))
                f.add(2 * a + 1, 2 * b, BIG)
    return f


def banker(x: float) -> int:
    """Rounded half to even, as Spark's bround."""
    return int(round(x))


def source_region(nodes: Iterable[int], gates: set[int], dist: dict[int, int], frac: float, order=None) -> list[int]:
    """The nodes farthest from the gateways, a fraction of all; ties by ``order``, else by node."""
    nodes = list(nodes)
    k = max(1, banker(frac * len(nodes)))
    inner = [u for u in nodes if u not in gates]
    return sorted(inner, key=lambda u: (-dist.get(u, 0), order(u) if order else u))[:k]


def access_flow(g: AreaGraph, keep: set[int], gates: set[int], frac: float) -> dict:
    """Edge-disjoint routes from the source region to the gateways."""
    gates = gates & keep
    if not gates or len(keep) < 2:
        return {"flow": 0, "cut": [], "source": [], "gates": sorted(gates), "side": 0, "capacity": 0}
    dist = hops(g.around(keep), sorted(gates))
    source = source_region(keep, gates, dist, frac)
    f = street_flow(g, keep, False)
    value = f.run(source, sorted(gates))
    return {"flow": value, "cut": f.cut(), "source": source, "gates": sorted(gates), "side": len(f.side) - 1, "capacity": f.cut_capacity()}


def all_cuts(n: int, nodes: list[int], edges: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Undirected minimum cuts of all pairs from n - 1 flows (cut tree)."""
    f = Flow(n)
    for u, v in edges:
        if u != v:
            f.add(u, v, 1)
            f.add(v, u, 1)
    size = list(f.cap)
    parent = {v: nodes[0] for v in nodes}
    weight = {}
    for i, v in enumerate(nodes[1:], 1):
        f.cap[:] = size + [0] * (len(f.cap) - len(size))
        weight[v], side = _pair_flow(f, v, parent[v])
        for w in nodes[i + 1 :]:
            if w in side and parent[w] == parent[v]:
                parent[w] = v
    out: dict[tuple[int, int], int] = {}
    best = {nodes[0]: {}}
    for v in nodes[1:]:  # a parent always comes before its children
        p = parent[v]
        mine = {p: weight[v]} | {u: min(c, weight[v]) for u, c in best[p].items()}
        for u, c in mine.items():
            best[u][v] = c
            out[min(u, v), max(u, v)] = c
        best[v] = mine
    return out


def _pair_flow(f: Flow, s: int, t: int, most: int | None = None) -> tuple[int, set[int]]:
    """Flow between two nodes on the capacities as they are, and the source's side."""
    value, adj, to, cap = 0, f.adj, f.to, f.cap
    while True:
        via = {s: -1}
        queue = deque((s,))
        while queue and t not in via:
            u = queue.popleft()
            for k in adj[u]:
                if cap[k] > 0 and to[k] not in via:
                    via[to[k]] = k
                    queue.append(to[k])
        if t not in via:
            return value, set(via)
        v = t
        while v != s:  # unit paths
            cap[via[v]] -= 1
            cap[via[v] ^ 1] += 1
            v = to[via[v] ^ 1]
        value += 1
        if most is not None and value >= most:
            return value, set()


def pair_cut(f: Flow, size: list[int], s: int, t: int, most: int) -> int:
    """Directed minimum cut of one ordered pair, at most ``most``."""
    f.cap[:] = size
    return _pair_flow(f, s, t, most)[0]


def grow_ball(adj: list[list[int]], start: int, size: int) -> list[int]:
    """Breadth-first piece."""
    seen, part = {start}, [start]
    for u in part:
        for v in adj[u]:
            if len(part) >= size:
                return part
            if v not in seen:
                seen.add(v)
                part.append(v)
    return part


def grow_random(adj: list[list[int]], start: int, size: int, rank) -> list[int]:
    """Piece that takes, again and again, the neighbour of the lowest rank for that step."""
    part, seen = [start], {start}
    front = set(adj[start])
    while len(part) < size and front:
        v = min(front, key=lambda x: rank(len(part), x))
        part.append(v)
        seen.add(v)
        front |= set(adj[v])
        front -= seen
    return part


def is_connected(adj: list[list[int]], part: set[int]) -> bool:
    start = next(iter(part))
    seen, todo = {start}, [start]
    for u in todo:
        for v in adj[u]:
            if v in part and v not in seen:
                seen.add(v)
                todo.append(v)
    return len(seen) == len(part)
