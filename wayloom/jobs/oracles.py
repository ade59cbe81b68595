"""DuckDB SQL for the queries that SQL can express, over the same fixture.

Weak points, components and hop distances are given by their definition:
removal and reach, by recursive queries.
"""

from __future__ import annotations

from wayloom.functions import fixture
from wayloom.operators.network import CLASS_SPEED

MARGIN_M = 300.0
RADII = (0, 200, 400, 800)
_CLASSES = ", ".join(f"('{k}', {float(v)})" for k, v in CLASS_SPEED.items())
_HAVERSINE = (
    "2 * 6371000.0 * asin(sqrt(pow(sin(radians(n2.lat - n1.lat) / 2), 2) + cos(radians(n1.lat)) * cos(radians(n2.lat)) * pow(sin(radians(n2.lon - n1.lon) / 2), 2)))"
)

_NET = f"""
cls(highway, kmh) AS (VALUES {_CLASSES}),
wall AS (SELECT w.*, coalesce(try_cast(regexp_extract(maxspeed, '^\\s*(\\S+)', 1) AS DOUBLE), cls.kmh, 30.0) AS kmh,
  CASE WHEN lower(oneway) IN ('yes', 'true', '1') THEN 1 WHEN lower(oneway) IN ('-1', 'reverse') THEN -1 WHEN junction = 'roundabout' THEN 1
       WHEN w.highway IN ('motorway', 'motorway_link', 'trunk_link') THEN 1 ELSE 0 END AS dir
  FROM fx_ways w LEFT JOIN cls USING (highway)),
wy AS (SELECT * FROM wall WHERE highway IN (SELECT highway FROM cls)),
seg AS (SELECT way_id, pos, a, b, kmh, dir, length_m FROM (
  SELECT s.*, {_HAVERSINE} AS length_m FROM (
    SELECT way_id, kmh, dir, pos, nodes[pos + 1] AS a, nodes[pos + 2] AS b FROM (SELECT *, unnest(range(0, len(nodes) - 1)) AS pos FROM wy)) s
  JOIN fx_nodes n1 ON n1.node_id = s.a JOIN fx_nodes n2 ON n2.node_id = s.b) WHERE length_m > 0),
sarc AS (SELECT a, b FROM seg WHERE dir >= 0 UNION SELECT b, a FROM seg WHERE dir <= 0),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT a AS node_id FROM seg UNION ALL SELECT b FROM seg) GROUP BY 1),
ends AS (SELECT node_id FROM deg WHERE degree <> 2),
firstk AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, arg_min(kmh, (way_id, pos)) AS kmh FROM seg GROUP BY 1, 2),
seg2 AS (SELECT s.way_id * 1048576 + pos AS sid, a, b, length_m, length_m / (f.kmh * 1000 / 3600) AS t,
  EXISTS (SELECT 1 FROM sarc x WHERE x.a = s.a AND x.b = s.b) AS f, EXISTS (SELECT 1 FROM sarc x WHERE x.a = s.b AND x.b = s.a) AS k
  FROM seg s JOIN firstk f ON f.lo = least(s.a, s.b) AND f.hi = greatest(s.a, s.b)),
half AS (SELECT sid, a, b, length_m, t, f, k FROM seg2 UNION ALL SELECT sid, b, a, length_m, t, k, f FROM seg2),
walk AS (SELECT sid AS hs, a AS a0, sid, b, length_m, t, f, k, [a, b] AS path FROM half WHERE a IN (SELECT node_id FROM ends)
  UNION ALL SELECT w.hs, w.a0, h.sid, h.b, w.length_m + h.length_m, w.t + h.t, w.f AND h.f, w.k AND h.k, list_append(w.path, h.b)
  FROM walk w JOIN half h ON h.a = w.b AND h.sid <> w.sid WHERE w.b NOT IN (SELECT node_id FROM ends)),
ch AS (SELECT a0 AS u, b AS v, hs AS street_id, length_m, t AS time_s, f AS fwd, k AS bwd, path FROM walk
  WHERE b IN (SELECT node_id FROM ends) AND (a0 < b OR (a0 = b AND hs <= sid))),
st AS (SELECT * FROM ch WHERE u <> v AND (fwd OR bwd)),
ar AS (SELECT street_id, u, v, length_m, time_s FROM st WHERE fwd UNION ALL SELECT street_id, v, u, length_m, time_s FROM st WHERE bwd),
nn AS (SELECT * FROM fx_nodes WHERE node_id IN (SELECT u FROM ch UNION SELECT v FROM ch))"""
_AREA = f""",
pb AS (SELECT area_id, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM fx_bounds GROUP BY 1),
pe AS (SELECT area_id, lon AS x1, lat AS y1, coalesce(lead(lon) OVER q, first_value(lon) OVER q) AS x2, coalesce(lead(lat) OVER q, first_value(lat) OVER q) AS y2
  FROM fx_bounds WINDOW q AS (PARTITION BY area_id, ring_id ORDER BY seq)),
gbox AS (SELECT area_id, s - {MARGIN_M} / 110540.0 AS s, w - {MARGIN_M} / (cos(radians((s + n) / 2)) * 111320.0) AS w, n + {MARGIN_M} / 110540.0 AS n,
  e + {MARGIN_M} / (cos(radians((s + n) / 2)) * 111320.0) AS e FROM pb),
ctr AS (SELECT area_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM fx_nodes JOIN gbox ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1),
inall AS (SELECT area_id, node_id FROM fx_nodes JOIN pe ON true GROUP BY 1, 2
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1),
an AS (SELECT * FROM inall WHERE node_id IN (SELECT node_id FROM nn)),
ast AS (SELECT i.area_id, st.* FROM st JOIN an i ON i.node_id = u JOIN an j ON j.node_id = v AND j.area_id = i.area_id),
aar AS (SELECT i.area_id, ar.* FROM ar JOIN an i ON i.node_id = u JOIN an j ON j.node_id = v AND j.area_id = i.area_id),
margin AS (SELECT area_id, node_id FROM nn JOIN gbox ON lat BETWEEN s AND n AND lon BETWEEN w AND e),
two AS (SELECT u, v FROM st UNION ALL SELECT v, u FROM st),
exits AS (SELECT DISTINCT i.area_id, u AS node_id FROM two JOIN an i ON i.node_id = u JOIN margin m ON m.area_id = i.area_id AND m.node_id = v
  WHERE NOT EXISTS (SELECT 1 FROM an j WHERE j.area_id = i.area_id AND j.node_id = v))"""
_PARTS = """,
edge AS (SELECT DISTINCT area_id, u, v FROM (SELECT area_id, u, v FROM ast UNION ALL SELECT area_id, v, u FROM ast)),
arc AS (SELECT DISTINCT area_id, u, v FROM aar WHERE u <> v),
ur AS (SELECT area_id, node_id AS a, node_id AS b FROM an UNION SELECT ur.area_id, ur.a, edge.v FROM ur JOIN edge ON edge.area_id = ur.area_id AND edge.u = ur.b),
comp AS (SELECT area_id, a AS node_id, min(b) AS component FROM ur GROUP BY 1, 2),
csize AS (SELECT area_id, component, count(*) AS size, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, component) = 1 AS giant FROM comp GROUP BY 1, 2),
dr AS (SELECT area_id, node_id AS a, node_id AS b FROM an UNION SELECT dr.area_id, dr.a, arc.v FROM dr JOIN arc ON arc.area_id = dr.area_id AND arc.u = dr.b),
scc AS (SELECT x.area_id, x.a AS node_id, min(x.b) AS scc FROM dr x JOIN dr y ON x.area_id = y.area_id AND x.a = y.b AND x.b = y.a GROUP BY 1, 2),
ssize AS (SELECT area_id, scc, count(*) AS size, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, scc) AS place FROM scc GROUP BY 1, 2),
giant AS (SELECT area_id, node_id FROM comp JOIN csize USING (area_id, component) WHERE giant),
core AS (SELECT area_id, node_id FROM scc JOIN ssize USING (area_id, scc) WHERE place = 1),
gates AS (SELECT * FROM exits SEMI JOIN giant USING (area_id, node_id))"""
_SIZES = """,
sm AS (SELECT area_id, count(*) AS v, (SELECT count(*) FROM ast WHERE ast.area_id = an.area_id) AS streets, (SELECT count(*) FROM aar WHERE aar.area_id = an.area_id) AS arcs,
  (SELECT count(*) FROM core WHERE core.area_id = an.area_id) AS core, (SELECT count(*) FROM gates WHERE gates.area_id = an.area_id) AS n_gateways FROM an GROUP BY area_id)"""
_DIST = """,
kx AS (SELECT area_id, cos(radians(avg(lat))) * 111320.0 AS kx FROM fx_bounds GROUP BY 1),
dd AS (SELECT area_id, node_id, min(sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2))) AS d,
    sqrt(pow(greatest(min(least(ax, bx)) - any_value(px), 0.0, any_value(px) - max(greatest(ax, bx))), 2) + pow(greatest(min(least(ay, b_y)) - any_value(py), 0.0, any_value(py) - max(greatest(ay, b_y))), 2)) AS box
  FROM (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t
    FROM (SELECT area_id, node_id, lon * kx AS px, lat * 110540.0 AS py, x1 * kx AS ax, y1 * 110540.0 AS ay, x2 * kx AS bx, y2 * 110540.0 AS b_y, (x2 - x1) * kx AS dx, (y2 - y1) * 110540.0 AS dy
      FROM nn JOIN pe ON true JOIN kx USING (area_id))) GROUP BY 1, 2),
dist AS (SELECT area_id, node_id, CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.area_id = dd.area_id AND an.node_id = dd.node_id) THEN 0.0 ELSE d END AS dist_m FROM dd
  WHERE box <= 1101.0 OR EXISTS (SELECT 1 FROM an WHERE an.area_id = dd.area_id AND an.node_id = dd.node_id))"""


def _sql(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + fixture.SQL + "".join(p if p.startswith(",") else f",\n{p}" for p in parts) + "\n" + body


def _box(a: str, margin: float) -> str:
    k = "(cos(radians((s + n) / 2)) * 111320.0)"
    return f"SELECT area_id, s - {margin} / 110540.0 AS s, w - {margin} / {k} AS w, n + {margin} / 110540.0 AS n, e + {margin} / {k} AS e FROM {a}"


_R9 = ", ".join(f"round({c}, 9) AS {c}" for c in "swne")
_XY = "round((lon - lon0) * cos(radians(lat0)) * 111320.0, 4) AS x, round((lat - lat0) * 110540.0, 4) AS y"
_FULL = (_NET, _AREA, _PARTS)
_HOP = "hop AS (SELECT area_id, node_id, 0 AS hops FROM {seed} UNION SELECT hop.area_id, edge.v, hop.hops + 1 FROM hop JOIN edge ON edge.area_id = hop.area_id AND edge.u = hop.node_id WHERE hop.hops < {most})"
#: Unordered street pairs, and what is still reached from the area's first node of a pair without it.
_PAIRS = """,
pr AS (SELECT area_id, least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n FROM ast GROUP BY 1, 2, 3)"""

ORACLES: dict[str, str] = {
    "s1_read_elements": _sql("SELECT 'way' AS kind, way_id AS id, CAST(len(nodes) AS BIGINT) AS n_points, highway FROM fx_ways UNION ALL SELECT 'node', node_id, 0, NULL FROM fx_nodes"),
    "s2_read_boundaries": _sql("SELECT area_id, ring_id, seq, round(lon, 9) AS lon, round(lat, 9) AS lat FROM fx_bounds"),
    "s3_area_config": _sql(
        f"SELECT area_id, 'area_' || lpad(CAST(area_id AS VARCHAR), 4, '0') AS key, 'Area ' || lpad(CAST(area_id AS VARCHAR), 4, '0') AS display_name, ['corner', 'window', 'sweep'][area_id % 3 + 1] AS od_rule, {_R9} FROM pb", _NET, _AREA
    ),
    "s4_collect_metrics": _sql("SELECT area_id, 'Area ' || lpad(CAST(area_id AS VARCHAR), 4, '0') AS display_name, v, streets, arcs FROM sm", *_FULL, _SIZES),
    "s5_metrics_json": _sql("SELECT area_id, v, streets, arcs, n_gateways FROM sm", *_FULL, _SIZES),
    "s6_wide_csv": _sql(
        "SELECT area_id, replace(CAST(round(100.0 * (2 * streets - arcs) / streets, 1) AS VARCHAR), '.', ',') AS one_way_pct, CASE WHEN area_id > 0 THEN CAST(v AS VARCHAR) ELSE '' END AS v FROM sm", *_FULL, _SIZES
    ),
    "s7_long_csv": _sql("SELECT area_id, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT area_id, v, streets, arcs FROM sm) ON v, streets, arcs INTO NAME metric VALUE value)", *_FULL, _SIZES),
    "p1_drivable": _sql("SELECT way_id, highway FROM wy", _NET),
    "p2_direction": _sql("SELECT way_id, dir FROM wall", _NET),
    "p3_speed": _sql("SELECT way_id, kmh FROM wall", _NET),
    "p4_length": _sql("SELECT way_id, pos, round(length_m, 6) AS length_m FROM seg", _NET),
    "p5_travel_time": _sql("SELECT way_id, pos, round(length_m / (kmh * 1000 / 3600), 6) AS time_s FROM seg", _NET),
    "p6_projection": _sql(f"SELECT area_id, node_id, {_XY} FROM fx_nodes JOIN gbox ON lat BETWEEN s AND n AND lon BETWEEN w AND e JOIN ctr USING (area_id)", _NET, _AREA),
    "p7_expand_box": _sql(f"SELECT area_id, {_R9} FROM gbox", _NET, _AREA),
    "p8_union_box": _sql(
        "SELECT area_id, round(least(q.s, pb.s), 9) AS s, round(least(q.w, pb.w), 9) AS w, round(greatest(q.n, pb.n), 9) AS n, round(greatest(q.e, pb.e), 9) AS e FROM q JOIN pb USING (area_id)",
        _NET, _AREA, "q0 AS (SELECT area_id, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM an JOIN nn USING (node_id) GROUP BY 1)", f"q AS ({_box('q0', 100.0)})",
    ),
    "p9_polygon_box": _sql(f"SELECT area_id, {_R9} FROM pb", _NET, _AREA),
    "p10_ways_in_box": _sql(
        "SELECT DISTINCT area_id, way_id, len(nodes) AS n_points FROM (SELECT *, unnest(nodes) AS p FROM wy) x JOIN fx_nodes f ON f.node_id = p JOIN pb ON lat BETWEEN s AND pb.n AND lon BETWEEN w AND e", _NET, _AREA
    ),
    "p11_window": _sql(
        "SELECT k.area_id, street_id, fwd AND bwd AS two_way FROM st JOIN keep k ON k.node_id = u JOIN keep j ON j.node_id = v AND j.area_id = k.area_id",
        _NET, _AREA, f"small AS ({_box('pb', -400.0)})", "keep AS (SELECT area_id, node_id FROM nn JOIN small ON lat BETWEEN s AND n AND lon BETWEEN w AND e)",
    ),
    "p12_percent": _sql("SELECT area_id, round(100.0 * (v - core) / v, 1) AS outside_core_pct, CAST(NULL AS DOUBLE) AS none FROM sm", *_FULL, _SIZES),
    "n1_segments": _sql("SELECT way_id, pos, a, b, round(length_m, 6) AS length_m, kmh, dir FROM seg", _NET),
    "n2_segment_arcs": _sql("SELECT a, b FROM sarc", _NET),
    "n3_intersections": _sql("SELECT node_id, degree FROM deg WHERE degree <> 2", _NET),
    "n4_contract_chains": _sql("SELECT u, v, len(path) AS n_points, round(length_m, 6) AS length_m FROM ch", _NET),
    "n5_chain_aggregates": _sql(
        "SELECT street_id, rank, round(length_m, 6) AS length_m, round(time_s, 6) AS time_s, fwd, bwd, round(lon, 9) AS lon, round(lat, 9) AS lat FROM (SELECT *, unnest(range(0, len(path))) AS rank FROM st) p JOIN fx_nodes ON node_id = path[rank + 1]", _NET
    ),
    "n6_arcs": _sql("SELECT street_id, u, v, round(length_m, 6) AS length_m, round(time_s, 6) AS time_s FROM ar", _NET),
    "n7_nodes": _sql(f"SELECT area_id, node_id, round(lat, 9) AS lat, round(lon, 9) AS lon, {_XY} FROM nn JOIN gbox ON lat BETWEEN s AND n AND lon BETWEEN w AND e JOIN ctr USING (area_id)", _NET, _AREA),
    "n8_build_stats": _sql(
        "SELECT w.area_id, ways, with_maxspeed, coalesce(kept, 0) AS kept, coalesce(loops, 0) AS loops, coalesce(mixed, 0) AS mixed, coalesce(parallel_pairs, 0) AS parallel_pairs, "
        "round(100.0 * (loops + mixed) / (kept + loops + mixed), 1) AS discarded_pct FROM "
        "(SELECT area_id, count(*) AS ways, count(maxspeed) AS with_maxspeed FROM (SELECT DISTINCT area_id, way_id FROM (SELECT way_id, unnest(nodes) AS p FROM wy) x JOIN fx_nodes f ON f.node_id = p JOIN pb ON lat BETWEEN s AND pb.n AND lon BETWEEN w AND e) JOIN wy USING (way_id) GROUP BY 1) w "
        "LEFT JOIN (SELECT area_id, count(*) FILTER (WHERE u <> v AND (fwd OR bwd)) AS kept, count(*) FILTER (WHERE u = v) AS loops, count(*) FILTER (WHERE u <> v AND NOT fwd AND NOT bwd) AS mixed FROM bch GROUP BY 1) c USING (area_id) "
        "LEFT JOIN (SELECT area_id, count(*) AS parallel_pairs FROM (SELECT area_id FROM bch WHERE u <> v AND (fwd OR bwd) GROUP BY area_id, least(u, v), greatest(u, v) HAVING count(*) > 1) GROUP BY 1) p USING (area_id)",
        _NET, _AREA, "keep AS (SELECT area_id, node_id FROM nn JOIN pb ON lat BETWEEN s AND n AND lon BETWEEN w AND e)",
        "bch AS (SELECT a.area_id, u, v, fwd, bwd FROM ch JOIN keep a ON a.node_id = u JOIN keep b ON b.node_id = v AND b.area_id = a.area_id)",
    ),
    "g1_points_in_areas": _sql("SELECT area_id, node_id FROM inall", _NET, _AREA),
    "g2_clip": _sql("SELECT area_id, v AS nodes, streets, arcs FROM sm", *_FULL, _SIZES),
    "g3_box_clip": _sql(
        "SELECT area_id, (SELECT count(*) FROM st JOIN keep a ON a.node_id = u JOIN keep b ON b.node_id = v WHERE a.area_id = pb.area_id AND b.area_id = pb.area_id) AS streets, "
        "(SELECT count(*) FROM ar JOIN keep a ON a.node_id = u JOIN keep b ON b.node_id = v WHERE a.area_id = pb.area_id AND b.area_id = pb.area_id) AS arcs FROM pb",
        _NET, _AREA, "keep AS (SELECT area_id, node_id FROM nn JOIN pb ON lat BETWEEN s AND n AND lon BETWEEN w AND e)",
    ),
    "g4_distance": _sql("SELECT area_id, node_id, round(dist_m, 4) AS dist_m FROM dist", _NET, _AREA, _DIST),
    "g5_gateways": _sql(f"SELECT area_id, node_id, CAST({MARGIN_M} AS DOUBLE) AS margin_m FROM gates", *_FULL),
    "g6_rings": _sql(
        "SELECT area_id, r_m, count(*) AS nodes, (SELECT count(*) FROM st JOIN ring a ON a.node_id = u JOIN ring b ON b.node_id = v WHERE a.area_id = r.area_id AND b.area_id = r.area_id AND a.r_m = r.r_m AND b.r_m = r.r_m) AS streets FROM ring r GROUP BY 1, 2",
        _NET, _AREA, _DIST, f"ring AS (SELECT area_id, node_id, r_m FROM dist JOIN (VALUES {', '.join(f'({r})' for r in RADII)}) v(r_m) ON dist_m <= r_m)",
    ),
    "g7_ring_destinations": _sql(
        f"SELECT DISTINCT a.area_id, r_m, directed, u AS node_id FROM (SELECT u, v, true AS directed FROM ar UNION ALL SELECT u, v, false FROM two) x JOIN dist a ON a.node_id = u JOIN dist b ON b.node_id = v AND b.area_id = a.area_id "
        f"JOIN (VALUES {', '.join(f'({r})' for r in RADII)}) q(r_m) ON a.dist_m <= r_m AND b.dist_m > r_m AND b.dist_m <= r_m + {MARGIN_M} + 1", _NET, _AREA, _DIST
    ),
    "g8_street_class": _sql(
        "SELECT a.area_id, street_id, CASE (a.dist_m = 0)::INT + (b.dist_m = 0)::INT WHEN 2 THEN 'internal' WHEN 1 THEN 'boundary' ELSE 'external' END AS class FROM st JOIN dist a ON a.node_id = u JOIN dist b ON b.node_id = v AND b.area_id = a.area_id", _NET, _AREA, _DIST
    ),
    "g9_tunnel_gateways": _sql(
        "SELECT DISTINCT g.area_id, g.node_id, 'T' || CAST(tn.way_id AS VARCHAR) AS tunnel FROM gates g JOIN (SELECT street_id, u, v, path FROM st UNION ALL SELECT street_id, v, u, path FROM st) s ON s.u = g.node_id "
        "JOIN (SELECT street_id AS sid, unnest(path) AS p FROM st) pts ON sid = s.street_id JOIN fx_nodes a ON a.node_id = p JOIN ctr ON ctr.area_id = g.area_id JOIN tn ON sqrt(pow((a.lon - tn.lon) * cos(radians(lat0)) * 111320.0, 2) + pow((a.lat - tn.lat) * 110540.0, 2)) < 2.0 "
        "WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.area_id = g.area_id AND an.node_id = s.v)",
        *_FULL, "tn AS (SELECT way_id, lon, lat FROM (SELECT way_id, unnest(nodes) AS p FROM wy WHERE tunnel IS NOT NULL) JOIN fx_nodes ON node_id = p)",
    ),
    "c1_undirected_edges": _sql("SELECT DISTINCT area_id, least(u, v) AS lo, greatest(u, v) AS hi FROM ast", _NET, _AREA),
    "c2_degrees": _sql(
        "SELECT area_id, node_id, (SELECT count(*) FROM aar WHERE aar.area_id = an.area_id AND u = node_id) AS out_degree, (SELECT count(*) FROM aar WHERE aar.area_id = an.area_id AND v = node_id) AS in_degree, d AS degree, d = 1 AS dead_end "
        "FROM (SELECT *, (SELECT count(*) FROM ast WHERE ast.area_id = an.area_id AND (u = node_id OR v = node_id)) AS d FROM an) an", _NET, _AREA
    ),
    "c3_components": _sql("SELECT area_id, node_id, component, size, giant FROM comp JOIN csize USING (area_id, component)", *_FULL),
    "c4_reach": _sql(
        "SELECT area_id, 0 AS scenario, b AS node_id, false AS backward FROM dr JOIN f USING (area_id) WHERE a = f.node_id UNION ALL SELECT area_id, 0, a, true FROM dr JOIN f USING (area_id) WHERE b = f.node_id",
        *_FULL, "f AS (SELECT area_id, min(node_id) AS node_id FROM core GROUP BY 1)",
    ),
    "c5_strong_components": _sql("SELECT area_id, node_id, scc, place = 1 AS core FROM scc JOIN ssize USING (area_id, scc)", *_FULL),
    "c6_hops_from_one": _sql("SELECT area_id, node_id, min(hops) AS hops FROM hop GROUP BY 1, 2", *_FULL, "f AS (SELECT area_id, min(node_id) AS node_id FROM core GROUP BY 1)", _HOP.format(seed="f", most=80)),
    "c7_hops_to_gateways": _sql("SELECT area_id, node_id, min(hops) AS hops FROM hop GROUP BY 1, 2", *_FULL, _HOP.format(seed="gates", most=60)),
    "f1_unit_capacities": _sql("SELECT area_id, a, b, count(*) AS cap FROM (SELECT area_id, u AS a, v AS b FROM ast UNION ALL SELECT area_id, v, u FROM ast) GROUP BY 1, 2, 3", _NET, _AREA),
    "f2_directed_capacities": _sql("SELECT area_id, u AS a, v AS b, count(*) AS cap FROM aar JOIN giant g USING (area_id) WHERE g.node_id = u AND EXISTS (SELECT 1 FROM giant h WHERE h.area_id = aar.area_id AND h.node_id = v) GROUP BY 1, 2, 3", *_FULL),
    "f6_source_region": _sql(
        "SELECT area_id, node_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY dist DESC, node_id) AS place FROM d0) JOIN k USING (area_id) WHERE place <= k",
        *_FULL, _HOP.format(seed="gates", most=60), "d0 AS (SELECT area_id, node_id, min(hops) AS dist FROM hop GROUP BY 1, 2 HAVING min(hops) > 0)",
        "k AS (SELECT area_id, greatest(1, CAST(round_even(0.2 * count(*), 0) AS INT)) AS k FROM giant GROUP BY 1)",
    ),
    "w1_bridges": _sql(
        "SELECT area_id, lo, hi FROM lone WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.area_id = lone.area_id AND re.lo = lone.lo AND re.hi = lone.hi AND re.x = lone.hi)",
        *_FULL, _PAIRS, "lone AS (SELECT area_id, lo, hi FROM pr WHERE n = 1)",
        "re AS (SELECT area_id, lo, hi, lo AS x FROM lone UNION SELECT re.area_id, lo, hi, v FROM re JOIN edge ON edge.area_id = re.area_id AND u = x AND NOT (least(u, v) = lo AND greatest(u, v) = hi))",
    ),
    "w3_strong_bridges": _sql(
        "SELECT area_id, lo, hi FROM cp2 LEFT JOIN (SELECT area_id, lo, hi, count(DISTINCT x) AS n FROM fr SEMI JOIN core ON core.area_id = fr.area_id AND core.node_id = fr.x GROUP BY 1, 2, 3) a USING (area_id, lo, hi) "
        "LEFT JOIN (SELECT area_id, lo, hi, count(DISTINCT x) AS n FROM br SEMI JOIN core ON core.area_id = br.area_id AND core.node_id = br.x GROUP BY 1, 2, 3) b USING (area_id, lo, hi) JOIN cs USING (area_id) WHERE a.n < cs.n OR b.n < cs.n",
        *_FULL, _PAIRS, "cs AS (SELECT area_id, count(*) AS n, min(node_id) AS root FROM core GROUP BY 1)",
        "cp AS (SELECT pr.area_id, lo, hi FROM pr SEMI JOIN core ON core.area_id = pr.area_id AND core.node_id = lo)", "cp2 AS (SELECT * FROM cp SEMI JOIN core ON core.area_id = cp.area_id AND core.node_id = hi)",
        "fr AS (SELECT area_id, lo, hi, root AS x FROM cp2 JOIN cs USING (area_id) UNION SELECT fr.area_id, lo, hi, v FROM fr JOIN arc ON arc.area_id = fr.area_id AND u = x AND NOT (least(u, v) = lo AND greatest(u, v) = hi))",
        "br AS (SELECT area_id, lo, hi, root AS x FROM cp2 JOIN cs USING (area_id) UNION SELECT br.area_id, lo, hi, u FROM br JOIN arc ON arc.area_id = br.area_id AND v = x AND NOT (least(u, v) = lo AND greatest(u, v) = hi))",
    ),
    "r2_one_way_share": _sql("SELECT area_id, arcs - streets AS two_way, round(100.0 * (2 * streets - arcs) / streets, 1) AS one_way_pct FROM sm", *_FULL, _SIZES),
    "r6_scc_sizes": _sql("SELECT area_id, place, scc, size, (SELECT count(*) FROM ssize x WHERE x.area_id = ssize.area_id AND x.size = 1) AS trivial FROM ssize WHERE size > 1", *_FULL),
}
# articulation: without the node, its neighbours don't all reach each other
ORACLES["w2_articulations"] = _sql(
    "SELECT DISTINCT area_id, cut AS node_id FROM (SELECT edge.area_id, edge.u AS cut, edge.v AS nb FROM edge) e WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.area_id = e.area_id AND re.cut = e.cut AND re.x = e.nb)",
    *_FULL,
    "re AS (SELECT area_id, u AS cut, min(v) AS x FROM edge GROUP BY 1, 2 UNION SELECT re.area_id, cut, v FROM re JOIN edge ON edge.area_id = re.area_id AND u = x AND v <> cut)",
)
# strong articulation: without it, the rest of the core is not one strong component
ORACLES["w4_strong_articulations"] = _sql(
    "SELECT area_id, cut AS node_id FROM ct LEFT JOIN (SELECT area_id, cut, count(DISTINCT x) AS n FROM fr SEMI JOIN core ON core.area_id = fr.area_id AND core.node_id = fr.x GROUP BY 1, 2) a USING (area_id, cut) "
    "LEFT JOIN (SELECT area_id, cut, count(DISTINCT x) AS n FROM br SEMI JOIN core ON core.area_id = br.area_id AND core.node_id = br.x GROUP BY 1, 2) b USING (area_id, cut) WHERE a.n < size - 1 OR b.n < size - 1",
    *_FULL,
    "ct AS (SELECT c.area_id, c.node_id AS cut, min(d.node_id) AS root, count(*) + 1 AS size FROM core c JOIN core d ON d.area_id = c.area_id AND d.node_id <> c.node_id GROUP BY 1, 2)",
    "fr AS (SELECT area_id, cut, root AS x FROM ct UNION SELECT fr.area_id, cut, v FROM fr JOIN arc ON arc.area_id = fr.area_id AND u = x AND v <> cut)",
    "br AS (SELECT area_id, cut, root AS x FROM ct UNION SELECT br.area_id, cut, u FROM br JOIN arc ON arc.area_id = br.area_id AND v = x AND u <> cut)",
)

_K = "k AS (SELECT area_id, greatest(1, CAST(round_even(0.2 * count(*), 0) AS INT)) AS k FROM giant GROUP BY 1)"
_INNER = "d0 AS (SELECT area_id, node_id, min(hops) AS dist FROM hop GROUP BY 1, 2 HAVING min(hops) > 0)"
_SOURCE = "src AS (SELECT area_id, node_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY dist DESC, node_id) AS place FROM d0) JOIN k USING (area_id) WHERE place <= k)"
_REGION = (*_FULL, _HOP.format(seed="gates", most=60), _INNER, _K, _SOURCE)
ORACLES["f3_split_capacities"] = _sql(
    "SELECT area_id, 2 * node_id AS a, 2 * node_id + 1 AS b, CASE WHEN EXISTS (SELECT 1 FROM src WHERE src.area_id = giant.area_id AND src.node_id = giant.node_id) "
    "OR EXISTS (SELECT 1 FROM gates WHERE gates.area_id = giant.area_id AND gates.node_id = giant.node_id) THEN CAST(1000000000 AS BIGINT) ELSE 1 END AS cap FROM giant "
    "UNION ALL SELECT area_id, 2 * u + 1, 2 * v, 1000000000 FROM (SELECT DISTINCT area_id, u, v FROM aar JOIN giant g USING (area_id) WHERE g.node_id = u AND EXISTS (SELECT 1 FROM giant h WHERE h.area_id = aar.area_id AND h.node_id = v))",
    *_REGION,
)
ORACLES["x4_tie_counts"] = _sql(
    "SELECT area_id, k, last_dist, count(*) FILTER (WHERE dist = last_dist) AS tied, count(*) FILTER (WHERE dist > last_dist) AS above, k - count(*) FILTER (WHERE dist > last_dist) AS places "
    "FROM d0 JOIN (SELECT area_id, count(*) AS k, min(dist) AS last_dist FROM src GROUP BY 1) USING (area_id) GROUP BY 1, 2, 3", *_REGION
)
ORACLES["w6_single_street_cuts"] = _sql(
    "SELECT area_id, lo, hi, count(*) AS side, round(100.0 * count(*) / (SELECT count(*) FROM giant WHERE giant.area_id = re.area_id), 1) AS side_pct FROM re "
    "GROUP BY area_id, lo, hi HAVING count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gates WHERE gates.area_id = re.area_id AND gates.node_id = x)) = 0",
    *_REGION, _PAIRS,
    "re AS (SELECT pr.area_id, lo, hi, src.node_id AS x FROM pr JOIN src USING (area_id) WHERE n = 1 AND EXISTS (SELECT 1 FROM giant WHERE giant.area_id = pr.area_id AND giant.node_id = lo) "
    "UNION SELECT re.area_id, lo, hi, v FROM re JOIN edge ON edge.area_id = re.area_id AND u = x AND NOT (least(u, v) = lo AND greatest(u, v) = hi))",
)


def _points(bridges: str, nodes: str) -> str:
    return f"(SELECT area_id, 'bridge' AS what, lo, hi FROM ({ORACLES[bridges]}) UNION ALL SELECT area_id, 'articulation', node_id, node_id FROM ({ORACLES[nodes]}))"


ORACLES["w5_weak_by_strong"] = (
    "SELECT area_id, what, CASE WHEN w AND s THEN 'both' WHEN s THEN 'strong_only' ELSE 'weak_only' END AS kind, count(*) AS n "
    f"FROM (SELECT *, true AS w FROM {_points('w1_bridges', 'w2_articulations')}) FULL JOIN (SELECT *, true AS s FROM {_points('w3_strong_bridges', 'w4_strong_articulations')}) USING (area_id, what, lo, hi) GROUP BY 1, 2, 3"
)
ORACLES["r3_cross_table"] = (
    "SELECT area_id, what, kind, coalesce(n, 0) AS n FROM (SELECT DISTINCT area_id FROM (" + ORACLES["p9_polygon_box"] + ")) CROSS JOIN (VALUES ('bridge'), ('articulation')) a(what) "
    f"CROSS JOIN (VALUES ('both'), ('strong_only'), ('weak_only')) b(kind) LEFT JOIN ({ORACLES['w5_weak_by_strong']}) USING (area_id, what, kind)"
)


# least times by rounds of relaxation; a key keeps its last row
_OD = """,
mt AS (SELECT area_id, u, v, min(time_s) AS w FROM aar WHERE u <> v GROUP BY 1, 2, 3),
xy AS (SELECT an.area_id, an.node_id, round((lon - lon0) * cos(radians(lat0)) * 111320.0, 6) AS x, round((lat - lat0) * 110540.0, 6) AS y,
    (SELECT count(*) FROM ast WHERE ast.area_id = an.area_id AND (u = an.node_id OR v = an.node_id)) AS degree
  FROM an SEMI JOIN core USING (area_id, node_id) JOIN nn USING (node_id) JOIN ctr ON ctr.area_id = an.area_id),
mid AS (SELECT area_id, round(avg(y), 6) AS mid FROM xy WHERE degree > 0 GROUP BY 1),
f0 AS (SELECT area_id, min(node_id) AS node_id FROM core GROUP BY 1),
s1(area_id, node_id, t) USING KEY (area_id, node_id) AS (SELECT area_id, node_id, 0.0::DOUBLE FROM f0 UNION SELECT mt.area_id, mt.v, min(s1.t + mt.w)
  FROM s1 JOIN mt ON mt.area_id = s1.area_id AND mt.u = s1.node_id LEFT JOIN recurring.s1 r ON r.area_id = mt.area_id AND r.node_id = mt.v WHERE r.t IS NULL OR s1.t + mt.w < r.t GROUP BY 1, 2),
f1 AS (SELECT area_id, arg_min(node_id, (-round(t, 6), node_id)) AS node_id FROM s1 SEMI JOIN core USING (area_id, node_id) GROUP BY 1),
s2(area_id, node_id, t) USING KEY (area_id, node_id) AS (SELECT area_id, node_id, 0.0::DOUBLE FROM f1 UNION SELECT mt.area_id, mt.v, min(s2.t + mt.w)
  FROM s2 JOIN mt ON mt.area_id = s2.area_id AND mt.u = s2.node_id LEFT JOIN recurring.s2 r ON r.area_id = mt.area_id AND r.node_id = mt.v WHERE r.t IS NULL OR s2.t + mt.w < r.t GROUP BY 1, 2),
f2 AS (SELECT area_id, arg_min(node_id, (-round(t, 6), node_id)) AS node_id FROM s2 SEMI JOIN core USING (area_id, node_id) GROUP BY 1),
od AS (SELECT area_id, 'corner' AS rule, arg_min(node_id, (-round(x + y, 5), node_id)) AS o, arg_min(node_id, (round(x + y, 5), node_id)) AS d FROM xy WHERE degree >= 3 GROUP BY 1
  UNION ALL SELECT area_id, 'window', arg_min(node_id, (-x, node_id)), arg_min(node_id, (x, node_id)) FROM xy JOIN mid USING (area_id) WHERE degree > 0 AND y > mid GROUP BY 1
  UNION ALL SELECT f1.area_id, 'sweep', f1.node_id, f2.node_id FROM f1 JOIN f2 USING (area_id)),
sp(area_id, rule, node_id, t) USING KEY (area_id, rule, node_id) AS (SELECT area_id, rule, o, 0.0::DOUBLE FROM od UNION SELECT mt.area_id, sp.rule, mt.v, min(sp.t + mt.w)
  FROM sp JOIN mt ON mt.area_id = sp.area_id AND mt.u = sp.node_id LEFT JOIN recurring.sp r ON r.area_id = mt.area_id AND r.rule = sp.rule AND r.node_id = mt.v WHERE r.t IS NULL OR sp.t + mt.w < r.t GROUP BY 1, 2, 3)"""
ORACLES["c12_od_rules"] = _sql("SELECT area_id, rule, o, d FROM od", *_FULL, _OD)
ORACLES["c8_shortest_times"] = _sql("SELECT area_id, rule, o, node_id, round(t, 5) AS time_s FROM sp JOIN od USING (area_id, rule)", *_FULL, _OD)
ORACLES["c9_relaxation_check"] = _sql("SELECT area_id, rule, count(*) AS nodes, count(*) AS equal FROM sp GROUP BY 1, 2", *_FULL, _OD)
# back from the target over the first of the least ways into each node
ORACLES["c10_shortest_paths"] = _sql(
    "SELECT area_id, rule, CAST(max(back) OVER (PARTITION BY area_id, rule) - back AS INT) AS pos, node_id FROM walk_back",
    *_FULL, _OD,
    "pre AS (SELECT a.area_id, a.rule, mt.v AS node_id, arg_min(mt.u, (round(a.t + mt.w, 6), mt.u)) AS u FROM sp a JOIN mt ON mt.area_id = a.area_id AND mt.u = a.node_id "
    "JOIN sp b ON b.area_id = a.area_id AND b.rule = a.rule AND b.node_id = mt.v WHERE b.t > 0 GROUP BY 1, 2, 3)",
    "walk_back AS (SELECT od.area_id, od.rule, od.d AS node_id, 0 AS back FROM od JOIN sp ON sp.area_id = od.area_id AND sp.rule = od.rule AND sp.node_id = od.d "
    "UNION ALL SELECT w.area_id, w.rule, pre.u, back + 1 FROM walk_back w JOIN pre USING (area_id, rule, node_id))",
)
