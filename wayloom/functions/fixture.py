"""A street-like grid network derived from the ``part`` and ``supplier`` tables.

``views`` gives the Spark tables that stand for raw map data; ``SQL`` gives the
same as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Corners of the L-shaped boundary of a tile: sequence, longitude and latitude offsets.
CORNERS = (
    (0, -0.0005, -0.0005), (1, 0.0195, -0.0005), (2, 0.0195, 0.0125), (3, 0.0125, 0.0125),
    (4, 0.0125, 0.0195), (5, -0.0005, 0.0195), (6, -0.0005, -0.0005),
)
_CORNERS = ", ".join(f"({s}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for s, a, b in CORNERS)

_NODES = """
  SELECT p_partkey AS node_id, p_partkey {div} 40 AS gi, p_partkey % 40 AS gj,
    CAST(-22.95 AS DOUBLE) + (p_partkey {div} 40) * CAST(0.001 AS DOUBLE) + ((p_partkey * 7919) % 1000 - 500) * CAST(0.0000004 AS DOUBLE) AS lat,
    CAST(-43.20 AS DOUBLE) + (p_partkey % 40) * CAST(0.001 AS DOUBLE) + ((p_partkey * 6101) % 1000 - 500) * CAST(0.0000004 AS DOUBLE) AS lon,
    p_size, CAST(substr(p_brand, 7) AS INT) AS b
  FROM part"""
_RUNS = """
  SELECT axis, line, min(u) AS first_node, max(v) AS last_node, {collect} AS us
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY axis, line ORDER BY pos) AS isl, pos {div} 8 AS blk
    FROM (SELECT 0 AS axis, a.gi AS line, a.gj AS pos, a.node_id AS u, b.node_id AS v
          FROM fx_nodes a JOIN fx_nodes b ON b.node_id = a.node_id + 1 AND a.gj < 39 WHERE a.p_size % 10 < 8
          UNION ALL
          SELECT 1, a.gj, a.gi, a.node_id, b.node_id FROM fx_nodes a JOIN fx_nodes b ON b.node_id = a.node_id + 40 WHERE a.b % 10 < 7) e) g
  GROUP BY axis, line, isl, blk"""
_WAYS = """
  SELECT r.first_node * 2 + r.axis AS way_id, {append} AS nodes,
    CASE n.b % 12 WHEN 0 THEN 'service' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'unclassified'
      WHEN 5 THEN 'living_street' WHEN 6 THEN 'motorway_link' WHEN 7 THEN 'trunk' ELSE 'residential' END AS highway,
    CASE n.p_size % 4 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN '50;60' END AS maxspeed,
    CASE (r.line + n.b) % 6 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway,
    CASE WHEN n.p_size = 50 THEN 'roundabout' END AS junction,
    CASE WHEN n.p_size % 17 = 0 THEN 'yes' END AS tunnel
  FROM fx_runs r JOIN fx_nodes n ON n.node_id = r.first_node
  UNION ALL
  SELECT 1000000000 + s_suppkey, {pair}, 'residential', NULL, NULL, NULL, NULL
  FROM supplier CROSS JOIN (SELECT count(*) AS n FROM part) c
  WHERE ((s_suppkey * 17) % c.n) % 40 < 39 AND (s_suppkey * 17) % c.n + 1 < c.n AND s_suppkey % 5 = 0"""
_BOUNDS = """
  SELECT area_id, 0 AS ring_id, s.seq, lo0 + s.dx AS lon, la0 + s.dy AS lat
  FROM (SELECT DISTINCT (gi {div} 20) * 2 + gj {div} 20 AS area_id,
      CAST(-22.95 AS DOUBLE) + (gi {div} 20) * CAST(0.020 AS DOUBLE) AS la0, CAST(-43.20 AS DOUBLE) + (gj {div} 20) * CAST(0.020 AS DOUBLE) AS lo0 FROM fx_nodes) a
  CROSS JOIN (VALUES {corners}) s(seq, dx, dy)"""

_DUCK = {"div": "//", "collect": "list(u ORDER BY pos)", "append": "list_append(r.us, r.last_node)", "pair": "[(s_suppkey * 17) % c.n, (s_suppkey * 17) % c.n + 1]", "corners": _CORNERS}
_SPARK = {
    "div": "div", "collect": "transform(array_sort(collect_list(struct(pos, u))), x -> x.u)", "append": "concat(r.us, array(r.last_node))",
    "pair": "array((s_suppkey * 17) % c.n, (s_suppkey * 17) % c.n + 1)", "corners": _CORNERS,
}

#: Common table expressions for DuckDB, without WITH.
SQL = ",\n".join(f"{name} AS ({body.format(**_DUCK)})" for name, body in (("fx_nodes", _NODES), ("fx_runs", _RUNS), ("fx_ways", _WAYS), ("fx_bounds", _BOUNDS)))


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``nodes, ways, boundary_pts`` as the readers of real map data give them."""
    nodes, runs, ways, bounds = (body.format(**_SPARK) for body in (_NODES, _RUNS, _WAYS, _BOUNDS))
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    fx_nodes = spark.sql(nodes.replace("FROM part", "FROM {part}"), part=part)
    fx_runs = spark.sql(runs.replace("fx_nodes", "{n}"), n=fx_nodes)
    text = ways.replace("FROM fx_runs r", "FROM {r} r").replace("JOIN fx_nodes n", "JOIN {n} n").replace("FROM supplier", "FROM {s}").replace("FROM part", "FROM {p}")
    fx_ways = spark.sql(text, r=fx_runs, n=fx_nodes, s=supplier, p=part)
    tags = ("highway", "maxspeed", "oneway", "junction", "tunnel")
    both = ", ".join(f"'{t}', {t}" for t in tags)
    named = f"map_filter(map({both}, 'name', CASE WHEN tunnel IS NOT NULL THEN concat('T', CAST(way_id AS STRING)) END), (k, v) -> v IS NOT NULL)"
    return {
        "nodes": fx_nodes.selectExpr("CAST(node_id AS BIGINT) node_id", "lat", "lon"),
        "ways": fx_ways.selectExpr("CAST(way_id AS BIGINT) way_id", "CAST(nodes AS ARRAY<BIGINT>) nodes", f"{named} tags"),
        "boundary_pts": spark.sql(bounds.replace("FROM fx_nodes", "FROM {n}"), n=fx_nodes).selectExpr("CAST(area_id AS BIGINT) area_id", "ring_id", "seq", "lon", "lat"),
    }
