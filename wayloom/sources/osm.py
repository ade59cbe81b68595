"""Map data in the element-list JSON form, area boundaries in GeoJSON, area configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ELEMENTS = """elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, nodes: ARRAY<BIGINT>, tags: MAP<STRING, STRING>>>,
  osm3s STRUCT<timestamp_osm_base: STRING>, generator STRING"""
FEATURE = "geometry STRUCT<type: STRING, coordinates: STRING>, properties MAP<STRING, STRING>"


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of element-list files; ways without points are skipped, absent tags are an empty map."""
    e = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    nodes = e.where("type = 'node'").select(F.col("id").alias("node_id"), "lat", "lon")
    empty = F.create_map().cast("map<string,string>")
    return nodes, e.where("type = 'way' and nodes is not null").select(F.col("id").alias("way_id"), "nodes", F.coalesce("tags", empty).alias("tags"))


def write_elements(nodes: DataFrame, ways: DataFrame, path: str, per_file: int = 5000) -> None:
    """Nodes and ways as element-list files of bounded size."""
    none = F.lit(None)
    n = nodes.select(F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), "lat", "lon", none.cast("array<bigint>").alias("nodes"), none.cast("map<string,string>").alias("tags")).alias("e"))
    w = ways.select(F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), "nodes", "tags").alias("e"))
    part = F.pmod(F.xxhash64("e.type", "e.id"), F.lit(64))
    both = n.union(w).groupBy(part.alias("part"), F.floor(F.pmod(F.col("e.id"), F.lit(per_file * 64)) / per_file).alias("sub"))
    both.agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def read_boundaries(spark: SparkSession, path: str, key: str = "area_id") -> DataFrame:
    """``area_id, ring_id, seq, lon, lat`` of the outer rings of Polygon and MultiPolygon features."""
    f = spark.read.schema(FEATURE).json(path)
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    rings = F.when(F.col("geometry.type") == "MultiPolygon", F.transform(F.from_json("geometry.coordinates", many), lambda p: p[0])).otherwise(
        F.slice(F.from_json("geometry.coordinates", one), 1, 1)
    )
    pts = f.select(F.col("properties")[key].cast("long").alias("area_id"), F.posexplode(rings).alias("ring_id", "ring"))
    pts = pts.select("area_id", "ring_id", F.posexplode("ring").alias("seq", "p"))
    return pts.select("area_id", "ring_id", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def write_boundaries(points: DataFrame, path: str) -> None:
    """A Feature a line, MultiPolygon where an area has many rings."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    rings = points.groupBy("area_id", "ring_id").agg(ring.alias("ring")).groupBy("area_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_id", "ring"))), lambda r: r["ring"]).alias("rings"))
    many = F.size("rings") > 1
    shape = F.when(many, F.to_json(F.transform("rings", lambda r: F.array(r)))).otherwise(F.to_json("rings"))
    kind = F.when(many, "MultiPolygon").otherwise("Polygon")
    text = F.concat(F.lit('{"type":"Feature","properties":{"area_id":"'), F.col("area_id").cast("string"), F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}"))
    rings.select(text.alias("value")).write.text(path)


def area_config(boxes: DataFrame) -> DataFrame:
    """``area_id, key, display_name, s, w, n, e, od_rule``: a configuration row an area."""
    rule = F.element_at(F.array(*map(F.lit, ("corner", "window", "sweep"))), (F.col("area_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("area_"), F.lpad(F.col("area_id").cast("string"), 4, "0"))
    return boxes.select("area_id", name.alias("key"), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("display_name"), "s", "w", "n", "e", rule.alias("od_rule"))
