"""Runs per-area graph work in parallel: one row a scenario, the area's graph shipped once a chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayloom.functions import graphs as gr
from wayloom.session import find_package

GRAPH = "area_id long, kind int, u long, v long, t double, key long, flags long"


def graph_rows(nodes: DataFrame, arcs: DataFrame, streets: DataFrame, flags: str = "flags", node_t: str | None = None) -> DataFrame:
    """Nodes, arcs and streets of areas as one table."""
    null = F.lit(None)
    return (
        nodes.select("area_id", F.lit(gr.NODE).alias("kind"), F.col("node_id").alias("u"), null.cast("long").alias("v"), (F.col(node_t) if node_t else null).cast("double").alias("t"), null.cast("long").alias("key"), F.col(flags).cast("long").alias("flags"))
        .union(arcs.select("area_id", F.lit(gr.ARC), "u", "v", "time_s", "street_id", null.cast("long")))
        .union(streets.select("area_id", F.lit(gr.STREET), "u", "v", "length_m", "street_id", null.cast("long")))
    )


def per_area(graph: DataFrame, fn: Callable[[gr.AreaGraph], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``fn`` for each area's graph, under ``area_id``."""
    find_package(graph.sparkSession)
    cols = ["area_id", *[c.split()[0] for c in schema.split(",")]]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in fn(gr.AreaGraph(rows))], columns=cols)

    return graph.groupBy("area_id").applyInPandas(run, f"area_id long, {schema}")


def per_scenario(graph: DataFrame, scenarios: DataFrame, fn: Callable[[gr.AreaGraph, pd.DataFrame], Iterable[tuple]], schema: str, chunk: int = 64, number: str = "scenario") -> DataFrame:
    """Rows of ``fn`` for each area's graph and a chunk of its scenarios, numbered in ``number``."""
    find_package(graph.sparkSession)
    cols = ["area_id", *[c.split()[0] for c in schema.split(",")]]
    cells = scenarios.withColumn("chunk", F.floor(F.col(number) / chunk))
    shipped = graph.join(cells.select("area_id", "chunk").distinct(), "area_id").withColumnsRenamed({"area_id": "g_area", "chunk": "g_chunk"})

    def run(key: tuple, rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(some):
            return pd.DataFrame([], columns=cols)
        return pd.DataFrame([(key[0], *r) for r in fn(gr.AreaGraph(rows), some.sort_values(number, kind="stable"))], columns=cols)

    return shipped.groupBy("g_area", "g_chunk").cogroup(cells.groupBy("area_id", "chunk")).applyInPandas(run, f"area_id long, {schema}")
