"""The whole chain on the smallest test tables, with its invariants."""

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def q():
    from wayloom.jobs import registry

    return registry.QUERIES


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_sources_round_trip(spark, q):
    assert q["s1_read_elements"](spark, DATA).groupBy("kind").count().count() == 2
    assert q["s2_read_boundaries"](spark, DATA).count() % 7 == 0


def test_flow_invariants(spark, q):
    assert all(r.equal for r in q["f4_flow_equals_cut"](spark, DATA).collect())
    rows = {(r.area_id, r.unit, r.directed): r.flow for r in q["f9_four_counts"](spark, DATA).collect()}
    for (area, unit, directed), flow in rows.items():
        assert flow <= rows[area, unit, False] and flow <= rows[area, "streets", directed]
    own = {r.area_id: r.flow for r in q["f7_access_flow"](spark, DATA).collect()}
    assert all(own[a] == rows[a, "streets", False] for a in own)


def test_ring_invariants(spark, q):
    assert all(r.within for r in q["f15_flow_bound"](spark, DATA).collect())
    for r in q["f17_drop_decomposition"](spark, DATA).collect():
        assert r.drop is None or r.drop >= 0


def test_rounds_equal_heap(spark, q):
    rows = q["c9_relaxation_check"](spark, DATA).collect()
    assert rows and all(r.nodes == r.equal for r in rows)


def test_greedy_never_falls(spark, q):
    last = {}
    for r in q["d5_greedy_attack"](spark, DATA).orderBy("area_id", "step").collect():
        assert r.source_loss >= last.get(r.area_id, 0.0)
        last[r.area_id] = r.source_loss


def test_matches_duckdb(spark, q):
    import duckdb

    from wayloom.jobs.oracles import ORACLES

    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("p6_projection", "n4_contract_chains", "n5_chain_aggregates", "n7_nodes", "n8_build_stats", "g9_tunnel_gateways", "c4_reach", "c6_hops_from_one", "c7_hops_to_gateways", "g5_gateways", "w1_bridges", "w3_strong_bridges", "w4_strong_articulations", "c3_components", "f6_source_region"):
        want = con.sql(ORACLES[name]).df()
        got = q[name](spark, DATA).toPandas()[list(want.columns)]
        key = list(want.columns)
        assert want.astype(str).sort_values(key).values.tolist() == got.astype(str).sort_values(key).values.tolist(), name


def test_one_fraction_is_not_solved_with_all(spark, q, monkeypatch):
    """Queries of one fraction don't wait for the flows of the others."""
    from wayloom.jobs import registry

    class Asked(Exception):
        pass

    def ends(spark, d, fracs):
        raise Asked(fracs)

    monkeypatch.setattr(registry, "_access_ends", ends)
    for name, fracs in (("f7_access_flow", (registry.FRACTION,)), ("x2_fraction_sweep", registry.FRACTIONS)):
        monkeypatch.setattr(registry, "lone_cuts", lambda spark, d: spark.createDataFrame([], "area_id long, frac double"))
        with pytest.raises(Asked) as got:
            q[name](spark, "/tmp/nowhere")
        assert got.value.args == (fracs,)


def test_batches_of_betweenness_bound_the_disk(spark, monkeypatch):
    """9,000 nodes of one strong core are 81 million rows on the way, which don't go at once."""
    from wayloom.jobs import registry as r

    class Asked(Exception):
        pass

    def asked(g, arcs, sources, batches=1, keep=None):
        raise Asked(batches)

    n = 9000
    own = spark.range(n).selectExpr("0L as area_id", "id as node_id", "id as node", "true as core")
    monkeypatch.setattr(r.bt, "betweenness", asked)
    for name, rows in (("area_parts", own.drop("node")), ("node_keys", own.drop("core")), ("key_arcs", own.selectExpr("node as u", "node as v", "1.0 as w")), ("time_graph", None)):
        monkeypatch.setattr(r.t, name, lambda spark, d, rows=rows: rows)
    with pytest.raises(Asked) as got:
        r.path_shares.__wrapped__(spark, "/tmp/nowhere")
    assert n * n * 128 <= got.value.args[0] * (10 << 30) and got.value.args[0] > 1
