import pytest

from skeinwork.operators import network
from skeinwork.plans import network_queries, registry
from skeinwork.sources.tables import event_log

from .oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


NULLS = {"rewired_null": 200, "permuted_exposure": 5000, "poisson_null": 200, "share_null": 2000, "reciprocity_null": 200, "partition_null": 200}


@pytest.mark.parametrize("name", sorted(NULLS))
def test_nulls_are_comparisons(spark, name):
    for r in registry.QUERIES[name](spark, SF).collect():
        assert r.n_samples == NULLS[name] and 1 / (r.n_samples + 1) <= r.p_value <= 1
        assert r.null_std == 0 or abs(r.z_score - (r.observed - r.null_mean) / r.null_std) < 1e-9


def undirected(spark):
    near: dict = {}
    for r in network_queries.graph(spark, SF).collect():
        near.setdefault(r.a, {})[r.b] = r.w
        near.setdefault(r.b, {})[r.a] = r.w
    return near


def test_k_core_equals_peeling(spark):
    left, core, k = {u: set(v) for u, v in undirected(spark).items()}, {}, 0
    while left:
        k = max(k, min(map(len, left.values())))
        gone = {u for u, v in left.items() if len(v) <= k}
        core |= dict.fromkeys(gone, k)
        left = {u: v - gone for u, v in left.items() if u not in gone}
    assert {r.node: r.core for r in registry.QUERIES["k_core"](spark, SF).collect()} == core


def test_communities_are_better_than_none(spark):
    g, found = network_queries.graph(spark, SF), registry.QUERIES["communities"](spark, SF)
    assert {r.node for r in found.collect()} == set(undirected(spark))
    best = network.modularity(g, found.select("node", "c")).first()["modularity"]
    alone = network.modularity(g, found.selectExpr("node", "node as c")).first()["modularity"]
    assert best > max(0, alone)
    sweep = {r.resolution: r for r in registry.QUERIES["community_profile"](spark, SF).collect()}
    assert abs(sweep[1.0].modularity - best) < 1e-6 and sweep[1.0].in_task is not None and sweep[0.5].n_communities <= sweep[2.0].n_communities and 0 < sweep[1.0].p_value <= 1
    assert {r.resolution for r in registry.QUERIES["community_sweep"](spark, SF).collect()} == {0.5, 1.0, 1.5, 2.0}


def test_evolution_ends_with_the_whole_network(spark):
    last = max(registry.QUERIES["community_evolution"](spark, SF).collect(), key=lambda r: r.bucket_us)
    assert (last.nodes, last.edges) == (len(undirected(spark)), sum(map(len, undirected(spark).values())) // 2)


def test_centralities_agree_with_their_parts(spark):
    rows = {r.node: r for r in registry.QUERIES["centrality_table"](spark, SF).collect()}
    near = undirected(spark)
    assert set(rows) == set(near) and abs(sum(r.pagerank for r in rows.values()) - 1) < 1e-5 and all(r.betweenness_exact for r in rows.values())
    assert abs(sum(r.eigenvector**2 for r in rows.values() if r.eigenvector) - 1) < 1e-5
    sampled = {r.node: r.betweenness for r in registry.QUERIES["betweenness_sampled"](spark, SF).collect()}
    exact = {r.node: r.betweenness for r in registry.QUERIES["betweenness_exact"](spark, SF).collect()}
    assert sampled == exact  # fewer nodes than sources


def test_break_of_cores_and_verdicts(spark):
    assert {r.era for r in registry.QUERIES["structural_break_cores"](spark, SF).collect()} == {"before", "after"}
    r = registry.QUERIES["power_law_verdict"](spark, SF).first()
    assert r.preferred in ("power_law", "lognormal", "indistinguishable") and 0 <= r.p_value <= 1
    tests, places = registry.QUERIES["exposure_tests"](spark, SF).collect(), event_log(spark, SF).where("kind = 'save'").select("place").distinct().count()
    assert len(tests) == places and all((r.adopters < 10) == (r.verdict == "insufficient_adopters") == (r.exposed_p is None) for r in tests)
    assert {r.test for r in registry.QUERIES["test_p_values"](spark, SF).collect()} == {"mann_whitney", "wilcoxon", "spearman"}


def test_layers_agree_with_their_parts(spark):
    rows = {r.layer: r for r in registry.QUERIES["layer_report"](spark, SF).collect()}
    one, three = registry.QUERIES["graph_describe"](spark, SF).first(), registry.QUERIES["triangles_transitivity"](spark, SF).first()
    assert (rows["handoff"].nodes, rows["handoff"].edges, rows["handoff"].transitivity) == (one.n_nodes, one.n_edges, three.transitivity)
    assert rows["two kinds"].transitivity == 0 and rows["two kinds"].reciprocity is None and (rows["two kinds"].null_copies, rows["handoff"].null_copies) == (10, 200)


def test_every_place_has_a_fit_or_says_why(spark):
    rows = registry.QUERIES["logistic_fit"](spark, SF).collect()
    assert {r.fit for r in rows} <= {"logistic", "insufficient_data"} and len(rows) == 99
    assert all((r.top is None) == (r.fit != "logistic") and (r.r2 is None or r.r2 <= 1) for r in rows)


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
