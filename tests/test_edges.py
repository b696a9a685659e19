"""Edge cases on hand-built rows, and small brute-force versions of what SQL can't say."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import ranks, text
from skeinwork.operators import activity, components, handoff, network, replicates, survival
from skeinwork.sources.shared import written

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), a, p, k, 1.0) for i, (s, a, p, k) in enumerate(rows)], "id long, ts timestamp, actor long, place string, kind string, value double")


def test_handoff_window_is_inclusive_and_drops_self_pairs(spark):
    events = log(spark, [(0, 1, "x", "save"), (0, 1, "x", "save"), (21600, 2, "x", "save"), (43201, 3, "x", "save")])
    got = handoff.handoff_pairs(events).select("source", "target").collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_sessions_break_only_beyond_the_gap(spark):
    events = log(spark, [(0, 1, "x", "save"), (7199, 1, "x", "save"), (14399, 1, "x", "save"), (21600, 1, "x", "save")])
    assert [r.session for r in activity.sessions(events, "actor", 7200).orderBy("id").collect()] == [0, 0, 0, 1]


def test_rewrites_are_strictly_later(spark):
    events = log(spark, [(0, 1, "x", "delete"), (0, 2, "x", "save"), (1, 3, "x", "save"), (5, 1, "y", "delete")])
    assert [(r.place, r.actor, r.latency_us) for r in survival.rewrites(events).collect()] == [("x", 3, 1_000_000)]


def test_series_is_dense_and_conserved(spark):
    events = log(spark, [(0, 1, "x", "probe"), (86400 * 3, 1, "x", "save"), (86400 * 5, 2, "x", "delete")])
    dense = activity.series(events, "day")
    assert dense.count() == 6
    assert activity.conserved(events, dense).first().saves == 1


def test_jaccard_of_short_and_empty_texts(spark):
    rows = spark.createDataFrame([("", ""), ("a b", "a b"), ("a b c d e f", "a b c d e g"), (None, "")], "x string, y string")
    assert [r[0] for r in rows.select(text.jaccard(text.shingles(F.col("x")), text.shingles(F.col("y")))).collect()] == [1.0, 1.0, 1 / 3, 1.0]


def test_hosts_are_decoded(spark):
    rows = spark.createDataFrame([("a%2eb.example.com",), ("a&#46;b.example.com",), ("www.x.org_6000",)], "h string")
    assert [r[0] for r in rows.select(text.plain_host(text.unescaped(F.col("h"), True))).collect()] == ["a.b.example.com", "a.b.example.com", "x.org"]


def test_small_distributions():
    assert ranks.wilcoxon_exact_tail(5, 15) == 1 / 32
    assert abs(ranks.t_tail(2.228, 10) - 0.05) < 1e-3
    assert abs(ranks.normal_tail(1.959964) - 0.025) < 1e-6


def test_null_comparison_without_spread(spark):
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    row = ranks.compare_to_null(same, "v", 1.0).first()
    assert (row.z_score, row.p_value) == (0.0, 1.0)


def random_graph(spark, n=12, p=0.3, seed=3):
    rng = np.random.default_rng(seed)
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]
    return pairs, spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w long")


def test_components_equal_union_find(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (7, 4)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), written).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 4, 8: 4, 7: 4, 4: 4}


def test_k_core_equals_peeling(spark):
    pairs, edges = random_graph(spark, 8, 0.5)
    got = {r.node: r.core for r in network.k_core(edges, written).collect()}
    left, want, k = list(pairs), {}, 1
    nodes = {x for e in pairs for x in e}
    while nodes:
        deg = {x: sum(x in e for e in left) for x in nodes}
        weak = {x for x in nodes if deg[x] <= k}
        if weak:
            want |= dict.fromkeys(weak, k)
            nodes -= weak
            left = [e for e in left if not weak & set(e)]
        else:
            k += 1
    assert got == want


def test_betweenness_equals_counting_paths(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (1, 3, 1)], "a long, b long, w long")
    got = {r.node: round(r.betweenness, 4) for r in replicates.betweenness(edges).collect()}
    assert got == {0: 0.0, 1: round(2 / 3, 4), 2: 0.0, 3: 0.0}


def test_rewiring_keeps_degrees_and_louvain_finds_cliques():
    a, b = map(np.array, zip(*itertools.combinations(range(6), 2), strict=True))
    a, b = np.append(a[:9], [6, 7]), np.append(b[:9], [7, 8])
    x, y = replicates.rewired(a, b, 5)
    assert (np.bincount(np.append(x, y)) == np.bincount(np.append(a, b))).all()
    cliques = [(i, j) for c in (0, 5) for i, j in itertools.combinations(range(c, c + 5), 2)] + [(4, 5)]
    u, v = map(np.array, zip(*cliques, strict=True))
    own = replicates.louvain(u, v, np.ones(len(u)))
    assert len(set(own[:5])) == len(set(own[5:])) == 1 and own[0] != own[5]


@pytest.mark.parametrize("rate", [0.2])
def test_logistic_fit(spark, rate):
    rows = [("x", int(h * 3.6e9), float(100 / (1 + np.exp(-rate * (h - 30))))) for h in range(80)]
    got = replicates.fit_logistic(spark.createDataFrame(rows, "item string, hour_us long, adopters double"), "item").first()
    assert abs(got["top"] - 100) < 1 and abs(got.rate - rate) < 0.01 and got.r2 > 0.999


def test_windows_share_one_row_for_each_two_actors(spark, monkeypatch):
    """Rows once grew with the number of windows."""
    rows, whole = [], handoff.written
    monkeypatch.setattr(handoff, "written", lambda df, name: rows.append(whole(df, name)) or rows[-1])
    log = [(i, 1000 * i, "abac"[i % 4], "p") for i in range(40)]
    events = spark.createDataFrame(log, "id long, s long, actor string, place string").select("id", F.timestamp_seconds("s").alias("ts"), "actor", "place")
    got = {r.window: (r.n_events, r.n_edges, r.n_nodes, r.reciprocity) for r in handoff.sensitivity(events, {"none": 10, "short": 1000, "long": 5000, "inf": None}).collect()}
    assert got == {k: (39, 4, 3, 1.0) for k in ("short", "long", "inf")}
    assert {(r.lo, r.hi) for r in rows[0].collect()} == {("a", "b"), ("a", "c")} and rows[0].count() == 2
