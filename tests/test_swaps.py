"""Rewiring by joins: degrees stay, no loops or repeats, what mixes, and statistics against plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import leiden, paths, replicates, swaps
from skeinwork.plans import network_queries
from skeinwork.sources.shared import written


def network(seed, n=60, m=200, directed=False):
    rng = np.random.default_rng(seed)
    arcs = {(int(a), int(b)) for a, b in rng.integers(0, n, (3 * m, 2)) if a != b}
    arcs = sorted(arcs if directed else {tuple(sorted(a)) for a in arcs})
    return [arcs[i] for i in rng.choice(len(arcs), m, replace=False)]


def ends(rows, directed):
    out = np.bincount([a for a, _ in rows], minlength=60), np.bincount([b for _, b in rows], minlength=60)
    return [x.tolist() for x in out] if directed else sum(out).tolist()


@pytest.mark.parametrize("directed", [False, True])
def test_degrees_stay_and_edges_mix(spark, directed):
    arcs = network(3, directed=directed)
    edges = spark.createDataFrame(arcs, "a long, b long")
    copies, done = swaps.swapped(edges, 4, written, directed)
    by = {}
    for r in copies.collect():
        by.setdefault(r["copy"], []).append((r.a, r.b))
    assert set(by) == set(range(4)) and len({tuple(sorted(x)) for x in by.values()}) == 4
    for rows in by.values():
        assert len(set(rows)) == len(rows) == len(arcs) and all(a != b and (directed or a < b) for a, b in rows)
        assert ends(rows, directed) == ends(arcs, directed)
    assert all(k >= 0.5 for _, k in done) and all(r.kept < 0.5 for r in swaps.kept_share(edges, copies).collect())


def test_statistics_equal_those_of_a_task(spark):
    edges = spark.createDataFrame([(i, a, b) for i in range(3) for a, b in network(i)], "copy int, a long, b long")
    got = {r.replicate: r for r in swaps.copies_statistics(edges).collect()}
    for i in range(3):
        a, b = (np.array(x) for x in zip(*network(i), strict=True))
        assert got[i].transitivity == pytest.approx(replicates.small_transitivity(a, b)) and got[i].assortativity == pytest.approx(replicates.small_assortativity(a, b))


def test_nulls_of_both_forms_agree(spark, monkeypatch):
    edges = spark.createDataFrame(network(5), "a long, b long")
    tasks = replicates.rewired_null(edges, 40, written).toPandas()
    monkeypatch.setattr(replicates, "IN_A_TASK", 10)
    joins = replicates.rewired_null(edges, 40, written).toPandas()
    assert len(tasks) == len(joins) == 40
    for k in ("transitivity", "assortativity"):
        assert abs(tasks[k].mean() - joins[k].mean()) < 1.2 * tasks[k].std() and 0.5 < joins[k].std() / tasks[k].std() < 2


def test_networks_that_cannot_be_rewired(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")
    copies, done = swaps.swapped(star, 2, written, rounds=3)
    assert {(r.a, r.b) for r in copies.collect()} == {(0, i) for i in range(1, 6)} and done == [(0, 0.0), (1, 0.0)]
    none, _ = swaps.swapped(star.limit(0), 2, written)
    assert none.count() == 0 and swaps.copies_statistics(none).count() == 0
    assert swaps.kept_share(star, copies).where(F.col("kept") < 1).count() == 0


def test_copies_over_arrays_equal_a_plain_count(spark, monkeypatch):
    """Larger networks once went by rounds of joins over all copies."""
    edges = network(5)
    n = max(map(max, edges)) + 1
    keys = np.sort(np.array([a * n + b for a, b in edges]))
    degrees = lambda k: np.bincount(np.concatenate((k // n, k % n)), minlength=n).tolist()
    for marks in (0, 1000):
        monkeypatch.setattr(replicates, "MARKS", marks)
        monkeypatch.setattr(replicates, "LINKS_AT_ONCE", 7)
        for i in range(5):
            new = replicates.swapped_at_once(keys, n, np.random.default_rng(i))
            assert degrees(new) == degrees(keys) and (np.diff(new) > 0).all() and (new // n < new % n).all() and np.isin(new, keys).mean() < 0.5
            x, y = new // n, new % n
            assert replicates.array_statistics(new, n) == pytest.approx((replicates.small_transitivity(x, y), replicates.small_assortativity(x, y)))
    star = np.arange(1, 6)
    assert (replicates.swapped_at_once(star, 6, np.random.default_rng(1)) == star).all() and replicates.array_statistics(star[:0], 6) == (0.0, 0.0)
    monkeypatch.setattr(replicates, "IN_A_TASK", 10)
    monkeypatch.setattr(replicates.swaps, "swapped", None)
    assert replicates.rewired_null(spark.createDataFrame(edges, "a long, b long"), 3, written).count() == 3


def test_directed_copies_mix_however_many_links(spark, monkeypatch):
    """No more than 40,000 swaps were made, which left two of three of so many links as they were; more than MOST_EDGES links were refused."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 5000, 210_000) * 5000 + rng.integers(0, 5000, 210_000))
    a, b = (x[keys // 5000 != keys % 5000] for x in (keys // 5000, keys % 5000))
    x, y = replicates.directed_swaps(a, b, 1)
    assert np.isin(x * 5000 + y, keys).mean() < 0.2
    arcs = [tuple(map(int, rng.choice(30, 2))) for _ in range(150)]
    edges = spark.createDataFrame(arcs, "src long, dst long")
    monkeypatch.setattr(replicates, "MOST_EDGES", 3)
    one = {r.replicate: r.reciprocity for r in replicates.reciprocity_null(edges, 20).collect()}
    monkeypatch.setattr(replicates, "IN_A_TASK", 10)
    monkeypatch.setattr(replicates, "PAIRS_AT_ONCE", 16)
    other = {r.replicate: r.reciprocity for r in replicates.reciprocity_null(edges, 20).collect()}
    assert set(one) == set(other) == set(range(20)) and len(set(one.values())) > 3
    monkeypatch.setattr(replicates, "PAIRS_AT_ONCE", 1 << 21)
    assert one == {r.replicate: r.reciprocity for r in replicates.reciprocity_null(edges, 20).collect()}


def test_large_networks_get_as_many_copies(spark, monkeypatch):
    """Beyond 40,000 edges there were 25."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 3000, 90_000) * 3000 + rng.integers(0, 3000, 90_000))
    keys = keys[keys // 3000 < keys % 3000][:41_000]
    edges = spark.createDataFrame([(int(k // 3000), int(k % 3000), 1) for k in keys], "a long, b long, w long")
    monkeypatch.setattr(network_queries, "graph", lambda s, d: edges)
    assert len(keys) == 41_000 and [r.n_samples for r in network_queries.rewired(spark, None, 30).collect()] == [30, 30]


def test_communities_of_copies_of_networks_of_any_size(spark, monkeypatch):
    """Copies got 40,000 swaps at most, and more than MOST_EDGES edges were refused."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 4000, 420_000) * 4000 + rng.integers(0, 4000, 420_000))
    keys = keys[keys // 4000 < keys % 4000]
    x, y = replicates.rewired(keys // 4000, keys % 4000, 1)
    assert len(keys) > 200_000 and np.isin(x * 4000 + y, keys).mean() < 0.2
    monkeypatch.setattr(replicates, "LINKS_AT_ONCE", 50_000)
    starts, others = replicates.both_ways(keys, 4000)
    rows = replicates.rows_of(np.concatenate((keys // 4000, keys % 4000)), np.concatenate((keys % 4000, keys // 4000)), 4000)
    assert (starts == rows[0]).all() and all((others[starts[i] : starts[i + 1]] == np.sort(rows[1][starts[i] : starts[i + 1]])).all() for i in range(4000))
    arcs = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.7 if a // 10 == b // 10 else 0.05)]
    near = replicates.both_ways(np.sort(np.array([a * 60 + b for a, b in arcs])), 60)
    label = leiden.parted_in_task(*near, np.ones(2 * len(arcs)))
    assert all(len(set(label[i : i + 10])) == 1 for i in range(0, 60, 10)) and len(set(label)) == 6
    monkeypatch.setattr(replicates, "MOST_EDGES", 3)
    monkeypatch.setattr(replicates, "IN_A_TASK", 3)
    seen, null = replicates.modularity_null(spark.createDataFrame(arcs, "a long, b long"), 8)
    inside = sum(a // 10 == b // 10 for a, b in arcs) / len(arcs)
    strength = np.bincount(np.array(arcs).ravel() // 10) / (2 * len(arcs))
    assert seen == pytest.approx(inside - (strength**2).sum()) and null.count() == 8 and all(r.modularity < seen - 0.2 for r in null.collect())


def test_betweenness_sends_no_network_through_the_driver(spark, monkeypatch):
    """It did, and more than 5,000,000 edges went by joins, with a row for each source and node."""
    edges = spark.createDataFrame(network(6), "a long, b long")
    arcs = spark.createDataFrame(network(6, directed=True), "a long, b long")
    want = [sorted(map(tuple, paths.betweenness(x, written, directed=d).collect())) for x, d in ((edges, False), (arcs, True))]
    for name, value in (("IN_A_TASK", 3), ("LINKS_AT_ONCE", 50)):
        monkeypatch.setattr(replicates, name, value)
    monkeypatch.setattr(type(edges), "toArrow", None)
    for (x, d), rows in zip(((edges, False), (arcs, True)), want, strict=True):
        got = sorted(map(tuple, replicates.betweenness(x, directed=d, keep=written).collect()))
        assert [r[0] for r in got] == [r[0] for r in rows] and [r[1] for r in got] == pytest.approx([r[1] for r in rows], abs=2e-9)
