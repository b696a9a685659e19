"""Networks in many small blocks against plain definitions."""

import random

import pytest

from skeinwork.operators import blocks, leiden, network, structure
from skeinwork.sources.shared import written

from .test_leiden import connected, louvain, planted, quality


def cores_of(arcs):
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        x = min(near, key=lambda x: len(near[x]))
        k = core[x] = max(k, len(near[x]))
        for y in near.pop(x):
            near[y].discard(x)
    return core


def some_arcs(seed, n=60, m=240):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(0, i) for i in range(1, n, 2)} | {(n + i, n + i + 1) for i in range(9)})


def test_core_numbers_over_many_blocks_and_by_joins(spark, monkeypatch):
    arcs = some_arcs(1)
    edges = spark.createDataFrame([(a, b, 1) for a, b in arcs + [(3, 3)]], "a long, b long, w long")
    monkeypatch.setattr(blocks, "LINKS", 50)
    made = []
    whole = blocks.blocked
    monkeypatch.setattr(blocks, "blocked", lambda *a: made.append(whole(*a)) or made[-1])
    assert {r.node: r.core for r in network.k_core(edges, written).collect()} == cores_of(arcs)
    assert made[0][0].count() > 5
    monkeypatch.setattr(blocks, "MOST_NODES", 3)
    assert {r.node: r.core for r in network.k_core(edges, written).collect()} == cores_of(arcs) and len(made) == 1
    monkeypatch.setattr(blocks, "MOST_NODES", 1000)
    with pytest.raises(RuntimeError):
        network.k_core(edges, written, most=1)
    assert network.k_core(edges.limit(0), written).count() == 0


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_communities_over_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "LINKS", size)
    monkeypatch.setattr(leiden, "parted_by_joins", None)
    arcs = planted(7) + [(100, 101, 1), (101, 102, 1)]
    edges = spark.createDataFrame(arcs + [(200, 200, 4), (1, 1, 3)], "a long, b long, w long")
    found = leiden.communities(edges, written, (1.0, 0.3)).collect()
    assert len(found) == len({(x.resolution, x.node) for x in found})
    for r in (1.0, 0.3):
        c = {x.node: x.c for x in found if x.resolution == r}
        assert c.pop(200) == 200 and set(c) == {x for a, b, _ in arcs for x in (a, b)}
        members = {y: [x for x in c if c[x] == y] for y in set(c.values())}
        assert all(y == min(m) and connected(arcs, m) for y, m in members.items())
        assert quality(arcs, c, r) >= quality(arcs, louvain(arcs, r), r) - (1e-9 if size > 40 else 0.02)


@pytest.mark.parametrize("most", [20_000_000, 3])
def test_triangles_over_blocks_and_by_joins(spark, monkeypatch, most):
    arcs = some_arcs(5)
    edges = spark.createDataFrame([(a, b, 1) for a, b in arcs], "a long, b long, w long")
    monkeypatch.setattr(blocks, "LINKS", 50)
    monkeypatch.setattr(blocks, "WEDGES", 7)
    monkeypatch.setattr(blocks, "MOST_NODES", most)
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b, c) for a, b in arcs for c in near[a] & near[b] if c > b}
    assert sorted(tuple(sorted((r.x, r.y, r.z))) for r in network.triangles(edges).collect()) == sorted(want)
    got = {r.node: (r.degree, r.triangles) for r in network.local_clustering(edges).collect()}
    assert got == {x: (len(near[x]), sum(x in t for t in want)) for x in near}
    row = network.transitivity(edges).first()
    assert (row.n_triangles, row.n_triples) == (len(want), sum(len(x) * (len(x) - 1) // 2 for x in near.values()))
    none = network.transitivity(edges.limit(0)).first()
    assert (none.n_triangles, none.n_triples, none.transitivity) == (0, 0, 0)


def test_triads_over_blocks_equal_those_by_joins(spark, monkeypatch):
    rng = random.Random(2)
    edges = spark.createDataFrame(sorted({tuple(rng.sample(range(30), 2)) for _ in range(250)}), "src long, dst long")
    monkeypatch.setattr(blocks, "LINKS", 60)
    census = lambda: {r.triad: r.n for r in structure.triad_census(edges, written).collect()}
    made = []
    whole = blocks.triangles
    monkeypatch.setattr(blocks, "triangles", lambda *a: made.append(a[0].count()) or whole(*a))
    here = census()
    assert made and made[0] > 2
    monkeypatch.setattr(blocks, "MOST_NODES", 3)
    assert census() == here and len(made) == 1 and here["300"] + here["210"] > 0


@pytest.mark.parametrize("m", [240, 1700])
def test_triangles_are_counted_not_listed(spark, monkeypatch, m):
    arcs = some_arcs(3, m=m)
    monkeypatch.setattr(blocks, "LINKS", 50)
    monkeypatch.setattr(blocks, "triangles", None)  # as rows they grow with the cube of the nodes
    near, there = {}, set(arcs)
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    row = network.transitivity(spark.createDataFrame(arcs, "a long, b long")).first()
    assert row.n_triangles == sum(len(near[a] & near[b]) for a, b in there) // 3
    assert row.n_triples == sum(len(x) * (len(x) - 1) // 2 for x in near.values())
    assert network.transitivity(spark.createDataFrame([], "a long, b long")).first().n_triangles == 0


def test_bits_count_what_looking_up_does():
    import numpy as np

    n, rng = 700, np.random.default_rng(1)
    links = np.triu(rng.random((n, n)) < 0.8, 1)
    block = lambda low, high: (low, np.concatenate(([0], np.cumsum(links[low:high].sum(1)))), np.nonzero(links[low:high])[1].astype(np.int32), None)
    square = links.astype(np.int64) @ links.T
    monkey = lambda *a: pytest.fail("looked up")
    kept, blocks.looked_up = blocks.looked_up, monkey
    try:
        assert blocks.counted(n, *block(0, 300), *block(300, 700)) == square[:300, 300:][links[:300, 300:]].sum()
        assert blocks.counted(n, *block(0, 300), *block(0, 300)) == square[:300, :300][links[:300, :300]].sum()
    finally:
        blocks.looked_up = kept
