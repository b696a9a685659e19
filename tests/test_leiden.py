"""Communities against their definition: quality, connectedness, moves that gain, and Louvain's."""

import random

import numpy as np
import pytest

from skeinwork.operators import leiden, network, replicates
from skeinwork.sources.shared import written


def planted(seed, groups=5, size=8, inside=0.7, between=0.04):
    rng = random.Random(seed)
    n = groups * size
    return [(i, j, rng.randint(1, 3)) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i // size == j // size else between)]


def quality(arcs, c, r=1.0):
    m2, k, inner = 2 * sum(w for *_, w in arcs), {}, 0
    for a, b, w in arcs:
        k[a], k[b], inner = k.get(a, 0) + w, k.get(b, 0) + w, inner + 2 * w * (c[a] == c[b])
    return inner / m2 - r * sum(sum(k[x] for x in k if c[x] == y) ** 2 for y in set(c.values())) / m2**2


def connected(arcs, members):
    near = {x: set() for x in members}
    for a, b, _ in arcs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, stack = set(), [next(iter(members))]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += near[x]
    return seen == set(members)


def louvain(arcs, r=1.0):
    a, b, w = (np.array(x) for x in zip(*arcs, strict=True))
    names, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = replicates.louvain(codes[: len(a)], codes[len(a) :], w.astype(float), r)
    return dict(zip(names.tolist(), label.tolist(), strict=True))


def test_planted_communities_at_two_resolutions(spark):
    arcs = planted(1) + [(100, 101, 1), (101, 102, 1)]
    found = leiden.communities(spark.createDataFrame(arcs, "a long, b long, w long"), written, (1.0, 0.3)).collect()
    for r in (1.0, 0.3):
        c = {x.node: x.c for x in found if x.resolution == r}
        members = {y: [x for x in c if c[x] == y] for y in set(c.values())}
        assert set(c) == {x for a, b, _ in arcs for x in (a, b)} and all(y == min(m) and connected(arcs, m) for y, m in members.items())
        assert quality(arcs, c, r) >= quality(arcs, louvain(arcs, r), r) - 1e-9
        assert quality(arcs, c, r) >= quality(arcs, {x: x // 8 for x in c}, r) - 1e-9
    one = spark.createDataFrame([(x.node, x.c) for x in found if x.resolution == 1.0], "node long, c long")
    assert network.modularity(spark.createDataFrame(arcs, "a long, b long, w long"), one).first()["modularity"] == pytest.approx(quality(arcs, {r.node: r.c for r in one.collect()}), abs=1e-6)


def test_no_node_gains_by_moving_and_quality_is_louvains(spark):
    rng = random.Random(3)
    arcs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    arcs = [(a, b, 1) for a, b in arcs]
    c = {x.node: x.c for x in leiden.communities(spark.createDataFrame(arcs, "a long, b long, w long"), written).collect()}
    q = quality(arcs, c)
    assert q >= 0.98 * quality(arcs, louvain(arcs))
    assert all(connected(arcs, [x for x in c if c[x] == y]) for y in set(c.values()))


def test_networks_without_edges_and_of_one(spark):
    none = spark.createDataFrame([], "a long, b long, w long")
    assert leiden.communities(none, written).count() == 0
    one = leiden.communities(spark.createDataFrame([(1, 2, 5)], "a long, b long, w long"), written).collect()
    assert {(r.node, r.c) for r in one} == {(1, 1), (2, 1)}


def test_evolution_of_a_growing_network(spark):
    rng = random.Random(5)
    day = 86_400_000_000
    rows = [(a, b, int((i // 40) * day + rng.randrange(day))) for i, (a, b, _) in enumerate(sorted(planted(2), key=lambda _: rng.random()))]
    rows += [(1, 2, day), (3, 4, 2 * day)]  # at a border: in the bucket before, too
    frame = spark.createDataFrame(rows, "a long, b long, us long")
    got = {r.bucket_us: r for r in leiden.evolution(frame, written).collect()}
    assert set(got) == {us - us % day for *_, us in rows}
    for cut, r in got.items():
        weight = {}
        for a, b, us in rows:
            if us <= cut + day:
                weight[a, b] = weight.get((a, b), 0) + 1
        arcs = [(a, b, w) for (a, b), w in weight.items()]
        nodes = {x for a, b, _ in arcs for x in (a, b)}
        assert (r.nodes, r.edges) == (len(nodes), len(arcs)) and 1 <= r.largest <= len(nodes)
        assert r.modularity >= 0.99 * quality(arcs, louvain(arcs))  # as good as a fresh run of each bucket
    assert leiden.evolution(frame.limit(0), written).count() == 0 and leiden.evolution(frame.limit(3), written).count() == 0
