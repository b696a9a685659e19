"""Strong components against plain reach, and on long paths and cycles; limits that raise."""

import random

import pytest

from skeinwork.operators import network, strong
from skeinwork.sources.shared import written


def plain(arcs):
    """Roots by Kosaraju's two passes, without recursion."""
    ahead, back = {}, {}
    for u, v in arcs:
        for x in (u, v):
            ahead.setdefault(x, [])
            back.setdefault(x, [])
        ahead[u].append(v)
        back[v].append(u)
    order, seen = [], set()
    for s in ahead:
        stack = [(s, iter(ahead[s]))] if s not in seen else []
        seen.add(s)
        while stack:
            x, it = stack[-1]
            if (y := next((y for y in it if y not in seen), None)) is None:
                order.append(x)
                stack.pop()
            else:
                seen.add(y)
                stack.append((y, iter(ahead[y])))
    root, out = {}, {}
    for s in reversed(order):
        if s in root:
            continue
        root[s], stack = s, [s]
        while stack:
            x = stack.pop()
            for y in back[x]:
                if y not in root:
                    root[y] = s
                    stack.append(y)
    for x, s in root.items():
        out[s] = min(x, out.get(s, x))
    return {x: out[s] for x, s in root.items()}


def found(spark, arcs, **more):
    return {r.node: r.root for r in strong.strong_components(spark.createDataFrame(list(arcs), "src long, dst long"), written, **more).collect()}


@pytest.mark.parametrize("seed, n, m", [(1, 12, 14), (2, 30, 40), (3, 40, 100), (4, 25, 25), (5, 60, 66)])
def test_random_digraphs(spark, seed, n, m):
    rng = random.Random(seed)
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    assert found(spark, arcs) == plain(arcs)


def test_chains_that_loop_back(spark):
    ring = [(i, i + 1) for i in range(20, 30)] + [(30, 20)]
    tails = [(1, 2), (2, 20), (25, 50), (50, 51), (51, 27), (51, 60), (60, 61), (27, 70), (70, 71), (71, 72), (72, 70), (9, 9)]
    ladder = [(100 + i, 101 + i) for i in range(12)] + [(112, 106), (106, 103)]
    assert found(spark, ring + tails + ladder) == plain(ring + tails + ladder)


def test_long_cycles_and_paths_take_few_rounds(spark):
    from pyspark.sql import functions as F

    n, calls = 100_000, []
    keep = lambda df, name: calls.append(name) or written(df, name)
    ids = spark.range(n)
    spin = ids.select(F.col("id").alias("src"), ((F.col("id") * 7919 + 13) % n).alias("dst"))  # a permutation: cycles only
    line = ids.select((F.col("id") + n).alias("src"), (F.col("id") + n + 1).alias("dst"))
    ring = ids.select((F.col("id") + 3 * n).alias("src"), ((F.col("id") + 1) % n + 3 * n).alias("dst"))
    got = strong.strong_components(spin.unionByName(line).unionByName(ring), keep)
    sizes = {r.root: r.k for r in got.groupBy("root").agg(F.count("*").alias("k")).where("root < 100000 or k > 1").collect()}
    seen, want = set(), {}
    for x in range(n):
        if x not in seen:
            own, y = [], x
            while y not in seen:
                seen.add(y)
                own.append(y)
                y = (y * 7919 + 13) % n
            want[min(own)] = len(own)
    assert sizes == want | {3 * n: n} and got.count() == 3 * n + 1 and len(calls) < 60


def test_limits_raise(spark):
    pairs = [(2 * i, 2 * i + 1) for i in range(12)] + [(2 * i + k, 2 * i + 2 + k) for i in range(11) for k in (0, 1)]
    grid = pairs + [(v, u) for u, v in pairs]  # every node branches both ways
    assert set(found(spark, grid).values()) == {0}
    with pytest.raises(RuntimeError):
        found(spark, grid, most=3)
    path = spark.createDataFrame([(i, i + 1, 1) for i in range(9)], "a long, b long, w long")
    assert network.bfs(path, 0, written, most=9).count() == 10
    with pytest.raises(RuntimeError):
        network.bfs(path, 0, written, most=8)
    with pytest.raises(RuntimeError):
        network.k_core(path, written, most=2)
