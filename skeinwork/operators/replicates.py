"""Graph algorithms over arrays and resampling, one replicate or one source a row: each task computes its rows in numpy from (seed, replicate),
so results don't hang on partitions."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import swaps


def null_budget(n_edges: int, bipartite: bool, requested: int) -> int:
    """How many rewired copies a layer gets: 10 at most for two-kind or projected layers, 25 beyond 40,000 edges."""
    return min(requested, 10 if bipartite else 25 if n_edges > 40_000 else requested)


def over_rows(spark, n: int, schema: str, f) -> DataFrame:
    """f(i) for i from 0 to n - 1, one row each."""
    import pandas as pd

    names = [x.split()[0] for x in schema.split(",")]
    run = lambda batches: (pd.DataFrame([f(int(i)) for i in b["id"]], columns=names) for b in batches)
    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(run, schema)


def rewired(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-edge swaps, as many as there are edges, that keep all degrees and make neither loops nor repeated edges (see swapped_at_once)."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 1
    keys = np.sort(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
    keys = swapped_at_once(keys, n, np.random.default_rng(seed))
    return keys // n, keys % n


def small_transitivity(a: np.ndarray, b: np.ndarray) -> float:
    near: dict[int, set[int]] = {}
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    closed = sum(len(near[u] & near[v]) for u, v in zip(a.tolist(), b.tolist(), strict=True))
    triples = sum(len(n) * (len(n) - 1) // 2 for n in near.values())
    return closed / triples if triples else 0.0


def small_assortativity(a: np.ndarray, b: np.ndarray) -> float:
    d = np.bincount(np.concatenate((a, b)))
    x, y = np.concatenate((d[a], d[b])), np.concatenate((d[b], d[a]))
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 else 0.0


#: Edges up to which a network is sent to tasks as a broadcast value; larger ones go by an exchange, and by joins beyond MOST_EDGES.
IN_A_TASK, MOST_EDGES = 200_000, 40_000_000
#: Pairs of links that are swapped together, about.
PAIRS_AT_ONCE = 1 << 21


def swapped_at_once(keys: np.ndarray, n: int, rng: np.random.Generator, per_edge: float = 1.0, rounds: int = 40, directed: bool = False) -> np.ndarray:
    """keys: u * n + v of distinct links (u < v unless directed), sorted. The same after double-edge swaps, as many as there are links (or as can be
    made in so many rounds). In a round all links are in random pairs, PAIRS_AT_ONCE of which are swapped together; a swap that would make
    a loop, a link that is there, or one that another swap makes too is not done. Degrees stay, of directed links those of both kinds."""
    m, done, keys = len(keys), 0, keys.copy()
    order = np.arange(m, dtype=np.int32 if m < 1 << 31 else np.int64)
    for _ in range(rounds):
        if m < 2 or done >= per_edge * m:
            break
        rng.shuffle(order)
        for low in range(0, m // 2, PAIRS_AT_ONCE):
            if done >= per_edge * m:
                break
            p, q = order[2 * low : min(2 * (low + PAIRS_AT_ONCE), m // 2 * 2)].reshape(-1, 2).T
            (u, v), (s, t) = np.divmod(keys[p], n), np.divmod(keys[q], n)
            if directed:
                first, second = u * n + t, s * n + v
            else:
                turn = rng.random(len(p)) < 0.5
                s, t = np.where(turn, t, s), np.where(turn, s, t)
                first, second = np.minimum(u, t) * n + np.maximum(u, t), np.minimum(s, v) * n + np.maximum(s, v)
            good = np.flatnonzero((u != t) & (s != v) & (first != second))
            p, q, wish = p[good], q[good], np.concatenate((first[good], second[good]))
            at = np.argsort(wish)
            there = wish[at]
            bad = keys[np.minimum(np.searchsorted(keys, there), m - 1)] == there
            twice = there[1:] == there[:-1]
            bad[1:] |= twice
            bad[:-1] |= twice
            free = np.empty(len(wish), bool)
            free[at] = ~bad
            good = np.flatnonzero(free[: len(p)] & free[len(p) :])
            keys[p[good]], keys[q[good]] = wish[good], wish[len(p) + good]
            keys.sort()
            done += len(good)
    return keys


#: Bytes of marks: a byte for each node, for as many nodes at once as go in.
MARKS = 4 << 20


def array_statistics(keys: np.ndarray, n: int) -> tuple[float, float]:
    """Transitivity and degree assortativity of such links. Links point to the end of higher degree. For some nodes at a time it is marked where
    their links lead, and the ends of the links from there are looked up among the marks, some LINKS_AT_ONCE together."""
    m = len(keys)
    if not m:
        return 0.0, 0.0
    parts, d = range(0, m, LINKS_AT_ONCE), np.zeros(n, np.int64)
    ends = lambda i: (keys[i : i + LINKS_AT_ONCE] // n, keys[i : i + LINKS_AT_ONCE] % n)
    for i in parts:
        for x in ends(i):
            np.add.at(d, x, 1)
    place = np.empty(n, np.int64)
    place[np.argsort(d, kind="stable")] = np.arange(n)
    arcs, s, ss, xy, k = np.empty(m, np.int64), 0.0, 0.0, 0.0, 2.0 * m
    for i in parts:
        a, b = ends(i)
        da, db = d[a].astype(float), d[b].astype(float)
        s, ss, xy = s + float((da + db).sum()), ss + float((da * da + db * db).sum()), xy + float(2 * (da * db).sum())
        arcs[i : i + len(a)] = np.minimum(place[a], place[b]) * n + np.maximum(place[a], place[b])
    arcs.sort()
    starts, y = np.searchsorted(arcs, np.arange(n + 1) * n), np.empty(m, np.int32)
    for i in parts:
        y[i : i + LINKS_AT_ONCE] = arcs[i : i + LINKS_AT_ONCE] % n
    del arcs
    out, triangles, together = np.diff(starts), 0, max(1, MARKS // n)
    marks = np.zeros(together * n, bool)
    for first in range(0, n, together):
        last = min(n, first + together)
        links = y[starts[first] : starts[last]]
        row = np.repeat(np.arange(last - first) * n, out[first:last])
        marks[row + links] = True
        counts, low = out[links], 0
        upto = np.cumsum(counts)
        while low < len(links):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + LINKS_AT_ONCE, side="right")))
            some = counts[low:high]
            at = np.repeat(starts[links[low:high]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            triangles += int(np.count_nonzero(marks[np.repeat(row[low:high], some) + y[at]]))
            low = high
        marks[row + links] = False
    triples, spread = int((d * (d - 1) // 2).sum()), k * ss - s * s
    return 3 * triangles / triples if triples else 0.0, (k * xy - s * s) / spread if spread > 0 else 0.0


def everywhere(links: DataFrame, tasks: int) -> DataFrame:
    """links: key. task, keys: all of them for each task, as bytes of some thousands."""
    import pyarrow as pa

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["keys"])

    return links.mapInArrow(packed, "keys binary").select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "keys")


def by_task(edges: DataFrame, tasks: int, f, schema: str, nodes: DataFrame | None = None) -> DataFrame:
    """edges: a, b, distinct. Rows of f(task, keys, size), which yields lists of columns, for tasks 0 to tasks - 1. keys: u * size + v of all links by
    the numbers of their nodes, sorted; size: how many nodes there are. Each task gets the links by an exchange, 8 bytes each, if there are
    more than IN_A_TASK; what it finds doesn't hang on that. nodes: of the edges, numbered, if they are at hand."""
    import pyarrow as pa

    from ..sources.shared import written
    from . import blocks

    spark = edges.sparkSession
    nodes = nodes or blocks.numbered(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    size, columns = max(1, nodes.count()), [c.split() for c in schema.split(", ")]
    links = written(blocks.coded(edges.select("a", "b"), nodes, a="u", b="v").select((F.col("u") * size + F.col("v")).cast("long").alias("key")), "links")
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def told(task, keys):
        for found in f(task, keys, size):
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(found, columns, strict=True)], names=[c for c, _ in columns])

    if (m := links.count()) <= IN_A_TASK:
        held = spark.sparkContext.broadcast(np.sort(links.toArrow().column("key").to_numpy()))
        return spark.range(0, tasks, 1, tasks).mapInArrow(lambda batches: (r for b in batches for i in b.column(0).to_pylist() for r in told(i, held.value)), schema)

    def run(batches):
        keys, n, task = np.empty(m, np.int64), 0, None
        for batch in batches:
            for row in batch.column(1):
                part = np.frombuffer(row.as_buffer(), np.int64)
                keys[n : n + len(part)], n, task = part, n + len(part), batch.column(0)[0].as_py()
        if task is not None:
            keys.sort()
            yield from told(task, keys)

    return everywhere(links, tasks).repartitionById(tasks, F.col("task")).mapInArrow(run, schema)


def over_copies(edges: DataFrame, n: int, schema: str, f) -> DataFrame:
    """f(i, keys, size) for i from 0 to n - 1, one row each; keys and size as in by_task. Copies are dealt to tasks in turn."""
    tasks = max(1, min(n, 2 * edges.sparkSession.sparkContext.defaultParallelism))
    return by_task(edges, tasks, lambda task, keys, size: ([[x] for x in f(i, keys, size)] for i in range(task, n, tasks)), schema)


def rewired_null(edges: DataFrame, n: int, keep, seed: int = 1) -> DataFrame:
    """replicate, transitivity, assortativity of n rewired copies of a < b, made in tasks from arrays; of networks of more than MOST_EDGES edges by
    rounds of joins over all copies."""
    if edges.count() > MOST_EDGES:
        return swaps.copies_statistics(swaps.swapped(edges, n, keep, seed=seed)[0])
    return over_copies(edges, n, "replicate long, transitivity double, assortativity double", lambda i, keys, size: (i, *array_statistics(swapped_at_once(keys, size, np.random.default_rng(seed * 1_000_003 + i)), size)))


def permuted_difference(values: np.ndarray, counts: np.ndarray, n_first: int, spark, n: int, seed: int = 1) -> DataFrame:
    """replicate, difference of means between two groups after shuffling who belongs to which: n_first of sum(counts) rows are
    first, counts[i] rows have values[i]. How many of each value fall to the first is drawn at once, so nothing grows with
    the rows."""
    values, counts = np.asarray(values, float), np.asarray(counts, np.int64)
    n_other = int(counts.sum()) - n_first

    def one(i):
        drawn = np.random.default_rng(seed * 1_000_003 + i).multivariate_hypergeometric(counts, n_first, method="marginals")
        return i, float((values * drawn).sum() / n_first - (values * (counts - drawn)).sum() / n_other)

    if not n_first or not n_other:
        return spark.createDataFrame([], "replicate long, difference double")
    return over_rows(spark, n, "replicate long, difference double", one)


def poisson_null(spark, events: int, n: int, seed: int = 1, block: int = 1 << 20) -> DataFrame:
    """replicate, burstiness of so many events spread evenly at random over any span. Gaps between such events are exponential
    numbers over their sum, and burstiness has no scale: so gaps are drawn block by block, and only their sums are held."""

    def one(i):
        rng, left, total, squares = np.random.default_rng(seed * 1_000_003 + i), events - 1, 0.0, 0.0
        while left > 0:
            gaps = rng.exponential(size=min(block, left))
            total, squares, left = total + float(gaps.sum()), squares + float((gaps**2).sum()), left - len(gaps)
        n = events - 1
        mean = total / n if n > 0 else 0.0
        s = (max(0.0, squares - n * mean**2) / (n - 1)) ** 0.5 if n > 1 else 0.0
        return i, (s - mean) / (s + mean) if n > 1 else None

    return over_rows(spark, n, "replicate long, burstiness double", one)


def drawn_share(inside: int, total: int, n_first: int, spark, n: int, seed: int = 1) -> DataFrame:
    """replicate, difference: the share of inside rows among n_first rows drawn from total, less that among the others."""
    if not 0 < n_first < total:
        return spark.createDataFrame([], "replicate long, difference double")

    def one(i):
        k = int(np.random.default_rng(seed * 1_000_003 + i).hypergeometric(inside, total - inside, n_first))
        return i, k / n_first - (inside - k) / (total - n_first)

    return over_rows(spark, n, "replicate long, difference double", one)


def directed_swaps(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of directed edges exchanged, as often as there are edges: all in- and out-degrees stay, no loops or repeated edges come about."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 1
    keys = swapped_at_once(np.sort(a.astype(np.int64) * n + b), n, np.random.default_rng(seed), directed=True)
    return keys // n, keys % n


def reciprocity_of(keys: np.ndarray, n: int) -> float:
    """Share of the directed links u * n + v, distinct and sorted, whose reverse is there too."""
    there = 0
    for i in range(0, len(keys), LINKS_AT_ONCE):
        part = keys[i : i + LINKS_AT_ONCE]
        back = np.sort(part % n * n + part // n)
        there += int((keys[np.minimum(np.searchsorted(keys, back), len(keys) - 1)] == back).sum())
    return there / len(keys) if len(keys) else 0.0


def small_reciprocity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the directed edges whose reverse is there too."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 1
    return reciprocity_of(np.unique(a.astype(np.int64) * n + b), n)


def reciprocity_null(edges: DataFrame, n: int, seed: int = 2) -> DataFrame:
    """replicate, reciprocity of n copies of src, dst whose ends are exchanged, made in tasks from arrays."""
    arcs = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return over_copies(arcs, n, "replicate long, reciprocity double", lambda i, keys, size: (i, reciprocity_of(swapped_at_once(keys, size, np.random.default_rng(seed * 1_000_003 + i), directed=True), size)))


def both_ways(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's links start and where they lead, of undirected links u * n + v, sorted: four bytes a way, by parts."""
    m, degree = len(keys), np.zeros(n, np.int64)
    parts = [keys[i : i + LINKS_AT_ONCE] for i in range(0, m, LINKS_AT_ONCE)]
    for part in parts:
        degree += np.bincount(part // n, minlength=n) + np.bincount(part % n, minlength=n)
    starts = np.concatenate(([0], np.cumsum(degree)))
    others, at = np.empty(2 * m, np.int32), starts[:-1].copy()
    for turn in (True, False):  # neighbours of smaller numbers come first, and all in order
        for part in parts:
            node, other = (part % n, part // n) if turn else (part // n, part % n)
            order = np.argsort(node, kind="stable")
            node, other = node[order], other[order]
            heads = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1))
            some = np.diff(np.append(heads, len(node)))
            others[np.repeat(at[node[heads]] - heads, some) + np.arange(len(node))] = other
            at[node[heads]] += some
    return starts, others


def modularity_null(edges: DataFrame, n: int, seed: int = 3) -> tuple[float, DataFrame]:
    """Modularity of the communities that are found in a < b inside a task, by Leiden's method, and replicate, modularity of those in n rewired
    copies (every edge weighs one there). Tasks get the network by an exchange, whatever its size."""
    from . import leiden

    def one(i, keys, size):
        if not len(keys):
            return i, 0.0
        new = swapped_at_once(keys, size, np.random.default_rng(seed * 1_000_003 + i)) if i else keys
        starts, others = both_ways(new, size)
        label = np.unique(leiden.parted_in_task(starts, others, np.ones(len(others)), seed=seed), return_inverse=True)[1]
        del starts, others
        inside, strength = 0, np.zeros(label.max() + 1)
        for j in range(0, len(new), LINKS_AT_ONCE):
            a, b = label[new[j : j + LINKS_AT_ONCE] // size], label[new[j : j + LINKS_AT_ONCE] % size]
            inside += int((a == b).sum())
            strength += np.bincount(a, minlength=len(strength)) + np.bincount(b, minlength=len(strength))
        return i, inside / len(new) - float(((strength / (2 * len(new))) ** 2).sum())

    rows = over_copies(edges, n + 1, "replicate long, modularity double", one).toPandas()  # n + 1 numbers
    null = [(int(i), float(q)) for i, q in zip(rows.replicate, rows.modularity, strict=True) if i]
    return float(rows.modularity[rows.replicate == 0].iloc[0]), edges.sparkSession.createDataFrame(null, "replicate long, modularity double")


#: Labels that a shuffle may have on either side, and rows: numpy draws from fewer than a thousand million.
MOST_LABELS, MOST_ROWS = 1_000_000, 999_999_999


def shuffled_scores(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """Adjusted Rand index and normalized mutual information of labellings with x[i] and y[j] rows of each label, shuffled against each
    other. The table of a shuffle is drawn row by row: how many of a label's rows meet each label of the other side that is still
    left. So a shuffle takes as long as there are cells, however many rows."""
    n, left, both, h = int(x.sum()), y.astype(np.int64).copy(), 0.0, 0.0
    for rows in x.tolist():
        cells = rng.multivariate_hypergeometric(left, rows, method="marginals")
        left -= cells
        c = cells[cells > 0].astype(float)
        both += float((c * (c - 1) / 2).sum())
        h += float((c * np.log(c)).sum())
    return scores(n, both, h, x.astype(float), y.astype(float))


def scores(n: int, both: float, h: float, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The same from both, the pairs of rows that share both labels, and h, the sum of c * log(c) over cells."""
    choose, log = lambda c: float((c * (c - 1) / 2).sum()), lambda c: float((c[c > 0] * np.log(c[c > 0])).sum())
    cx, cy = choose(x), choose(y)
    hx, hy, hxy = (np.log(n) - v / n for v in (log(x), log(y), h))
    expected = cx * cy / (n * (n - 1) / 2) if n > 1 else 0.0
    top = (cx + cy) / 2 - expected
    return (both - expected) / top if abs(top) > 1e-12 else 1.0, (hx + hy - hxy) / ((hx + hy) / 2) if hx + hy > 1e-12 else 1.0


def partition_null(pairs: DataFrame, x: str, y: str, n: int, seed: int = 4) -> DataFrame:
    """replicate, ari, nmi after shuffling the labels of x. Only the numbers of rows of each label reach the driver and the tasks."""
    margins = []
    for c in (x, y):
        counts = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy("n", c)
        if (found := counts.limit(MOST_LABELS + 1).select("n").toArrow().column("n").to_numpy().astype(np.int64)).size > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels of {c}")
        margins.append(found)
    if not margins[0].sum():
        return pairs.sparkSession.createDataFrame([], "replicate long, ari double, nmi double")
    if margins[0].sum() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    held = pairs.sparkSession.sparkContext.broadcast(tuple(margins))  # MOST_LABELS numbers at most each
    return over_rows(pairs.sparkSession, n, "replicate long, ari double, nmi double", lambda i: (i, *shuffled_scores(*held.value, np.random.default_rng(seed * 1_000_003 + i))))


def partition_test(pairs: DataFrame, x: str, y: str, n: int = 200, least: int = 10) -> DataFrame:
    """pairs: labels x and y of the same rows. For ari and nmi: statistic, rows, status, and observed, null_mean, null_std, z_score, p_value,
    n_samples against n shuffles; below least rows only 'insufficient_overlap'."""
    from ..functions.ranks import compare_to_null
    from .network import agreement

    known = pairs.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    seen, null = agreement(known, x, y).first(), partition_null(known, x, y, n)
    rows = seen.n or 0
    if rows < least:
        out = pairs.sparkSession.createDataFrame([(k, rows, "insufficient_overlap") for k in ("ari", "nmi")], "statistic string, rows long, status string")
        return out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("observed", "null_mean", "null_std", "z_score", "p_value")], F.lit(None).cast("long").alias("n_samples"))
    each = [compare_to_null(null, k, seen[k]).select(F.lit(k).alias("statistic"), F.lit(rows).cast("long").alias("rows"), F.lit("tested").alias("status"), "*") for k in ("ari", "nmi")]
    return each[0].unionByName(each[1])


class Neighbours:
    """An undirected network of numbered nodes in CSR form: its neighbours by node, and the nodes of its largest component. keys: u * n + v of its
    links u < v, sorted."""

    def __init__(self, keys: np.ndarray, n: int):
        self.starts, self.others = both_ways(keys, n)
        m, self.n, label = len(keys), n, np.arange(n)
        self.a, self.b = np.empty(m, np.int32), np.empty(m, np.int32)
        parts = [slice(i, i + LINKS_AT_ONCE) for i in range(0, m, LINKS_AT_ONCE)]
        for part in parts:
            self.a[part], self.b[part] = np.divmod(keys[part], n)
        while True:  # the smallest number of a component, along edges and then by its own label
            new = label.copy()
            for part in parts:
                np.minimum.at(new, self.a[part], label[self.b[part]])
                np.minimum.at(new, self.b[part], label[self.a[part]])
            new = new[new]
            if (new == label).all():
                break
            label = new
        self.giant = label == np.bincount(label).argmax() if n else np.zeros(0, bool)

    def hops_from(self, source: int) -> np.ndarray:
        """Steps from a node, -1 where there is no path."""
        far, front, step = np.full(self.n, -1), np.array([source]), 0
        far[source] = 0
        while len(front):
            step += 1
            parts = [np.unique(v[far[v] < 0]) for _, v in steps_from(self.starts, self.others, front)]
            front = np.unique(np.concatenate(parts)) if parts else front[:0]
            far[front] = step
        return far

    def links_among(self, place: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """place: the place of each of nodes, -1 of all others. The places of the two ends of each link between them once, the smaller first."""
        parts = []
        for u, v in steps_from(self.starts, self.others, nodes):
            x, y = place[u], place[v]
            up = y > x
            parts.append((x[up], y[up]))
        return tuple(np.concatenate([p[i] for p in parts]) if parts else place[:0] for i in (0, 1))

    def number_among(self, nodes: np.ndarray) -> int:
        """How many links lie between so many nodes: asked of all links, or of theirs where these are far fewer."""
        there = np.zeros(self.n, bool)
        there[nodes] = True
        if 4 * int((self.starts[nodes + 1] - self.starts[nodes]).sum()) < len(self.a):
            return sum(int(there[v].sum()) for _, v in steps_from(self.starts, self.others, nodes)) // 2
        return sum(int((there[self.a[i : i + LINKS_AT_ONCE]] & there[self.b[i : i + LINKS_AT_ONCE]]).sum()) for i in range(0, len(self.a), LINKS_AT_ONCE))


def against(observed: float | None, null: list[float]) -> tuple[float | None, float | None, float | None]:
    """observed, z and p (two-sided, add-one, around the mean) against draws; all None without an observed value."""
    if observed is None:
        return None, None, None
    x = np.array(null, float)
    sd = float(x.std(ddof=1)) if len(x) > 1 else 0.0
    mean = float(x.mean()) if len(x) else 0.0
    return float(observed), (observed - mean) / sd if sd > 0 else 0.0, float((np.abs(x - mean) >= abs(observed - mean)).sum() + 1) / (len(x) + 1)


def exposure_of(order: np.ndarray, near: Neighbours, n: int, rng: np.random.Generator) -> tuple:
    """order: the adopters of an item in the network, by when they adopted. Observed value, z and p of: the share that adopted after a neighbour
    had; the rank correlation of when and how far from the first adopter in the largest component (None for fewer than ten, or
    where all are as far); and the edges among adopters. The first two against shuffles of who adopted when, the last against
    as many nodes drawn at random."""
    k, place = len(order), np.full(near.n, -1, np.int32)
    place[order] = np.arange(k)
    one, other = near.links_among(place, order)
    first = next((u for u in order.tolist() if near.giant[u]), None)
    far = near.hops_from(first)[order] if first is not None else np.full(k, -1)
    reached = np.flatnonzero(far > 0)

    def ranked(x):
        _, code, size = np.unique(x, return_inverse=True, return_counts=True)
        return (np.cumsum(size) - (size - 1) / 2)[code]

    hops = ranked(far[reached])
    spread = len(reached) >= 10 and (hops != hops[0]).any()

    def measure(when):
        exposed = np.zeros(k, bool)
        exposed[np.where(when[one] < when[other], other, one)] = True
        return int(exposed.sum()) / max(1, k), float(np.corrcoef(ranked(when[reached]), hops)[0, 1]) if spread else None

    seen, inside, null = measure(np.arange(k, dtype=np.int32)), float(len(one)), []
    for _ in range(n):
        drawn = near.number_among(rng.choice(near.n, k, replace=False))
        null.append((*measure(rng.permutation(k).astype(np.int32)), float(drawn)))
    return tuple(x for i, v in enumerate((*seen, inside)) for x in against(v, [r[i] for r in null if r[i] is not None]))


def over_items(firsts: DataFrame, item: str, edges: DataFrame, f, schema: str) -> DataFrame:
    """firsts: item, actor, first_us; edges: a < b, distinct. A row of each item: item and f(network, item, codes, first_us) of its adopters by when they
    adopted; codes are -1 of adopters outside the network, whose nodes are numbered in order. Items are dealt to tasks in turn, and each
    gets the edges by an exchange, as eight bytes each: nothing goes through the driver."""
    from ..sources.shared import written
    from . import blocks

    spark = edges.sparkSession
    nodes = blocks.numbered(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    items = blocks.numbered(firsts.select(item).distinct(), item).select(F.col(item).alias("_item"), "code")
    size, tasks = max(1, nodes.count()), max(1, min(items.count(), 2 * spark.sparkContext.defaultParallelism))
    number = F.coalesce("_code", F.lit(-1)).cast("int").alias("code")
    dealt = firsts.join(items, F.col(item).eqNullSafe(F.col("_item"))).select((F.col("code") % tasks).cast("int").alias("task"), item, "actor", "first_us")
    dealt = dealt.join(nodes.select(F.col("node").alias("actor"), F.col("code").alias("_code")), "actor", "left").select("task", item, number, "first_us")
    links = written(blocks.coded(edges.select("a", "b"), nodes, a="u", b="v").select((F.col("u") * size + F.col("v")).cast("long").alias("key")), "network")
    m, kind = links.count(), dict(firsts.dtypes)[item]
    net = everywhere(links, tasks).select("task", F.lit(None).cast(kind).alias(item), F.lit(None).cast("int").alias("code"), F.lit(None).cast("long").alias("first_us"), "keys")

    def run(batches):
        import pyarrow as pa

        keys, n, mine = np.empty(m, np.int64), 0, []
        for batch in batches:
            there = batch.column(4).is_valid()
            for row in batch.column(4).filter(there):
                part = np.frombuffer(row.as_buffer(), np.int64)
                keys[n : n + len(part)], n = part, n + len(part)
            mine.append(pa.Table.from_batches([batch]).select([1, 2, 3]).filter(batch.column(4).is_null()))
        if not (mine := pa.concat_tables(mine) if mine else None):
            return
        keys.sort()
        near = Neighbours(keys, size)
        del keys
        kinds = {c.split()[0]: {"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")}
        coded = mine.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        of, code, us = coded.indices.to_numpy(), mine.column(1).to_numpy(), mine.column(2).to_numpy()
        order = np.lexsort((code, us, of))
        edge = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))
        rows = [f(near, name.as_py(), code[order[i:j]], us[order[i:j]]) for name, i, j in zip(coded.dictionary, edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(c, t) for t, c in zip(kinds.values(), zip(*rows, strict=True), strict=True)]], names=[item, *kinds])

    both = dealt.withColumn("keys", F.lit(None).cast("binary")).unionByName(net)
    return both.repartitionById(tasks, F.col("task")).mapInArrow(run, f"{item} {kind}, {schema}")


def exposure_scores(firsts: DataFrame, item: str, edges: DataFrame, n: int, least: int = 10, seed: int = 5) -> DataFrame:
    """firsts: item, actor, first_us; edges: a < b. For each item: item, adopters (in the network), and exposed, rho and inside with their z and p
    (see exposure_of); null below least adopters. Items are dealt to tasks, each of which holds the network; an item's adopters are
    no more than its nodes."""
    columns = [f"{k}{x}" for k in ("exposed", "rho", "inside") for x in ("", "_z", "_p")]

    def one(near, name, code, us):
        import zlib

        order = code[code >= 0]
        if len(order) < least:
            return len(order), *[None] * len(columns)
        return len(order), *exposure_of(order, near, n, np.random.default_rng([seed, zlib.crc32(str(name).encode())]))

    return over_items(firsts, item, edges.select("a", "b"), one, "adopters long, " + ", ".join(f"{c} double" for c in columns))


def exposed_counts(firsts: DataFrame, item: str, edges: DataFrame) -> DataFrame:
    """The same firsts and edges. item, adopters (all), exposed (those with a neighbour that adopted before them) and internal_edges (among them)."""

    def one(near, name, code, us):
        inside = code >= 0
        nodes, place = code[inside], np.full(near.n, -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        x, y = near.links_among(place, nodes)
        exposed, when = np.zeros(len(nodes), bool), us[inside]
        exposed[y[when[x] < when[y]]] = True  # adopters are in order of time
        return len(code), int(exposed.sum()), len(x)

    return over_items(firsts, item, edges.select("a", "b"), one, "adopters long, exposed long, internal_edges long")


def betweenness(edges: DataFrame, sources: int | None = None, seed: int = 1, directed: bool = False, keep=None) -> DataFrame:
    """node, betweenness (normalized, exact if sources covers all nodes; edges a to b, both ways unless directed): Brandes from
    each source, a level at once over arrays of the network, which each task gets by an exchange; the sums of a task are sent on, not each
    source's. With keep, networks of more than MOST_EDGES edges go by joins."""
    from . import blocks

    if keep is not None and edges.count() > MOST_EDGES:
        from . import paths

        return paths.betweenness(edges, keep, sources, seed, directed)
    nodes = blocks.numbered(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    n = nodes.count()
    chosen = np.arange(n) if sources is None or sources >= n else np.sort(np.random.default_rng(seed).choice(n, sources, replace=False))
    tasks = max(1, min(len(chosen), 2 * edges.sparkSession.sparkContext.defaultParallelism))

    def own(task, keys, size):
        if directed:
            nets = one_way(keys, size), one_way(np.sort(keys % size * size + keys // size), size)
        else:
            nets = (both_ways(keys, size),)
        total = np.zeros(size)
        for source in chosen[task::tasks].tolist():
            add_dependencies(nets[0], nets[-1], source, total)
        yield np.flatnonzero(total), total[total != 0]

    sums = by_task(edges, tasks, own, "code long, x double", nodes).groupBy("code").agg(F.sum("x").alias("x"))
    scale = n / max(1, len(chosen)) / max(1, (n - 1) * (n - 2))
    return nodes.join(sums, "code", "left").select("node", F.round(F.coalesce("x", F.lit(0.0)) * scale, 9).alias("betweenness"))


def one_way(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's links start and where they lead, of links u * n + v, sorted."""
    return np.searchsorted(keys, np.arange(n + 1) * n), (keys % n).astype(np.int32)


def rows_of(ends: np.ndarray, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's links start, and where they lead."""
    return np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=n)))), others[np.argsort(ends, kind="stable")]


#: Links that are followed at once.
LINKS_AT_ONCE = 1 << 20


def steps_from(starts: np.ndarray, others: np.ndarray, front: np.ndarray):
    """Pairs of a node of front and one behind it, in parts of LINKS_AT_ONCE or a node's links."""
    counts = starts[front + 1] - starts[front]
    upto, low = np.cumsum(counts), 0
    while low < len(front):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + LINKS_AT_ONCE, side="right")))
        some = counts[low:high]
        at = np.repeat(starts[front[low:high]] - np.cumsum(some) + some, some) + np.arange(some.sum())
        yield np.repeat(front[low:high], some), others[at]
        low = high


def links_between(on: tuple, back: tuple, above: np.ndarray, below: np.ndarray):
    """Pairs of a node of above and one behind it, or those with a node of below, whichever are fewer. on, back: starts and others of the
    network and of the network turned round."""
    size = lambda net, nodes: int((net[0][nodes + 1] - net[0][nodes]).sum())
    if size(on, above) <= size(back, below):
        yield from steps_from(*on, above)
    else:
        yield from ((u, v) for v, u in steps_from(*back, below))


def add_dependencies(on: tuple, back: tuple, source: int, total: np.ndarray) -> None:
    """Add to total each node's share of the shortest paths from source. Once few nodes are left their links are followed, not those of all that
    were found last."""
    n = len(total)
    far, paths, levels = np.full(n, -1, np.int32), np.zeros(n), [np.array([source])]
    far[source], paths[source] = 0, 1.0
    while len(levels[-1]):
        step = len(levels)
        for u, v in links_between(on, back, levels[-1], np.flatnonzero(far < 0)):
            new = (far[u] == step - 1) & ((far[v] < 0) | (far[v] == step))
            u, v = u[new], v[new]
            far[v] = step
            paths += np.bincount(v, weights=paths[u], minlength=n)
        levels.append(np.flatnonzero(far == step))
    part = np.zeros(n)
    for step in range(len(levels) - 2, 0, -1):
        for u, v in links_between(on, back, levels[step], levels[step + 1]):
            new = (far[u] == step) & (far[v] == step + 1)
            u, v = u[new], v[new]
            part += np.bincount(u, weights=paths[u] / paths[v] * (1 + part[v]), minlength=n)
        total[levels[step]] += part[levels[step]]


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 1) -> np.ndarray:
    """Community of each node (codes 0 to n - 1), by local moves and contraction until nothing gains."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 0
    label, rng = np.arange(n), np.random.default_rng(seed)
    total = float(w.sum()) * 2
    links = [dict() for _ in range(n)]
    for u, v, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        links[u][v] = links[u].get(v, 0) + x
        links[v][u] = links[v].get(u, 0) + x
    loops = [0.0] * n
    while n:
        strength = [sum(x for v, x in l.items() if v != u) + 2 * loops[u] for u, l in enumerate(links)]
        own, weight, moved = list(range(n)), strength[:], False
        for _ in range(20):
            changed = 0
            for u in rng.permutation(n).tolist():
                toward: dict[int, float] = {}
                for v, x in links[u].items():
                    if v != u:
                        toward[own[v]] = toward.get(own[v], 0) + x
                c = own[u]
                weight[c] -= strength[u]
                gain = lambda k: toward.get(k, 0) - resolution * weight[k] * strength[u] / total  # noqa: E731, B023
                best = max(toward, key=lambda k: (gain(k), -k), default=c)
                if gain(best) <= gain(c) + 1e-12:
                    best = c
                weight[best] += strength[u]
                changed += best != c
                own[u] = best
            moved |= changed > 0
            if not changed:
                break
        _, dense = np.unique(own, return_inverse=True)
        label = dense[label]
        if not moved:
            return label
        k = int(dense.max()) + 1
        new, new_loops = [dict() for _ in range(k)], [0.0] * k
        for u, l in enumerate(links):
            cu = int(dense[u])
            new_loops[cu] += loops[u]
            for v, x in l.items():
                cv = int(dense[v])
                if cu != cv:
                    new[cu][cv] = new[cu].get(cv, 0) + x
                elif u < v:
                    new_loops[cu] += x
        links, loops, n = new, new_loops, k
    return label


def fit_logistic(curves: DataFrame, item: str) -> DataFrame:
    """curves: item, hour_us, adopters. item, fit ('logistic', or 'insufficient_data' where there are fewer than 8 points or one
    adopter), top, rate, mid_hours, r2 and doubling_hours (null without a fit), by Gauss-Newton with damping."""
    import pandas as pd

    def fit(pdf):
        pdf = pdf.sort_values("hour_us")
        t, y = (pdf.hour_us.values - pdf.hour_us.values[0]) / 3.6e9, pdf.adopters.values.astype(float)
        out = {item: pdf[item].iloc[0], "fit": "insufficient_data", "top": None, "rate": None, "mid_hours": None, "r2": None, "doubling_hours": None}
        if len(t) >= 8 and y.max() > 1:
            p, damping = np.array([y.max(), 4 / (t[-1] + 1), t[-1] / 2]), 1e-2
            value = lambda p: p[0] / (1 + np.exp(-np.clip(p[1] * (t - p[2]), -50, 50)))
            error = ((y - value(p)) ** 2).sum()
            for _ in range(200):
                e = 1 / (1 + np.exp(-np.clip(p[1] * (t - p[2]), -50, 50)))
                slope = np.stack((e, p[0] * e * (1 - e) * (t - p[2]), -p[0] * e * (1 - e) * p[1]), 1)
                h = slope.T @ slope
                step = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-9), slope.T @ (y - value(p)))
                q = np.clip(p + step, [0.5, 1e-6, -10 * t[-1] - 1], [10 * y.max(), 100, 10 * t[-1] + 1])
                new = ((y - value(q)) ** 2).sum()
                damping *= 0.3 if new < error else 5
                if new < error:
                    p, error = q, new
                if damping > 1e8:
                    break
            spread = ((y - y.mean()) ** 2).sum()
            out |= {"fit": "logistic", "top": p[0], "rate": p[1], "mid_hours": p[2], "r2": 1 - error / spread if spread else 1.0, "doubling_hours": np.log(2) / p[1]}
        return pd.DataFrame([out])

    return curves.groupBy(item).applyInPandas(fit, f"{item} {dict(curves.dtypes)[item]}, fit string, top double, rate double, mid_hours double, r2 double, doubling_hours double")
