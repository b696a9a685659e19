"""Networks as edge tables (a, b): builders, cohesion, mixing, partitions, paths, iterative measures."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written
from . import blocks

Keep = Callable[[DataFrame, str], DataFrame]


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """a < b, w: both directions of a pair add up; loops are left out."""
    w = F.sum(weight) if weight else F.count("*")
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(w.alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "w"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "w"))).alias("e")).select("e.*")


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def bipartite(events: DataFrame, left: str, right: str) -> DataFrame:
    """src, dst, weight, first_us, last_us between prefixed ids of the two kinds."""
    return events.groupBy(F.concat(F.lit(f"{left}:"), F.col(left).cast("string")).alias("src"), F.concat(F.lit(f"{right}:"), F.col(right).cast("string")).alias("dst")).agg(F.count("*").alias("weight"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))


def bipartite_nodes(events: DataFrame, left: str, right: str) -> DataFrame:
    """node, kind, bipartite (0 or 1), n_events, first_us, last_us of both kinds; a node counts once for each event."""
    at = F.unix_micros("ts").alias("us")
    side = lambda k, i: events.select(F.concat(F.lit(f"{k}:"), F.col(k).cast("string")).alias("node"), F.lit(k).alias("kind"), F.lit(i).alias("bipartite"), at)
    return side(left, 0).unionByName(side(right, 1)).groupBy("node", "kind", "bipartite").agg(F.count("*").alias("n_events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def first_touch(events: DataFrame, key: str, *attributes: str) -> DataFrame:
    """events: key, ts, id and attributes. key, and of each attribute the first value that isn't null: what is set once stays."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "id"))).alias(c)
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(*[first(c) for c in attributes])


def newman_projection(members: DataFrame, group: str, member: str, most: int | None = None, seen: str | None = None) -> DataFrame:
    """members: distinct group, member (and seen, if named: when the group was last seen). a < b, w: each shared group adds 1 / (k - 1), k its
    members; shared; first_seen, last_seen: of the shared groups, if seen is named. most: groups with more members are left out
    when asked for, as their pairs grow with the square. Where two members share many groups on average (CROWDED), they aren't joined
    by group, but looked at in squares of members. Else groups are dealt to as many tasks as their pairs ask for (PAIRS_AT_ONCE), as a task
    adds up what it has of them in memory."""
    sized = members.withColumn("k", F.count("*").over(W.partitionBy(group))).where("k >= 2")
    sized = written(sized if most is None else sized.where(F.col("k") <= most), "members")
    met = sized.agg(F.sum(F.col("k") - 1).alias("pairs"), F.approx_count_distinct(member).alias("n")).first()
    if (met.pairs or 0) > CROWDED * met.n * met.n:
        return projection_by_blocks(sized, group, member, seen)
    dealt = sized.repartition(max(sized.sparkSession.sparkContext.defaultParallelism, -(-(met.pairs or 0) // (2 * PAIRS_AT_ONCE))), group)
    x, y = dealt.alias("x"), dealt.alias("y")
    pairs = x.join(y, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col(f"x.{member}") < F.col(f"y.{member}")))
    return pairs.groupBy(F.col(f"x.{member}").alias("a"), F.col(f"y.{member}").alias("b")).agg(F.round(F.sum(1 / (F.col("x.k") - 1)), 6).alias("w"), F.count("*").alias("shared"), *([F.min(f"x.{seen}").alias("first_seen"), F.max(f"x.{seen}").alias("last_seen")] if seen else []))


#: Pairs within groups for each two members beyond which a projection goes by squares; members on a side of a square.
CROWDED, SIDE = 2, 2048
#: Pairs within groups that a task joins, about (a group's are never parted).
PAIRS_AT_ONCE = 1 << 21


def projection_by_blocks(sized: DataFrame, group: str, member: str, seen: str | None) -> DataFrame:
    """newman_projection of members with k: members are numbered and dealt to blocks of SIDE; each two blocks meet in a row, and what a
    square of members shares is added up there, group by group, so that only pairs leave a task, once each."""
    nodes = blocks.numbered(sized.select(F.col(member).alias("node")).distinct())
    groups = blocks.numbered(sized.select(F.struct(*[c for c in (seen, group) if c]).alias("rank")).distinct(), "rank")
    rows = sized.select(F.col(member).alias("node"), F.struct(*[c for c in (seen, group) if c]).alias("rank"), F.col("k").cast("double"), *([F.col(seen).alias("seen")] if seen else []))
    rows = rows.join(nodes, "node").withColumnRenamed("code", "at").join(groups, "rank").select("node", "at", F.col("code").alias("g"), "k", *(["seen"] if seen else []))
    one = F.struct("at", "node", "g", "k", *(["seen"] if seen else []))
    packed = rows.groupBy(F.expr(f"int(at div {SIDE})").alias("block")).agg(F.collect_list(one).alias("rows"))
    names = ["at", "node", "g", "k", *(["seen"] if seen else [])]
    table = written(packed.select("block", *[F.col("rows")[c].alias(c) for c in names]), "blocks", maxRecordsPerFile=1)
    side = lambda i: table.select(*[F.col(c).alias(f"{i}_{c}") for c in ("block", *names)])

    def read(batch, i, prefix):
        column = lambda c: batch.column(batch.schema.get_field_index(f"{prefix}_{c}"))[i].values
        at, g = column("at").to_numpy(), column("g").to_numpy()
        code, first = np.unique(at, return_index=True)
        return np.searchsorted(code, at), column("node").take(first), g, column("k").to_numpy(), column("seen") if seen else None, len(code)

    def square(batch, i, same):
        import pyarrow as pa

        (x, xs, gx, k, when, m), (y, ys, gy, _, _, n) = read(batch, i, "x"), read(batch, i, "y")
        both, first = np.unique(gx, return_index=True)
        first = first[np.isin(both, gy)]
        both = gx[first]
        w, shared, low, high = np.zeros((m, n)), np.zeros((m, n), np.float32), np.full((m, n), -1, np.int32), np.full((m, n), -1, np.int32)
        for start in range(0, len(both), 256):  # groups, in order of seen
            part = both[start : start + 256]
            sides = []
            for at, g, size in ((x, gx, m), (y, gy, n)):
                place = np.minimum(np.searchsorted(part, g), len(part) - 1)
                mine = part[place] == g
                sides.append(np.zeros((size, len(part)), np.float32))
                sides[-1][at[mine], place[mine]] = 1
            shared += sides[0] @ sides[1].T
            w += (sides[0] / (k[first[start : start + 256]] - 1)) @ sides[1].T.astype(np.float64)
            for j in range(len(part) if seen else 0):
                cells = np.ix_(np.flatnonzero(sides[0][:, j]), np.flatnonzero(sides[1][:, j]))
                high[cells] = start + j
                some = low[cells]
                low[cells] = np.where(some < 0, start + j, some)
        for top in range(0, m, 256):
            there = shared[top : top + 256] > 0
            if same:
                there &= np.arange(n) > np.arange(top, min(top + 256, m))[:, None]
            a, b = np.nonzero(there)
            a += top
            columns = [xs.take(pa.array(a)), ys.take(pa.array(b)), pa.array(w[a, b]), pa.array(shared[a, b].astype(np.int64))]
            yield columns + ([when.take(pa.array(first[c[a, b]])) for c in (low, high)] if seen else [])

    out = ["a", "b", "w", "shared", *(["first_seen", "last_seen"] if seen else [])]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                for columns in square(batch, i, batch.column(0)[i].as_py() == batch.column(len(names) + 1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays(columns, names=out)

    kinds, tasks = dict(rows.dtypes), 4 * sized.sparkSession.sparkContext.defaultParallelism
    schema = f"a {kinds['node']}, b {kinds['node']}, w double, shared long" + (f", first_seen {kinds['seen']}, last_seen {kinds['seen']}" if seen else "")
    meets = table.select(F.col("block").alias("i")).join(table.select(F.col("block").alias("j")), F.col("i") <= F.col("j")).repartition(tasks, "i", "j")
    squares = meets.join(side("x"), F.col("i") == F.col("x_block")).join(side("y"), F.col("j") == F.col("y_block")).drop("i", "j")
    return squares.mapInArrow(run, schema).withColumn("w", F.round("w", 6))


def projection_nodes(members: DataFrame, group: str, member: str, most: int | None = None) -> DataFrame:
    """Nodes of the Newman projection, without its pairs: node, touches (pairs that it is in, once for each shared group) and
    strength (its groups with another member: each adds (k - 1) times 1 / (k - 1))."""
    sized = members.withColumn("k", F.count("*").over(W.partitionBy(group))).where("k >= 2")
    sized = sized if most is None else sized.where(F.col("k") <= most)
    return sized.groupBy(F.col(member).alias("node")).agg(F.sum(F.col("k") - 1).alias("touches"), F.count("*").alias("strength"))


def numbered_arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """node, degree, code; the links as key, u, v, w by these codes, which follow degrees: links point from the end of lower degree to the
    higher, so a hub's pairs aren't formed; and how many nodes there are."""
    edges = written(edges.select("a", "b", F.lit(1).alias("w")), "edges")
    ranked = blocks.numbered(degree(edges).select("node", "degree", F.struct("degree", "node").alias("rank")), "rank").drop("rank")
    arcs = blocks.coded(edges, ranked, a="x", b="y").select(F.lit(0).alias("key"), F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.lit(1.0).alias("w"))
    return ranked, arcs, ranked.count()


def numbered_triangles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, degree, code; and x, y, z of each triangle once, by these codes. Over blocks of links up to blocks.MOST_NODES nodes, else by joins."""
    ranked, arcs, n = numbered_arcs(edges)
    return ranked, blocks.triangles(blocks.blocked(written(arcs, "arcs"), max(1, n))[0], n) if n <= blocks.MOST_NODES else joined_triangles(arcs)


def joined_triangles(arcs: DataFrame) -> DataFrame:
    first, second = arcs.alias("f"), arcs.alias("s")
    wedges = first.join(second, (F.col("f.u") == F.col("s.u")) & (F.col("f.v") < F.col("s.v"))).select(F.col("f.u").alias("x"), F.col("f.v").alias("y"), F.col("s.v").alias("z"))
    return wedges.join(arcs.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"], "left_semi").select("x", "y", "z")


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z of each triangle once."""
    nodes, found = numbered_triangles(edges)
    for c in "xyz":
        found = found.join(nodes.select(F.col("node").alias(f"{c}_node"), F.col("code").alias(c)), c)
    return found.select(*[F.col(f"{c}_node").alias(c) for c in "xyz"])


def transitivity(edges: DataFrame) -> DataFrame:
    """n_triangles, n_triples, transitivity (0 where there are no triples). Triangles are counted, not listed."""
    nodes, arcs, n = numbered_arcs(edges)
    if n <= blocks.MOST_NODES:
        counts = blocks.triangle_counts(blocks.blocked(written(arcs, "arcs"), max(1, n))[0], n)
    else:
        counts = joined_triangles(arcs).select(F.lit(1).cast("long").alias("n"))
    t = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_triangles"))
    p = nodes.agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).cast("long").alias("n_triples"))
    return t.crossJoin(p).withColumn("transitivity", F.round(F.coalesce(F.try_divide(3 * F.col("n_triangles"), F.col("n_triples")), F.lit(0.0)), 6))  # one row each


def local_clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, clustering."""
    nodes, found = numbered_triangles(edges)
    per = found.select(F.explode(F.array("x", "y", "z")).alias("code")).groupBy("code").agg(F.count("*").alias("t"))
    rows = nodes.join(per, "code", "left").select("node", "degree", F.coalesce("t", F.lit(0)).alias("triangles"))
    return rows.withColumn("clustering", F.round(F.coalesce(F.try_divide(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)), 6))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    d = degree(edges).select("node", "degree")
    ends = both_ways(edges).join(d, "node").withColumnRenamed("degree", "x").join(d.select(F.col("node").alias("other"), F.col("degree").alias("y")), "other")
    return ends.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("assortativity"))


def attribute_assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: node, label. (trace - sum of products) / (1 - that sum) of the mixing matrix; null below two labels. Nodes without a label are 'unknown'."""
    own = labels.select("node", F.col("label").alias("l"))
    ends = both_ways(edges).join(own, "node", "left").join(own.select(F.col("node").alias("other"), F.col("l").alias("m")), "other", "left").select(F.coalesce("l", F.lit("unknown")).alias("l"), F.coalesce("m", F.lit("unknown")).alias("m"))
    mix = ends.groupBy("l", "m").agg(F.count("*").alias("n")).withColumn("e", F.col("n") / F.sum("n").over(W.partitionBy()))
    rows = mix.groupBy("l").agg(F.sum("e").alias("a"), F.coalesce(F.sum(F.when(F.col("l") == F.col("m"), F.col("e"))), F.lit(0.0)).alias("d"))
    return rows.agg(F.count("*").alias("n_labels"), F.sum("d").alias("t"), F.sum(F.col("a") * F.col("a")).alias("s")).select("n_labels", F.when(F.col("n_labels") > 1, F.round(F.try_divide(F.col("t") - F.col("s"), 1 - F.col("s")), 6)).alias("assortativity"))


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """partition: node, c. Weighted: the sum over classes of inner weight / m - resolution * (degree / 2m) squared."""
    own = partition.select("node", "c")
    ends = both_ways(edges).join(own, "node").join(own.select(F.col("node").alias("other"), F.col("c").alias("oc")), "other")
    per = ends.groupBy("c").agg(F.sum("w").alias("d"), F.coalesce(F.sum(F.when(F.col("c") == F.col("oc"), F.col("w"))), F.lit(0)).alias("inner"))
    total = per.agg(F.sum("d").alias("m2"))
    return per.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_classes"), F.round(F.sum(F.col("inner") / F.col("m2") - resolution * (F.col("d") / F.col("m2")) ** 2), 6).alias("modularity"))  # one row


def agreement(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Adjusted Rand index and normalized mutual information (arithmetic mean) of two partitions."""
    choose = lambda c: c * (c - 1) / 2
    cells = pairs.groupBy(x, y).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum("n").alias("n"), F.sum(choose(F.col("n"))).alias("both"), F.sum(F.col("n") * F.log("n")).alias("hxy"))
    side = lambda k, name: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(choose(F.col("n"))).alias(f"c{name}"), F.sum(F.col("n") * F.log("n")).alias(f"h{name}"))
    one = both.crossJoin(side(x, "x")).crossJoin(side(y, "y"))  # one row each
    expected, n = F.coalesce(F.try_divide(F.col("cx") * F.col("cy"), choose(F.col("n"))), F.lit(0.0)), F.col("n")
    hx, hy, hxy = (F.log(n) - F.try_divide(F.col(h), n) for h in ("hx", "hy", "hxy"))
    ari = F.try_divide(F.col("both") - expected, (F.col("cx") + F.col("cy")) / 2 - expected)
    return one.select("n", F.round(F.coalesce(ari, F.lit(1.0)), 6).alias("ari"), F.round(F.coalesce(F.try_divide(hx + hy - hxy, (hx + hy) / 2), F.lit(1.0)), 6).alias("nmi"))


def degree_ccdf(edges: DataFrame) -> DataFrame:
    """degree, n, share of nodes with at least that degree."""
    counts = degree(edges).groupBy("degree").agg(F.count("*").alias("n"))
    return counts.select("degree", "n", F.round(F.sum("n").over(W.orderBy(F.desc("degree"))) / F.sum("n").over(W.partitionBy()), 6).alias("ccdf"))


def power_law(edges: DataFrame, xmin: int = 1) -> DataFrame:
    """n, alpha (continuous approximation with xmin - 1/2) and the largest distance to the fitted distribution."""
    counts = degree(edges).where(F.col("degree") >= xmin).groupBy("degree").agg(F.count("*").alias("n"))
    fit = counts.agg(F.sum("n").alias("all"), (1 + F.sum("n") / F.sum(F.col("n") * F.log(F.col("degree") / (xmin - 0.5)))).alias("alpha"))
    below = F.sum("n").over(W.orderBy("degree"))
    both = counts.withColumn("cum", below).crossJoin(F.broadcast(fit))  # one row
    model = 1 - (F.col("degree") / (xmin - 0.5)) ** (1 - F.col("alpha"))
    return both.groupBy(F.col("all").alias("n"), F.round("alpha", 6).alias("alpha")).agg(F.round(F.max(F.abs(F.col("cum") / F.col("all") - model)), 6).alias("ks"))


def power_law_or_lognormal(edges: DataFrame, xmin: int = 1, least: int = 10) -> DataFrame:
    """One row: n, alpha, log-likelihoods of the degrees under the power law and a lognormal, their difference, its z (Vuong) and
    p_value, mean and largest degree, and which is preferred; below least degrees all but n are null: insufficient_data."""
    import math

    import pandas as pd

    base = xmin - 0.5
    counts = degree(edges).where(F.col("degree") >= xmin).groupBy("degree").agg(F.count("*").alias("k"))
    x, k = F.log("degree"), F.col("k")
    fit = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), (1 + F.try_divide(F.sum("k"), F.sum(k * (x - math.log(base))))).alias("alpha"), F.try_divide(F.sum(k * x), F.sum("k")).alias("mu"), F.sum(k * x * x).alias("xx"), F.try_divide(F.sum(k * F.col("degree")), F.sum("k")).alias("mean"), F.max("degree").alias("most"))
    fit = fit.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("xx") - F.col("n") * F.col("mu") * F.col("mu"), F.col("n") - 1))))
    both = counts.crossJoin(F.broadcast(fit))  # one row
    p = F.log((F.col("alpha") - 1) / base) - F.col("alpha") * (x - math.log(base))
    z = F.try_divide(x - F.col("mu"), F.col("sd"))
    q = F.when(F.col("sd") > 0, -x - F.log("sd") - 0.5 * math.log(2 * math.pi) - z * z / 2)
    each = both.select("k", p.alias("p"), q.alias("q")).withColumn("d", F.col("p") - F.col("q"))
    sums = each.agg(*[F.sum(k * F.col(c)).alias(c) for c in "pqd"], F.sum(k * F.col("d") * F.col("d")).alias("dd"))
    one = fit.crossJoin(sums)  # one row each
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("dd") - F.try_divide(F.col("d") * F.col("d"), "n"), F.col("n") - 1)) * F.col("n"))
    enough = F.col("n") >= least
    kept = lambda c, digits, name: F.when(enough, F.round(c, digits)).alias(name)
    row = one.select("n", kept("alpha", 6, "alpha"), kept("p", 4, "loglik_power_law"), kept("q", 4, "loglik_lognormal"), kept("d", 4, "likelihood_ratio"), kept(F.try_divide("d", spread), 4, "z"), kept("mean", 6, "mean"), F.when(enough, F.col("most")).alias("most"))

    def verdict(parts):
        for part in parts:
            chance = [None if pd.isna(z) else math.erfc(abs(z) / math.sqrt(2)) for z in part.z]
            said = ["insufficient_data" if n < least else "indistinguishable" if c is None or c >= 0.05 else "power_law" if z > 0 else "lognormal" for n, z, c in zip(part.n, part.z, chance, strict=True)]
            yield part.assign(p_value=pd.Series(chance, dtype=float), preferred=said)

    return row.mapInPandas(verdict, ", ".join(f"{c} {t}" for c, t in row.dtypes) + ", p_value double, preferred string")


def bfs(edges: DataFrame, source: Column | str, keep: Keep, most: int = 1000) -> DataFrame:
    """node, hops from the source, over undirected edges. Each step writes its new nodes only; what is a step away from them was
    seen in it, in the one before, or never. Nodes more than most steps away raise an error."""
    links = both_ways(edges).select("node", "other")
    front = keep(links.where(F.col("node") == source).select("node").distinct().select("node", F.lit(0).alias("hops")), "bfs")
    seen, last = front, front
    for step in range(1, most + 2):
        near = front.join(links, "node").select(F.col("other").alias("node")).distinct()
        new = near.join(front, "node", "left_anti").join(last, "node", "left_anti")
        last, front = front, keep(new.select("node", F.lit(step).alias("hops")), "bfs")
        if front.isEmpty():
            break
        if step > most:
            raise RuntimeError(f"nodes more than {most} steps from the source")
        seen = seen.unionByName(front)
    return seen


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, keep: Keep | None = None, every: int = 5) -> DataFrame:
    """edges: src, dst, weight. node, rank after a fixed number of rounds; what ends in dead ends is spread evenly. keep, if
    given, cuts the lineage every so many rounds."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    total = nodes.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p"))
    rank = nodes.select("node", F.lit(1.0 / max(total, 1)).alias("rank"))
    if keep is not None:
        nodes, share = keep(nodes, "nodes"), keep(share, "share")
    for step in range(iterations):
        if keep is not None and step and step % every == 0:
            rank = keep(rank, "rank")
        flow = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("x"))
        held = flow.agg((1 - F.coalesce(F.sum("x"), F.lit(0.0))).alias("lost"))
        rank = nodes.join(flow, "node", "left").crossJoin(F.broadcast(held)).select("node", ((1 - damping) / total + damping * (F.coalesce("x", F.lit(0.0)) + F.col("lost") / total)).alias("rank"))  # held: one row
    return rank


def k_core(edges: DataFrame, keep: Keep, most: int = 10_000) -> DataFrame:
    """node, core. Every node's number starts as its degree and becomes the largest h such that h neighbours have h or more,
    until nothing changes: few rounds, where peeling would take one for each layer. More than most rounds raise an error. The rounds go over
    blocks of links; by joins where there are more than blocks.MOST_NODES."""
    links = edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct()
    links = keep(links, "links")
    every = blocks.numbered(links.select("node").distinct())
    if (n := every.count()) <= blocks.MOST_NODES:
        table, _ = blocks.blocked(keep(blocks.coded(links, every, node="u", other="v").select(F.lit(0).alias("key"), "u", "v", F.lit(1.0).alias("w")), "links"), n)
        found = blocks.by_node(edges.sparkSession, "code long, core long", n, [blocks.core_numbers(table, n, most).astype("int64")])
        return every.join(found, "code").select("node", "core")
    return core_by_joins(links, keep, most)


def core_by_joins(links: DataFrame, keep: Keep, most: int) -> DataFrame:
    """The same from node, other: each round is a join and a window over all links."""
    cores = keep(links.groupBy("node").agg(F.count("*").cast("long").alias("core")), "core")
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("core")))
    for _ in range(most):
        near = links.join(cores.withColumnRenamed("node", "other"), "other").select("node", "core", place.alias("place"))
        new = near.groupBy("node").agg(F.max(F.least("core", F.col("place").cast("long"))).alias("new"))
        found = keep(cores.join(new, "node").select("node", F.col("new").alias("core"), (F.col("new") < F.col("core")).alias("moved")), "core")
        cores = found.select("node", "core")
        if found.where("moved").isEmpty():
            return cores
    raise RuntimeError(f"core numbers not settled after {most} rounds")
