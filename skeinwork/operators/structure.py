"""Structure of directed networks (src, dst, weight): strong components, triads, centralities, percolation, eras."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranks import compare_to_null, prefix_sums
from . import blocks, components, handoff, leiden, network, replicates, spectral
from .strong import strong_components

Keep = Callable[[DataFrame, str], DataFrame]


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def component_profile(edges: DataFrame, keep: Keep) -> DataFrame:
    """One row: nodes, and number, largest and its share of weak and of strong components."""
    weak = components.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), keep)
    weak = nodes_of(edges).join(weak.withColumnRenamed("id", "node"), "node", "left").select(F.coalesce("root", "node").alias("root"))
    strong, parts = strong_components(edges, keep), []
    for name, found in (("weak", weak), ("strong", strong)):
        sizes = found.groupBy("root").agg(F.count("*").alias("n"))
        parts.append(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_nodes"), F.count("*").alias(f"{name}_components"), F.coalesce(F.max("n"), F.lit(0)).alias(f"giant_{name}")))
    one = parts[0].crossJoin(parts[1])  # one row each
    share = lambda name: F.round(F.coalesce(F.try_divide(f"giant_{name}", "weak_nodes"), F.lit(0.0)), 6).alias(f"giant_{name}_share")
    return one.select(F.col("weak_nodes").alias("nodes"), "weak_components", "giant_weak", share("weak"), "strong_components", "giant_strong", share("strong"))


#: Class of three nodes that are all linked, from the number of mutual pairs m and their out- and in-degrees among themselves.
CLOSED = """CASE m WHEN 3 THEN '300' WHEN 2 THEN '210'
  WHEN 1 THEN CASE WHEN least(ix, iy, iz) = 0 THEN '120D' WHEN least(ox, oy, oz) = 0 THEN '120U' ELSE '120C' END
  ELSE CASE WHEN greatest(ox, oy, oz) = 1 THEN '030C' ELSE '030T' END END"""
#: Class of a node and two others that aren't linked, from its links to them: mutual (m), out (o), in (i).
OPEN = {"mm": "201", "mo": "111U", "im": "111D", "oo": "021D", "ii": "021U", "io": "021C"}
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")
#: Mutual and one-way pairs of each class with two pairs linked or three.
PAIRS_IN = {"201": (2, 0), "111U": (1, 1), "111D": (1, 1), "021D": (0, 2), "021U": (0, 2), "021C": (0, 2), "300": (3, 0), "210": (2, 1), "120D": (1, 2), "120U": (1, 2), "120C": (1, 2), "030C": (0, 3), "030T": (0, 3)}


def linked_pairs(edges: DataFrame) -> DataFrame:
    """x, y, kind of each linked pair once: x is the end with fewer links (ties by node); kind is how x is linked to y: m, o or i."""
    arcs = edges.select("src", "dst").where("src <> dst").distinct()
    up = F.col("src") < F.col("dst")
    pairs = arcs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(up.cast("int")).alias("up"), F.max((~up).cast("int")).alias("down"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    both = pairs.join(links.toDF("a", "da"), "a").join(links.toDF("b", "db"), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    turned = lambda out, back: F.when((F.col("up") + F.col("down")) == 2, "m").when(F.col("up") == 1, out).otherwise(back)
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), F.when(first, turned("o", "i")).otherwise(turned("i", "o")).alias("kind"))


def linked_triples(pairs: DataFrame) -> DataFrame:
    """pairs: linked_pairs, written. xy, xz, yz: the kinds of the links of each three nodes that are all linked, x with the fewest links. Over
    blocks of links up to blocks.MOST_NODES nodes, else by joins."""
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    if (n := ends.count()) > blocks.MOST_NODES:
        f, s, t = pairs.alias("f"), pairs.alias("s"), pairs.alias("t")
        triple = f.join(s, F.col("f.x") == F.col("s.x")).join(t, (F.col("t.x") == F.col("f.y")) & (F.col("t.y") == F.col("s.y")))
        return triple.select(F.col("f.kind").alias("xy"), F.col("s.kind").alias("xz"), F.col("t.kind").alias("yz"))
    ranked = blocks.numbered(ends.select("node", F.struct("d", "node").alias("rank")), "rank")
    links = blocks.coded(pairs, ranked, x="u", y="v").select(F.lit(0).alias("key"), "u", "v", F.instr(F.lit("moi"), F.col("kind")).alias("w"))
    found = blocks.triangles(blocks.blocked(blocks.written(links, "links"), max(1, n))[0], n)
    return found.select(*[F.substring(F.lit("moi"), F.col(c).cast("int"), F.lit(1)).alias(c) for c in ("xy", "xz", "yz")])


def triad_census(edges: DataFrame, keep: Keep) -> DataFrame:
    """triad, n for all 16 classes. Linked triples are listed once, from their node with the fewest links, so a hub's links aren't paired;
    triples with two linked pairs are what a node's links of two kinds make less those that are linked triples; those with one and
    without any come from counts of pairs and nodes."""
    pairs = keep(linked_pairs(edges), "pairs")
    n = nodes_of(edges).count()
    triple = keep(linked_triples(pairs).groupBy("xy", "xz", "yz").agg(F.count("*").alias("k")), "triples")  # 27 rows at most
    out, back = lambda c: f"int({c} in ('m', 'o'))", lambda c: f"int({c} in ('m', 'i'))"
    degrees = {"ox": (out("xy"), out("xz")), "oy": (back("xy"), out("yz")), "oz": (back("xz"), back("yz")), "ix": (back("xy"), back("xz")), "iy": (out("xy"), back("yz")), "iz": (out("xz"), out("yz"))}
    found = triple.selectExpr("k", "xy", "xz", "yz", "int(xy = 'm') + int(xz = 'm') + int(yz = 'm') AS m", *[f"{a} + {b} AS {c}" for c, (a, b) in degrees.items()]).withColumn("triad", F.expr(CLOSED))
    count, flip = dict.fromkeys(TRIADS, 0), {"m": "m", "o": "i", "i": "o"}
    corners = dict.fromkeys(OPEN, 0)
    for r in found.collect():
        count[r.triad] += r.k
        for two in ((r.xy, r.xz), (flip[r.xy], r.yz), (flip[r.xz], flip[r.yz])):
            corners["".join(sorted(two))] += r.k
    ends = pairs.select(F.col("x").alias("node"), "kind").unionByName(pairs.select(F.col("y").alias("node"), F.translate("kind", "oi", "io").alias("kind")))
    own = ends.groupBy("node").agg(*[F.count_if(F.col("kind") == k).cast("decimal(38,0)").alias(k) for k in "moi"])
    wedges = own.agg(*[F.coalesce(F.sum(F.expr(f"{a} * ({a} - 1) / 2" if a == b else f"{a} * {b}")), F.lit(0)).cast("decimal(38,0)").alias(a + b) for a, b in OPEN]).first()
    for two, triad in OPEN.items():
        count[triad] = int(wedges[two]) - corners[two]
    kinds = pairs.agg(F.count_if(F.col("kind") == "m").alias("m"), F.count_if(F.col("kind") != "m").alias("w")).first()
    mutual, one_way = (total * (n - 2) - sum(count[k] * v[i] for k, v in PAIRS_IN.items()) if n > 2 else 0 for i, total in enumerate((kinds.m, kinds.w)))
    count |= {"102": mutual, "012": one_way}
    count["003"] = n * (n - 1) * (n - 2) // 6 - sum(count.values())
    return edges.sparkSession.createDataFrame(list(count.items()), "triad string, n long")


def brokerage(rows: DataFrame) -> DataFrame:
    """rows: degree, betweenness. Adds brokerage: how much higher the node's share of ranks by betweenness is than by degree;
    null for two nodes or fewer, or where all degrees are equal. Ranks come from counts of the distinct values, dealt by ranges."""
    whole = rows.agg(F.count("*").alias("_n"), F.min("degree").alias("_low"), F.max("degree").alias("_high"))
    out = rows
    for c, name in (("betweenness", "_b"), ("degree", "_d")):
        counts = rows.groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias("t"))
        ranks = prefix_sums(counts, f"_{c}", "t").select(f"_{c}", (F.col("below_t") + (F.col("t") + 1) / 2).alias(name))
        out = out.join(ranks, out[c].eqNullSafe(ranks[f"_{c}"]), "left").drop(f"_{c}")
    out = out.crossJoin(F.broadcast(whole))  # one row
    differ = (F.col("_n") > 2) & (F.col("_low") < F.col("_high"))
    return out.withColumn("brokerage", F.when(differ, F.round((F.col("_b") - F.col("_d")) / F.col("_n"), 6))).drop("_b", "_d", "_n", "_low", "_high")


def centrality_table(edges: DataFrame, keep: Keep, most_sources: int = 500) -> DataFrame:
    """node, in_degree, out_degree, degree, weighted_degree, betweenness (of the directed network, from most_sources nodes
    where there are more), betweenness_exact, pagerank, eigenvector (of the largest weak component, else null), core, brokerage."""
    g = keep(network.undirected(edges, "weight"), "undirected")
    rows, ends = handoff.degrees(edges), edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    between = keep(replicates.betweenness(ends, most_sources, directed=True, keep=keep), "between")
    rows = rows.join(between, "node", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    exact = nodes_of(edges).count() <= most_sources
    ranks = spectral.pagerank(edges, keep).select("node", F.round("rank", 8).alias("pagerank"))
    rows = rows.withColumn("betweenness_exact", F.lit(exact)).join(keep(ranks, "pagerank"), "node", "left")
    rows = rows.join(spectral.eigenvector(g, keep), "node", "left").join(network.k_core(g, keep), "node", "left").withColumn("core", F.coalesce("core", F.lit(0)))
    return brokerage(rows)


def inner_core(edges: DataFrame, cores: DataFrame, least: int = 4, else_top: int = 150) -> DataFrame:
    """node: those of core least or more, or where there are none the else_top nodes of highest degree."""
    deep = cores.where(F.col("core") >= least).select("node")
    return deep if not deep.isEmpty() else network.degree(edges).orderBy(F.desc("degree"), "node").limit(else_top).select("node")


def heaviest(edges: DataFrame, most: int) -> DataFrame:
    """The most heavy edges, ties by their ends."""
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(most)


def graph_payload(edges: DataFrame, nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a view: the heaviest edges, and of nodes (node, whatever) those that they touch, with degrees in the
    whole network."""
    links = heaviest(edges, most)
    return nodes.join(nodes_of(links), "node", "left_semi").join(handoff.degrees(edges), "node", "left"), links


#: Rewired copies and sources of betweenness of layers of two kinds, projections and the like.
HEAVY_COPIES, HEAVY_SOURCES = 30, 300


def layer_budget(edges: int, doubled: bool, nulls: int = 200, sources: int = 500) -> tuple[int, int, int]:
    """How many rewired copies, sources of betweenness and copies for modularity a layer gets. doubled: of two kinds, or projected: such layers
    get no more than HEAVY_COPIES and HEAVY_SOURCES, and after that all the rule of null_budget."""
    asked = min(nulls, HEAVY_COPIES) if doubled else nulls
    copies = replicates.null_budget(edges, doubled, asked)
    return copies, min(sources, HEAVY_SOURCES) if doubled else sources, replicates.null_budget(edges, doubled, max(10, asked // 8))


def layer_report(layers: dict[str, tuple[DataFrame, bool, bool]], keep: Keep, nulls: int = 200) -> DataFrame:
    """layers: (edges, directed, of two kinds or projected) by name. A row for each: layer, nodes, edges, density, reciprocity (null
    where undirected), transitivity, components, giant_share, max_core and what layer_budget gives it: null_copies, sources and
    modularity_copies. A layer without edges has zeros."""
    out = None
    for name, (edges, directed, doubled) in layers.items():
        edges = keep(edges.select("src", "dst", "weight"), "layer")
        g = keep(network.undirected(edges, "weight"), "layer")
        weak = components.components(g.select("a", "b"), keep).groupBy("root").agg(F.count("*").alias("k"))
        weak = weak.agg(F.count("*").alias("components"), F.coalesce(F.max("k"), F.lit(0)).alias("giant"))
        cores = network.k_core(g, keep).agg(F.coalesce(F.max("core"), F.lit(0)).alias("max_core"))
        row = handoff.describe(edges, directed).crossJoin(handoff.reciprocity(edges).select("reciprocity")).crossJoin(network.transitivity(g).select("transitivity")).crossJoin(weak).crossJoin(cores)  # one row each
        row = row.select(
            F.lit(name).alias("layer"), F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), "density", (F.col("reciprocity") if directed else F.lit(None).cast("double")).alias("reciprocity"), "transitivity",
            "components", F.round(F.coalesce(F.try_divide("giant", "n_nodes"), F.lit(0.0)), 6).alias("giant_share"), "max_core", *[F.lit(n).alias(k) for k, n in zip(("null_copies", "sources", "modularity_copies"), layer_budget(g.count(), doubled, nulls), strict=True)],
        )
        out = row if out is None else out.unionByName(row)
    return out


def community_sizes(found: DataFrame) -> DataFrame:
    """found: resolution, node, c. A row for each resolution: n_communities, largest, singletons."""
    sizes = found.groupBy("resolution", "c").agg(F.count("*").alias("n"))
    return sizes.groupBy("resolution").agg(F.count("*").alias("n_communities"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


def community_profile(edges: DataFrame, keep: Keep, resolutions: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0), copies: int = 25, at: float = 1.0) -> DataFrame:
    """edges: a < b, w. resolution, n_communities, largest, singletons, modularity; at one resolution also what rewired copies have: there the
    network and its copies are parted by one method inside a task (in_task is what that finds in the network itself), null_mean,
    z_score and p_value say how it compares."""
    found = keep(leiden.communities(edges, keep, resolutions), "communities")
    scores = {r: network.modularity(edges, found.where(F.col("resolution") == float(r)).select("node", "c"), r).first()["modularity"] for r in resolutions}
    q = F.create_map(*[F.lit(x) for r, v in scores.items() for x in (float(r), v)])
    rows = community_sizes(found).withColumn("modularity", q[F.col("resolution")])
    seen, null = replicates.modularity_null(edges, copies)
    far = compare_to_null(null, "modularity", seen).select(F.lit(float(at)).alias("resolution"), F.col("observed").alias("in_task"), "null_mean", "z_score", "p_value")
    return rows.join(far, "resolution", "left")


def structural_break(pairs: DataFrame, marks: DataFrame, era, keep: Keep, names: tuple[str, ...] = ("before", "after"), parts: bool = True, inner: bool = True) -> DataFrame:
    """pairs: source, target, place, ts, gap_seconds; marks: ts and boolean columns. A row for each era: events, nodes, edges,
    density, reciprocity, transitivity, giant_share, mean_out_degree, max_core, modularity of the network of its pairs, and of
    its marks the share of each, and any_share. parts: whether communities are looked for; else modularity is null. inner: whether core
    numbers are; else max_core is null."""
    flags = [f for f, t in marks.dtypes if t == "boolean"]
    anyone = F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags]) if len(flags) > 1 else F.col(flags[0])
    shares = marks.groupBy(era.alias("era")).agg(*[F.round(F.avg(F.col(f).cast("int")), 6).alias(f"{f}_share") for f in flags], F.round(F.avg(anyone.cast("int")), 6).alias("any_share"))
    out = None
    whole = keep(pairs.groupBy(era.alias("era"), F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("weight")), "eras")
    for name in names:
        own = whole.where(F.col("era") == name).select("src", "dst", "weight")
        g = keep(network.undirected(own, "weight"), "era")
        roots = components.components(g.select("a", "b"), keep).groupBy("root").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("giant"))
        nothing = own.sparkSession.range(1)
        cores = network.k_core(g, keep).agg(F.coalesce(F.max("core"), F.lit(0)).alias("max_core")) if inner else nothing.select(F.lit(None).cast("long").alias("max_core"))
        quality = network.modularity(g, leiden.communities(g, keep).select("node", "c")) if parts else nothing.select(F.lit(None).cast("double").alias("modularity"))
        row = handoff.describe(own).crossJoin(handoff.reciprocity(own).select("reciprocity")).crossJoin(network.transitivity(g).select("transitivity")).crossJoin(roots).crossJoin(cores).crossJoin(quality.select("modularity"))  # one row each
        row = row.select(
            F.lit(name).alias("era"), F.col("total_weight").alias("events"), F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), "density", F.coalesce("reciprocity", F.lit(0.0)).alias("reciprocity"), "transitivity",
            F.round(F.coalesce(F.try_divide("giant", "n_nodes"), F.lit(0.0)), 6).alias("giant_share"), F.round(F.coalesce(F.try_divide("n_edges", "n_nodes"), F.lit(0.0)), 6).alias("mean_out_degree"), "max_core", "modularity",
        )
        out = row if out is None else out.unionByName(row)
    return out.join(shares, "era", "left")


def first_meetings(pairs: DataFrame) -> DataFrame:
    """a < b, us: when each two first met."""
    return pairs.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min(F.unix_micros("ts")).alias("us"))


class Union:
    """Disjoint sets with their sizes."""

    def __init__(self):
        self.parent, self.size, self.parts, self.giant = {}, {}, 0, 0

    def find(self, x):
        top = x
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, a, b) -> bool:
        """Whether they were apart."""
        for x in (a, b):
            if x not in self.parent:
                self.parent[x], self.size[x] = x, 1
                self.parts += 1
        a, b = sorted((self.find(a), self.find(b)), key=lambda x: -self.size[x])
        if a != b:
            self.parent[b] = a
            self.size[a] += self.size[b]
            self.parts -= 1
        self.giant = max(self.giant, self.size[a])
        return a != b


def forest(meetings: DataFrame) -> DataFrame:
    """Of the meetings of each task, in order of time, those that join two components: fewer than it has nodes. The others
    change no component at any time."""

    def run(parts):
        sets = Union()
        for rows in parts:
            yield rows[[sets.join(x, y) for x, y in zip(rows.a.tolist(), rows.b.tolist(), strict=True)]]

    # sorted by Spark and read batch by batch: a worker holds its sets, not its meetings
    rows = meetings.select("a", "b", "us")
    return rows.sortWithinPartitions("us", "a", "b").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def percolation(pairs: DataFrame, unit_us: int = 86_400_000_000) -> DataFrame:
    """bucket_us, nodes, unique_edges, components, giant, giant_share, mean_degree for each bucket of time with a first meeting.
    Counts are sums; components come from the tasks' forests, merged in one task, which holds a number or two for each node and reads the forests in order."""
    meetings = first_meetings(pairs)
    bucket = (F.col("us") - F.pmod("us", F.lit(unit_us))).alias("bucket_us")
    met = meetings.groupBy(bucket).agg(F.count("*").alias("e"))
    born = meetings.select(F.explode(F.array("a", "b")).alias("node"), "us").groupBy("node").agg(F.min("us").alias("us")).groupBy(bucket).agg(F.count("*").alias("v"))
    along = W.orderBy("bucket_us")
    counts = met.join(born, "bucket_us", "left").select("bucket_us", F.sum("e").over(along).alias("unique_edges"), F.sum(F.coalesce("v", F.lit(0))).over(along).alias("nodes"))

    def run(parts):
        import pandas as pd

        sets, last = Union(), None
        row = lambda at: pd.DataFrame({"bucket_us": [at], "components": [sets.parts], "giant": [sets.giant]})
        for rows in parts:
            for us, x, y in zip(rows.us.tolist(), rows.a.tolist(), rows.b.tolist(), strict=True):
                at = us - us % unit_us
                if last is not None and at != last:
                    yield row(last)
                last = at
                sets.join(x, y)
        if last is not None:
            yield row(last)

    merged = forest(forest(meetings).coalesce(8)).coalesce(1).sortWithinPartitions("us", "a", "b")
    parts = merged.mapInPandas(run, "bucket_us long, components long, giant long")
    # a bucket without a joining edge has what the one before had
    both = counts.join(parts, "bucket_us", "left")
    both = both.select("bucket_us", "nodes", "unique_edges", *[F.last(c, True).over(along.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in ("components", "giant")])
    return both.select("bucket_us", "nodes", "unique_edges", "components", "giant", (F.col("giant") / F.col("nodes")).alias("giant_share"), (2 * F.col("unique_edges") / F.col("nodes")).alias("mean_degree"))


def percolation_threshold(curve: DataFrame, least: int = 20) -> DataFrame:
    """Bucket of the steepest rise of the giant share, and where it first passes one half and the mean degree one; over buckets
    of least nodes, or all if none has so many."""
    enough = F.max("nodes").over(W.partitionBy()) >= least
    rows = curve.withColumn("_enough", enough).where(~F.col("_enough") | (F.col("nodes") >= least))
    rows = rows.withColumn("rise", F.coalesce(F.col("giant_share") - F.lag("giant_share").over(W.orderBy("bucket_us")), F.lit(0.0)))
    return rows.agg(F.max_by("bucket_us", F.struct("rise", -F.col("bucket_us"))).alias("steepest_us"), F.min(F.when(F.col("giant_share") >= 0.5, F.col("bucket_us"))).alias("half_us"), F.min(F.when(F.col("mean_degree") >= 1, F.col("bucket_us"))).alias("degree_one_us"))
