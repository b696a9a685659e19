"""Degree-preserving rewiring by joins, for networks that no task holds: swaps of two edges' ends are proposed for all edges at once in
random pairs; a swap that would make a loop, an edge that is there, or an edge that another swap makes too is not done, and its edges
are in other pairs in the next round. Many copies of a network go through the same rounds."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Keep = Callable[[DataFrame, str], DataFrame]
#: Edges that are dealt into a group on average; pairs are made within groups.
GROUP = 64


def swapped(edges: DataFrame, n: int, keep: Keep, directed: bool = False, per_edge: float = 1.0, rounds: int = 40, seed: int = 1) -> tuple[DataFrame, list[tuple[int, float]]]:
    """edges: a, b (a < b unless directed), distinct, without loops. copy (0 to n - 1), a, b of n rewired copies, and for each copy how many
    swaps were done for each edge: rounds go on until per_edge on average over the copies, or as many as are allowed (networks
    on which hardly a swap is possible stay as they are)."""
    m = edges.count()
    rows = edges.select("a", "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # an edge keeps its number, which is a hash of what it was at first
    state = keep(rows.select("copy", F.xxhash64("a", "b").alias("id"), "a", "b"), "swaps")
    done: dict[int, int] = dict.fromkeys(range(n), 0)
    for step in range(rounds):
        if m < 2 or sum(done.values()) >= per_edge * m * n:
            break
        chance = lambda k: F.xxhash64("copy", "id", "a", "b", F.lit(seed * 1_000_003 + 7 * step + k))  # noqa: E731, B023
        group = F.pmod(chance(0), F.lit(max(1, m // GROUP))).alias("group")
        dealt = state.select("copy", group, "id", "a", "b", chance(1).alias("u"))
        place = F.row_number().over(W.partitionBy("copy", "group").orderBy("u", "id")) - 1
        pair = dealt.withColumn("place", place).withColumn("pair", F.expr("place div 2"))
        first = F.struct("id", "a", "b", "u")
        two = pair.groupBy("copy", "group", "pair").agg(F.min(F.struct("place", first.alias("e"))).alias("p"), F.max(F.struct("place", first.alias("e"))).alias("q")).where("p.place < q.place")
        u, v, s, t = (F.col(c) for c in ("p.e.a", "p.e.b", "q.e.a", "q.e.b"))
        turn = F.lit(False) if directed else F.pmod(F.col("p.e.u"), F.lit(2)) == 0  # which end of the other edge is which
        s, t = F.when(turn, t).otherwise(s), F.when(turn, s).otherwise(t)
        ends = (lambda x, y: (x, y)) if directed else (lambda x, y: (F.least(x, y), F.greatest(x, y)))
        (a1, b1), (a2, b2) = ends(u, t), ends(s, v)
        wish = two.select("copy", F.xxhash64("copy", "group", "pair", F.lit(step)).alias("swap"), F.col("p.e.id").alias("id1"), F.col("q.e.id").alias("id2"), a1.alias("a1"), b1.alias("b1"), a2.alias("a2"), b2.alias("b2"), (u == t).alias("loop"), (s == v).alias("loop2"))
        wish = keep(wish.where("not loop and not loop2 and not (a1 = a2 and b1 = b2)").drop("loop", "loop2"), "wishes")
        made = wish.select("copy", "swap", F.explode(F.array(*[F.struct(F.col(f"id{i}").alias("id"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i in (1, 2)])).alias("e")).select("copy", "swap", "e.*")
        # an edge that is there is in the way, and so is a second swap that makes the same one
        there = state.select("copy", "a", "b", F.lit(True).alias("there"))
        seen = made.join(there, ["copy", "a", "b"], "left")
        clash = seen.withColumn("best", F.min("swap").over(W.partitionBy("copy", "a", "b")))
        bad = clash.where("there or swap <> best").select("copy", "swap").distinct()
        good = keep(made.join(bad, ["copy", "swap"], "left_anti").select("copy", "id", F.col("a").alias("na"), F.col("b").alias("nb")), "good")
        state = keep(state.join(good, ["copy", "id"], "left").select("copy", "id", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")), "swaps")
        for r in good.groupBy("copy").agg(F.expr("count(*) div 2").alias("k")).collect():  # a number a copy
            done[r["copy"]] += r.k
    return state.select("copy", "a", "b"), [(i, k / max(1, m)) for i, k in done.items()]


def kept_share(edges: DataFrame, copies: DataFrame) -> DataFrame:
    """copy, kept: which share of the edges is still there in each copy."""
    m = edges.select("a", "b").distinct().count()
    there = copies.join(edges.select("a", "b").distinct(), ["a", "b"], "left_semi").groupBy("copy").agg(F.count("*").alias("k"))
    return copies.select("copy").distinct().join(there, "copy", "left").select("copy", F.round(F.coalesce("k", F.lit(0)) / max(1, m), 6).alias("kept"))


def copies_statistics(copies: DataFrame) -> DataFrame:
    """copies: copy, a < b, distinct. replicate, transitivity, assortativity of each copy (0 where they aren't defined): all copies in the
    same joins, wedges from the end with fewer edges."""
    ends = copies.select("copy", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("copy", "e.*")
    d = ends.groupBy("copy", "node").agg(F.count("*").alias("d"))
    at = lambda node, name: d.select("copy", F.col("node").alias(node), F.col("d").alias(name))
    both = copies.join(at("a", "da"), ["copy", "a"]).join(at("b", "db"), ["copy", "b"])
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = both.select("copy", F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = arcs.join(arcs.withColumnRenamed("y", "z"), ["copy", "x"]).where("y <> z").select("copy", "y", "z")
    closed = wedge.join(arcs.select("copy", F.col("x").alias("y"), F.col("y").alias("z")), ["copy", "y", "z"]).groupBy("copy").agg(F.count("*").alias("triangles"))
    triples = d.groupBy("copy").agg(F.sum(F.expr("d * (d - 1) div 2")).alias("triples"))
    # both orientations of an edge: sums of degrees at its ends
    x, y = F.col("da").cast("double"), F.col("db").cast("double")
    mixing = both.groupBy("copy").agg(F.sum(F.lit(2.0)).alias("n"), F.sum(x + y).alias("s"), F.sum(x * x + y * y).alias("ss"), F.sum(2 * x * y).alias("xy"))
    rho = F.try_divide(F.expr("n * xy - s * s"), F.expr("n * ss - s * s"))
    out = triples.join(mixing, "copy").join(closed, "copy", "left")
    return out.select(F.col("copy").cast("long").alias("replicate"), F.coalesce(F.try_divide(3.0 * F.coalesce("triangles", F.lit(0)), "triples"), F.lit(0.0)).alias("transitivity"), F.coalesce(rho, F.lit(0.0)).alias("assortativity"))
