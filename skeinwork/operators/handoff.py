"""Handoffs: who saves a place next after whom, as pairs, as a graph, and under different windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written


def seconds(a, b):
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def handoff_pairs(events: DataFrame, window_s: float | None = 6 * 3600) -> DataFrame:
    """events: id, ts, actor, place. Each event whose predecessor at the place (by time, then id) is another actor's and at
    most window_s seconds older. Returns source, target, place, ts, id, gap_seconds. One shuffle, by place."""
    order = W.partitionBy("place").orderBy("ts", "id")
    pairs = events.select("place", "ts", "id", F.col("actor").alias("target"), F.lag("actor").over(order).alias("source"), seconds(F.lag("ts").over(order), F.col("ts")).alias("gap_seconds"))
    pairs = pairs.where("source is not null and target is not null and source <> target")
    return pairs if window_s is None else pairs.where(F.col("gap_seconds") <= window_s)


def handoff_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, weight, n_places, first_us, last_us, median_gap_us."""
    return pairs.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(
        F.count("*").alias("weight"), F.countDistinct("place").alias("n_places"), F.min(F.unix_micros("ts")).alias("first_us"),
        F.max(F.unix_micros("ts")).alias("last_us"), F.median(F.round(F.col("gap_seconds") * 1e6)).alias("median_gap_us"),
    )


def handoff_nodes(pairs: DataFrame) -> DataFrame:
    """node, n_events, first_us, last_us: each pair touches both its ends."""
    ends = pairs.select(F.explode(F.array("source", "target")).alias("node"), "ts")
    return ends.groupBy("node").agg(F.count("*").alias("n_events"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))


def describe(edges: DataFrame, directed: bool = True) -> DataFrame:
    """n_nodes, n_edges, total_weight, density of src, dst, weight."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("n_nodes"))
    sums = edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight"))
    n = F.col("n_nodes").cast("double")
    ratio = F.col("n_edges") * (1 if directed else 2) / F.nullif(n * (n - 1), F.lit(0.0))
    return nodes.crossJoin(sums).withColumn("density", F.round(F.coalesce(F.when(n > 1, ratio), F.lit(0.0)), 6))  # one row each


def sensitivity(events: DataFrame, windows: dict[str, float | None]) -> DataFrame:
    """One row for each window: n_events, n_edges, n_nodes, density, reciprocity. Each two actors are one row for all windows: the
    shortest gap each way says which windows have the edge, so no row is made for a window."""
    gap, up = F.coalesce("gap_seconds", F.lit(float("inf"))), F.col("source") < F.col("target")
    fits = lambda gap, s: gap.isNotNull() if s is None else F.coalesce(gap <= s, F.lit(False))
    limits, one = list(windows.values()), lambda c: c.cast("long")
    both = handoff_pairs(events, None).groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(
        F.min(F.when(up, gap)).alias("up"), F.min(F.when(~up, gap)).alias("down"), *[F.count_if(fits(gap, s)).alias(f"n{i}") for i, s in enumerate(limits)],
    )
    both, there = written(both, "gaps"), lambda s: (fits(F.col("up"), s), fits(F.col("down"), s))
    counts = both.agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(limits))], *[F.sum(one(there(s)[0]) + one(there(s)[1])).alias(f"e{i}") for i, s in enumerate(limits)],
        *[F.count_if(there(s)[0] & there(s)[1]).alias(f"m{i}") for i, s in enumerate(limits)],
    )
    nearest = both.select(F.explode(F.array("lo", "hi")).alias("node"), F.least("up", "down").alias("gap")).groupBy("node").agg(F.min("gap").alias("gap"))
    nodes = nearest.agg(*[F.count_if(fits(F.col("gap"), s)).alias(f"v{i}") for i, s in enumerate(limits)])
    rows = [F.struct(F.lit(name).alias("window"), F.col(f"n{i}").alias("n_events"), F.col(f"e{i}").alias("n_edges"), F.col(f"v{i}").alias("n_nodes"), F.col(f"m{i}").alias("m")) for i, name in enumerate(windows)]
    each, n = counts.crossJoin(nodes).select(F.inline(F.array(*rows))).where("n_events > 0"), F.col("n_nodes")  # one row each
    return each.select("window", "n_events", "n_edges", "n_nodes", F.round(F.col("n_edges") / (n * (n - 1)), 6).alias("density"), F.round(2 * F.col("m") / F.col("n_edges"), 6).alias("reciprocity"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of directed edges whose reverse is there too, loops left out."""
    ways = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.count("*").alias("ways"))
    return ways.agg(F.sum("ways").alias("n_edges"), F.coalesce(F.sum(F.when(F.col("ways") == 2, 2).otherwise(0)), F.lit(0)).cast("long").alias("n_mutual")).withColumn("reciprocity", F.round(F.col("n_mutual") / F.col("n_edges"), 6))


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree, weighted_degree."""
    out, into = F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "weight"), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "weight")
    ends = edges.select(F.explode(F.array(out, into)).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
