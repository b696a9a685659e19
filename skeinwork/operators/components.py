"""Weakly connected components by alternating stars, without collecting anything."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def large_star(edges: DataFrame) -> DataFrame:
    """Link each vertex's larger neighbours to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    around = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return around.where("a <> b").distinct()


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], most_rounds: int = 60) -> DataFrame:
    """edges: a, b (any orderable type, loops and repeats allowed). Returns id, root for each vertex that has an edge to
    another: root is the smallest vertex of its component. keep(df, name) stores a round's edges where every
    executor can read them and cuts the lineage. The number of rounds grows with the logarithm of the longest path."""
    state = keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
        state = keep(small_star(large_star(state)), "edges")
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = state.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
