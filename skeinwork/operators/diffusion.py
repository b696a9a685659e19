"""Adoption and diffusion: first uses, curves, half-lives, exposure through a network."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import replicates


def first_use(uses: DataFrame, item: str, actor: str) -> DataFrame:
    """uses: item, actor, ts. The first time of each pair, as us."""
    return uses.groupBy(item, actor).agg(F.min(F.unix_micros("ts")).alias("first_us"))


def adoption_curve(firsts: DataFrame, item: str, least: int = 20) -> DataFrame:
    """item, hour_us, adopters so far: hourly and dense, for items with enough adopters."""
    hour = F.col("first_us") - F.pmod("first_us", F.lit(3_600_000_000))
    counts = firsts.groupBy(item, hour.alias("hour_us")).agg(F.count("*").alias("n"))
    spans = counts.groupBy(item).agg(F.min("hour_us").alias("a"), F.max("hour_us").alias("b"), F.sum("n").alias("all")).where(F.col("all") >= least)
    grid = spans.select(item, F.explode(F.sequence("a", "b", F.lit(3_600_000_000))).alias("hour_us"))
    full = grid.join(counts, [item, "hour_us"], "left")
    return full.select(item, "hour_us", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(item).orderBy("hour_us")).alias("adopters"))


def half_life(curve: DataFrame, item: str) -> DataFrame:
    """item, final adopters, hours until half of them."""
    top = curve.withColumn("final", F.max("adopters").over(W.partitionBy(item)))
    half = F.min(F.when(F.col("adopters") * 2 >= F.col("final"), F.col("hour_us")))
    return top.groupBy(item).agg(F.max("final").alias("final"), ((half - F.min("hour_us")) / 3_600_000_000).cast("long").alias("half_hours"))


def token_diffusion(uses: DataFrame, top: int = 25) -> DataFrame:
    """uses: token, actor, at (a number of hours). Distinct actors, first and last first use, the span between, and actors a day of
    it (of a millionth of an hour at least), for the most widely used tokens."""
    firsts = uses.groupBy("token", "actor").agg(F.min("at").alias("at"))
    each = firsts.groupBy("token").agg(F.count("*").alias("n_actors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    each = each.withColumn("span_h", F.col("last_at") - F.col("first_at"))
    each = each.withColumn("per_day", F.round(F.col("n_actors") * 24 / F.greatest(F.col("span_h").cast("double"), F.lit(1e-6)), 4))
    return each.orderBy(F.desc("n_actors"), "token").limit(top)


def exposed_share(firsts: DataFrame, edges: DataFrame, item: str, least: int = 10) -> DataFrame:
    """firsts: item, actor, first_us; edges: src, dst (either direction counts). For each item with enough adopters: adopters,
    those with a neighbour that adopted before them, their share, and edges among adopters. Adopters are never joined with their
    neighbours: each task holds the network and looks an item's links up."""
    near = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    rows = replicates.exposed_counts(firsts.select(item, "actor", "first_us"), item, near)
    return rows.where(F.col("adopters") >= least).withColumn("exposed_share", F.round(F.col("exposed") / F.col("adopters"), 6))


# What the tests of an item's exposure are taken to say.
VERDICTS = {
    "few": "insufficient_adopters",
    "both": "spread along network ties",
    "exposure": "partial: exposure elevated, ordering not",
    "order": "outward from source, exposure not elevated",
    "neither": "no transmission signal",
}


def exposure_tests(firsts: DataFrame, item: str, edges: DataFrame, n: int = 200, least: int = 10) -> DataFrame:
    """firsts: item, actor, first_us; edges: a < b. For every item: adopters in the network, and of exposed adoptions, of rank against hops from
    the first and of edges inside the observed value, z and p against n shuffles; and a verdict ('insufficient_adopters' below least,
    where the values are null). One job for all items."""
    found = replicates.exposure_scores(firsts, item, edges, n, least)
    high = lambda k: F.coalesce((F.col(f"{k}_z") > 2) & (F.col(f"{k}_p") < 0.05), F.lit(False))
    said = F.when(F.col("adopters") < least, VERDICTS["few"]).when(high("exposed") & high("rho"), VERDICTS["both"]).when(high("exposed"), VERDICTS["exposure"])
    return found.withColumn("verdict", said.when(high("rho"), VERDICTS["order"]).otherwise(VERDICTS["neither"]))


def exposure_test(firsts: DataFrame, edges: DataFrame, n: int = 200, least: int = 10) -> DataFrame:
    """The same for one item: firsts: actor, first_us. No rows where there are no adopters."""
    return exposure_tests(firsts.withColumn("item", F.lit("item")), "item", edges, n, least).drop("item")
