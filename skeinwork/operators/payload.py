"""The sections of pages about a log: tables of their own, put together from the operators; files.write_payload writes them, and
files.inlined puts them into a page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import activity, controls, diffusion, populations, structure, survival


def meta(log: DataFrame, people: DataFrame) -> DataFrame:
    """log: actor, place, ts, kind; people: the saves that count as actors'. One row: saves, places, actors, first_us, last_us."""
    saves = log.where("kind = 'save'")
    one = saves.agg(F.count("*").alias("saves"), F.countDistinct("place").alias("places"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    return one.crossJoin(people.agg(F.countDistinct("actor").alias("actors"))).select("saves", "places", "actors", "first_us", "last_us")  # one row each


def brokers(centrality: DataFrame, least: int = 3, most: int = 25) -> DataFrame:
    """centrality: of centrality_table. The nodes of at least so many links whose rank by betweenness is furthest above that by degree."""
    return centrality.where((F.col("degree") >= least) & F.col("brokerage").isNotNull()).orderBy(F.desc("brokerage"), F.desc("betweenness"), "node").limit(most)


def network_sections(log: DataFrame, people: DataFrame, pairs: DataFrame, edges: DataFrame, nodes: DataFrame, keep, most_links: int = 1500, least: int = 20) -> dict[str, DataFrame]:
    """The page about the network: meta, timeline (by day), percolation (every third bucket), nodes and links of the heaviest edges, adoption (by hour,
    of places with least adopters) and brokers."""
    firsts = diffusion.first_use(people, "place", "actor")
    shown, links = structure.graph_payload(edges, nodes, most_links)
    return {
        "meta": meta(log, people),
        "timeline": activity.series(log, "day"),
        "percolation": populations.thinned(structure.percolation(pairs), "bucket_us"),
        "nodes": shown,
        "links": links.select("src", "dst", "weight"),
        "adoption": diffusion.adoption_curve(firsts, "place", least),
        "brokers": brokers(structure.centrality_table(edges, keep)),
    }


def removal_sections(log: DataFrame, rows: DataFrame, home: str, group: Column) -> dict[str, DataFrame]:
    """The page about removals; rows: of survival.flagged. survival_curves by group, tactics, gaps of places removed again and again, epoch (how many
    names end in a time, by wiki, and how many of these are gone)."""
    marked = rows.where("epoch_suffix").groupBy("wiki").agg(F.count("*").alias("n"), F.count("died_us").alias("gone"))
    return {"survival_curves": survival.kaplan_meier(rows, group), "tactics": survival.by_tactic(rows, home), "gaps": survival.removal_gaps(log), "epoch": marked, "rewrites": survival.latency_summary(survival.rewrites(log))}


def hours_sections(log: DataFrame, after: Column, periods: dict[str, Column], group: Column, offset: int = 0) -> dict[str, DataFrame]:
    """The page about hours: headline, day_hour, periods and groups before and after."""
    return {"headline": controls.headline(log, after, offset), "day_hour": activity.day_hour(log), "periods": controls.period_summary(log, periods), "groups": controls.group_tests(controls.group_counts(log, group, ~after, after))}
