"""What a change of hours means: who is active when, periods, paired and grouped controls, sittings in order of the alphabet, and the
verdicts that their numbers are taken for."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import replicates, survival

# The sentences and thresholds of the verdicts.
PAIRED = {"few": "insufficient_paired_handles", "moved": "the same handles moved their own hours; this is not population turnover", "not": "no consistent within-handle shift"}
PERIODS = {"spike": "the evening concentration belongs to the spike, not to a baseline schedule", "stable": "the before period has a stable schedule"}
GROUPS = {"same": "the shift is the same on a wiki with no administrator, so it is not avoidance", "specific": "the shift is specific to the policed wiki"}
ORDER = {"not": "deletions were not systematically alphabetical", "ordered": "deletions show alphabetical ordering"}


def all_hours(counts: DataFrame) -> DataFrame:
    """hour 0 to 23, n: of counts (hour, n), 0 where there is none."""
    hours = counts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))  # 24 rows


def hours_of(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by, F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def peak(n: str = "n") -> Column:
    """The hour with the most rows, the earliest of equals."""
    return F.min_by("hour", F.struct(-F.col(n), F.col("hour")))


def headline(events: DataFrame, after: Column, offset: int = 0) -> DataFrame:
    """after: whether a save lies behind the boundary. One row: the hours with removals (active_hours, silent_hours, joined by commas; the silent
    window from the first silent hour to the end of the last, in UTC and so many hours from it), peak_hour and peak_share of removals,
    and of saves before and after their number, share in active hours and peak hour."""
    gone = all_hours(hours_of(events.where("kind = 'delete'"))).withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())))  # 24 rows
    listed = lambda keep: F.array_join(F.sort_array(F.collect_list(F.when(keep, F.col("hour")))), ",")
    silent = F.col("n") == 0
    low, high = F.min(F.when(silent, F.col("hour"))), F.max(F.when(silent, F.col("hour"))) + 1
    hours = gone.agg(
        listed(~silent).alias("active_hours"), listed(silent).alias("silent_hours"), low.alias("silent_from"), high.alias("silent_until"),
        F.pmod(low + offset, F.lit(24)).alias("silent_from_local"), F.pmod(high + offset, F.lit(24)).alias("silent_until_local"), peak().alias("peak_hour"), F.round(F.max("share"), 6).alias("peak_share"),
    )
    era = F.when(after, "after").otherwise("before")
    saves = hours_of(events.where("kind = 'save'"), era.alias("era")).join(F.broadcast(gone.select("hour", (F.col("n") > 0).alias("active"))), "hour")  # 24 rows
    each = saves.groupBy("era").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("active"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"), peak().alias("peak"))
    wide = each.agg(*[F.max(F.when(F.col("era") == e, F.col(c))).alias(f"{name}_{e}") for c, name in (("n", "writes"), ("share", "share_in_active"), ("peak", "peak_hour")) for e in ("before", "after")])
    return hours.crossJoin(wide)  # one row each


def period_summary(events: DataFrame, periods: dict[str, Column], evening: tuple[int, int] = (18, 21), night: tuple[int, int] = (1, 7)) -> DataFrame:
    """periods: conditions on a save by name; they may overlap. For each with saves: period, writes, exposure (mean risk of their hours),
    peak_hour, evening_share, night_share, top3_hours (joined by commas, the most frequent first) and top3_share."""
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in periods.items()]))
    counts = hours_of(events.where("kind = 'save'").withColumn("period", F.explode(names)), "period").join(F.broadcast(survival.hourly_risk(events)), "hour", "left")  # 24 rows
    placed = counts.withColumn("place", F.row_number().over(W.partitionBy("period").orderBy(F.desc("n"), "hour")))  # 24 rows a period
    total, top = F.sum("n"), F.col("place") <= 3
    between = lambda a, b: F.round(F.sum(F.when(F.col("hour").between(a, b), F.col("n")).otherwise(0)) / total, 6)
    first = F.transform(F.array_sort(F.collect_list(F.when(top, F.struct("place", "hour")))), lambda x: x["hour"])
    return placed.groupBy("period").agg(
        total.alias("writes"), F.round(F.sum(F.col("n") * F.coalesce("risk", F.lit(0.0))) / total, 8).alias("exposure"), peak().alias("peak_hour"), between(*evening).alias("evening_share"), between(*night).alias("night_share"),
        F.array_join(first, ",").alias("top3_hours"), F.round(F.sum(F.when(top, F.col("n")).otherwise(0)) / total, 6).alias("top3_share"),
    )


def baseline_verdict(periods: DataFrame, before: str, spike: str, times: float = 3) -> DataFrame:
    """periods: of period_summary. spike_share (of the saves of both periods) and verdict: whether the evening share of the spike is more than so many
    times that of the time before it."""
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("period") == k, F.col(c))), F.lit(0))
    share = F.round(F.try_divide(at(spike, "writes"), at(spike, "writes") + at(before, "writes")), 6)
    return periods.agg(share.alias("spike_share"), F.when(at(spike, "evening_share") > times * at(before, "evening_share"), PERIODS["spike"]).otherwise(PERIODS["stable"]).alias("verdict"))


def group_counts(events: DataFrame, group: Column, first: Column, second: Column) -> DataFrame:
    """group, hour, risk, a, b: saves of each group in an hour before and after, and the hour's part of all removals."""
    saves = events.where("kind = 'save'").select(group.alias("group"), F.hour("ts").alias("hour"), first.alias("f"), second.alias("s"))
    counts = saves.groupBy("group", "hour").agg(F.count_if("f").alias("a"), F.count_if("s").alias("b"))
    return counts.join(F.broadcast(survival.hourly_risk(events)), "hour", "left").select("group", "hour", F.coalesce("risk", F.lit(0.0)).alias("risk"), "a", "b")  # 24 rows


def group_exposure(counts: DataFrame, least: int = 50) -> DataFrame:
    """counts: of group_counts. group, n_before, n_after, status ('tested' or, below least on either side, 'too_few_writes'), and for those that are
    tested exposure_before, exposure_after and their difference (before less after)."""
    mean = lambda n: F.try_divide(F.sum(F.col(n) * F.col("risk")), F.sum(n))
    each = counts.groupBy("group").agg(F.sum("a").alias("n_before"), F.sum("b").alias("n_after"), mean("a").alias("x"), mean("b").alias("y"))
    enough = (F.col("n_before") >= least) & (F.col("n_after") >= least)
    told = lambda c, name: F.when(enough, F.round(c, 8)).alias(name)
    return each.select("group", "n_before", "n_after", F.when(enough, "tested").otherwise("too_few_writes").alias("status"), told(F.col("x"), "exposure_before"), told(F.col("y"), "exposure_after"), told(F.col("x") - F.col("y"), "difference"))


def group_tests(counts: DataFrame, n: int = 5000, least: int = 50, seed: int = 6) -> DataFrame:
    """group_exposure with null_mean, null_std and p_value (add-one, around zero) of the difference against n shuffles of which saves of a group
    are before. A group is 24 counts, so one row of work each, however many saves."""
    import numpy as np
    import pandas as pd

    def one(pdf):
        import zlib

        pdf, out = pdf.sort_values("hour"), {"group": pdf.group.iloc[0], "null_mean": None, "null_std": None, "p_value": None}
        a, b, risk = pdf.a.to_numpy(np.int64), pdf.b.to_numpy(np.int64), pdf.risk.to_numpy(float)
        if a.sum() >= least and b.sum() >= least:
            rng = np.random.default_rng([seed, zlib.crc32(str(out["group"]).encode())])
            first = rng.multivariate_hypergeometric(a + b, int(a.sum()), size=n, method="marginals")
            null = first @ risk / a.sum() - (a + b - first) @ risk / b.sum()
            seen = float(a @ risk / a.sum() - b @ risk / b.sum())
            out |= {"null_mean": null.mean(), "null_std": null.std(ddof=1), "p_value": (float((np.abs(null) >= abs(seen)).sum()) + 1) / (n + 1)}
        return pd.DataFrame([out])

    kind = dict(counts.dtypes)["group"]
    tests = counts.groupBy("group").applyInPandas(one, f"group {kind}, null_mean double, null_std double, p_value double")
    return group_exposure(counts, least).join(tests, "group")


def group_verdict(tests: DataFrame, policed: str, unpoliced: str, level: float = 0.05) -> DataFrame:
    """tests: of group_tests. verdict: whether the groups with and without removals shift alike."""
    at = lambda k, c, otherwise: F.coalesce(F.max(F.when(F.col("group") == k, F.col(c))), F.lit(otherwise))
    same = (at(policed, "p_value", 1.0) < level) & (at(unpoliced, "p_value", 1.0) < level) & (at(unpoliced, "difference", 0.0) > 0)
    return tests.agg(F.when(same, GROUPS["same"]).otherwise(GROUPS["specific"]).alias("verdict"))


def paired_verdict(paired: DataFrame, tests: DataFrame, least: int = 5, share: float = 0.75, level: float = 0.01) -> DataFrame:
    """paired: of paired_exposure; tests: one row with p_value. actors, mean exposures, lowered (how many actors), p_value, verdict: whether more than
    share of the actors lowered their exposure, and the test says so too."""
    one = paired.agg(F.count("*").alias("actors"), F.round(F.avg("exposure_before"), 8).alias("mean_before"), F.round(F.avg("exposure_after"), 8).alias("mean_after"), F.count_if(F.col("exposure_after") < F.col("exposure_before")).alias("lowered"))
    both = one.crossJoin(tests.select("p_value"))  # one row each
    moved = (F.try_divide("lowered", "actors") > share) & (F.col("p_value") < level)
    return both.withColumn("verdict", F.when(F.col("actors") < least, PAIRED["few"]).when(moved, PAIRED["moved"]).otherwise(PAIRED["not"]))


def sittings(rows: DataFrame, gap_s: float, keep) -> DataFrame:
    """rows: ts, id and whatever, in one order of time. Adds sitting: how many gaps of more than gap_s lie before the row. Rows are dealt by ranges of
    time; a row for each range carries its end and how many gaps it has to the next, so no task has them all."""
    ranged = keep(rows.repartitionByRange("ts", "id").withColumn("_range", F.spark_partition_id()), "ranged")
    along = W.partitionBy("_range").orderBy("ts", "id")
    us = F.unix_micros("ts")
    own = ranged.withColumn("_new", F.coalesce((us - F.lag(us).over(along) > int(gap_s * 1_000_000)).cast("int"), F.lit(0)))
    own = own.withColumn("_inner", F.sum("_new").over(along))
    ends = own.groupBy("_range").agg(F.min(us).alias("first"), F.max(us).alias("last"), F.sum("_new").alias("n"))
    order = W.orderBy("_range")
    border = F.coalesce((F.col("first") - F.lag("last").over(order) > int(gap_s * 1_000_000)).cast("int"), F.lit(0))
    before = ends.withColumn("border", border).select("_range", (F.sum(F.col("border")).over(order) + F.sum("n").over(order) - F.col("n")).alias("_before"))  # a row for each range
    return own.join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_inner") + F.col("_before")).cast("long").alias("sitting"))


def alphabet_in_sittings(rows: DataFrame, letter: Column, gap_s: float, keep, least: int = 40) -> DataFrame:
    """rows: ts, id and whatever letter (0 to 25) needs; rows without a letter don't count. For sittings of least rows and more than one letter:
    sitting, n, started_us, rho (Spearman's, of letter and place in the sitting)."""
    from ..functions.ranks import spearman

    lettered = rows.withColumn("letter", letter).where("letter is not null").select("ts", "id", "letter")
    sat = sittings(lettered, gap_s, keep)
    placed = sat.withColumn("place", F.row_number().over(W.partitionBy("sitting").orderBy("ts", "id")))
    starts = sat.groupBy("sitting").agg(F.min(F.unix_micros("ts")).alias("started_us"))
    found = spearman(placed, "place", "letter", "sitting").where((F.col("n") >= least) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    return found.join(starts, "sitting").select("sitting", "n", "started_us", "rho")


def alphabet_verdict(found: DataFrame, least: float = 0.3, strong: float = 0.5) -> DataFrame:
    """found: of alphabet_in_sittings. sittings, median_rho, strongly_alphabetical, strongly_reverse, verdict."""
    one = found.agg(F.count("*").alias("sittings"), F.round(F.median("rho"), 6).alias("median_rho"), F.count_if(F.col("rho") > strong).alias("strongly_alphabetical"), F.count_if(F.col("rho") < -strong).alias("strongly_reverse"))
    return one.withColumn("verdict", F.when(F.coalesce(F.col("median_rho") < least, F.lit(False)), ORDER["not"]).otherwise(ORDER["ordered"]))
