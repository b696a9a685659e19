"""What happens to places after saves and removals: rewrites, repeated removals, survival, exposure."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranks import mann_whitney, p_values, rank_sums


def rewrites(events: DataFrame) -> DataFrame:
    """Each removal with the first save of its place strictly after it: place, removal (id), deleted_us, saved_us,
    actor, latency_us. One window over both kinds by place, latest first; at equal times the removal comes first, so its
    own instant's saves don't count. No join, so nothing multiplies."""
    both = events.where("kind in ('save', 'delete')").select("place", "id", "ts", "kind", "actor", F.when(F.col("kind") == "delete", 0).otherwise(1).alias("late"))
    order = W.partitionBy("place").orderBy(F.desc("ts"), "late", F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    save = F.last(F.when(F.col("kind") == "save", F.struct(F.unix_micros("ts").alias("us"), "actor", "id")), True).over(order)
    found = both.withColumn("next", save).where("kind = 'delete' and next is not null")
    return found.select("place", F.col("id").alias("removal"), F.unix_micros("ts").alias("deleted_us"), F.col("next.us").alias("saved_us"), F.col("next.actor").alias("actor"), (F.col("next.us") - F.unix_micros("ts")).alias("latency_us"))


def latency_summary(found: DataFrame, within_s: tuple[int, ...] = (60, 3600, 86400)) -> DataFrame:
    us = "latency_us"
    return found.agg(F.count("*").alias("n"), F.median(us).alias("median_us"), F.round(F.percentile(us, F.lit(0.1)), 1).alias("p10_us"), F.round(F.percentile(us, F.lit(0.9)), 1).alias("p90_us"), F.countDistinct("actor").alias("responders"), *[F.count_if(F.col(us) <= s * 1_000_000).alias(f"within_{s}s") for s in within_s])


def multi_delete(events: DataFrame) -> DataFrame:
    """Places removed more than once: n and the smallest gap between removals."""
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(W.partitionBy("place").orderBy("ts", "id")))
    gone = events.where("kind = 'delete'").withColumn("gap", gap)
    return gone.groupBy("place").agg(F.count("*").alias("n_deletes"), F.min("gap").alias("fastest_us"), F.max("gap").alias("slowest_us")).where("n_deletes > 1")


def removal_gaps(events: DataFrame, most: int = 20) -> DataFrame:
    """For the most places that were removed most often, more than once (ties by place): place, removals, first_us, last_us, gaps_us (between its
    removals, in order) and fastest_us."""
    gone, us = events.where("kind = 'delete'"), F.unix_micros("ts")
    top = gone.groupBy("place").agg(F.count("*").alias("removals")).where("removals > 1").orderBy(F.desc("removals"), "place").limit(most)
    # only the removals of those places are listed
    times = gone.join(F.broadcast(top), "place").groupBy("place", "removals").agg(F.sort_array(F.collect_list(us)).alias("at"))  # most rows
    gaps = F.expr("transform(sequence(1, size(at) - 1), i -> at[i] - at[i - 1])")
    return times.select("place", "removals", F.array_min("at").alias("first_us"), F.array_max("at").alias("last_us"), gaps.alias("gaps_us"), F.array_min(gaps).alias("fastest_us"))


# A name's ending that is a time in seconds.
EPOCH_SUFFIX = r"1[0-9]{9}$"


def flagged(rows: DataFrame, names: DataFrame, boundary: str, home: str, letter: str = "Z", fragment: str = "zzz", epoch: str = EPOCH_SUFFIX) -> DataFrame:
    """rows: of survival; names: place, wiki, name and obfuscated (whether its texts have an escaped host). Adds wiki, name and the marks of a
    subject's name and birth: starts_with, contains, epoch_suffix, off_home, born_after, obfuscated."""
    name = F.coalesce("name", F.lit(""))
    both = rows.join(names.select("place", "wiki", "name", "obfuscated"), "place", "left")
    return both.withColumns(
        {
            "starts_with": F.upper(name).startswith(letter.upper()), "contains": F.lower(name).contains(fragment.lower()), "epoch_suffix": name.rlike(epoch), "off_home": ~F.col("wiki").eqNullSafe(F.lit(home)),
            "born_after": F.col("born_us") >= F.unix_micros(F.lit(boundary).cast("timestamp")), "obfuscated": F.coalesce("obfuscated", F.lit(False)),
        }
    )


def by_tactic(rows: DataFrame, home: str) -> DataFrame:
    """rows: of flagged. For each tactic: how many subjects have it, their share dead and median lifetime (to the log's end for those alive), over all and
    over the home wiki alone (not for the tactic of being elsewhere)."""
    tactics = {"all": F.lit(True), "starts_with": F.col("starts_with"), "contains": F.col("contains"), "epoch_suffix": F.col("epoch_suffix"), "obfuscated": F.col("obfuscated"), "off_home": F.col("off_home")}
    own = (F.col("wiki") == home) & (F.col("tactic") != "off_home")
    each = rows.select("wiki", "died_us", "lifetime_h", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tactics.items()]))).alias("tactic"))
    dead = F.col("died_us").isNotNull().cast("int")
    part = lambda cond, prefix: [F.count_if(cond).alias(f"{prefix}n"), F.round(F.avg(F.when(cond, dead)), 6).alias(f"{prefix}dead_share"), F.round(F.median(F.when(cond, F.col("lifetime_h"))), 4).alias(f"{prefix}median_h")]
    found = each.groupBy("tactic").agg(*part(F.lit(True), ""), *part(F.coalesce(own, F.lit(False)), "home_"))
    every = rows.sparkSession.createDataFrame([(k,) for k in tactics], "tactic string")
    return every.join(F.broadcast(found), "tactic", "left").na.fill(0, ["n", "home_n"])  # six rows


def week_tests(rows: DataFrame, marked, least: int = 5) -> DataFrame:
    """For weeks with enough marked subjects: week, n_marked, n_rest, u (of the marked subjects' lifetimes, of the dead and the living, against the
    others'), z and p_value (one-sided: the marked live longer; exact where a side has eight or fewer and no lifetimes are equal)."""
    found = mann_whitney(rows.withColumn("g", marked), "lifetime_h", "g", "week", ties=True).where(F.col("n1") >= least)
    return p_values(found, "mann_whitney").select("week", F.col("n1").alias("n_marked"), F.col("n2").alias("n_rest"), "u", "z", "p_value")


def removal_totals(events: DataFrame) -> DataFrame:
    """One row: places removed once, places removed repeatedly, removals, the most of one place, distinct (time, place) groups."""
    gone = events.where("kind = 'delete'")
    each = gone.groupBy("place").agg(F.count("*").alias("n"))
    totals = each.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("repeatedly"), F.coalesce(F.sum("n"), F.lit(0)).alias("removals"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return totals.crossJoin(gone.agg(F.countDistinct("ts", "place").alias("groups")))  # one row each


def iso_week(ts: Column) -> Column:
    """ISO year and week, as 2024-05: the year is that of the week's Thursday."""
    thursday = F.date_add(F.date_trunc("week", ts).cast("date"), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def survival(events: DataFrame, keys: tuple[str, ...] = ("place",)) -> DataFrame:
    """Subjects by their first save: born_us, died_us (first removal of the place not before it, or null), lifetime_h (to the
    log's end where there is none), n_saves, week (ISO year and week of birth). Keys other than place split the saves.
    Births and removals pass through one window by place, latest first, so no place's removals are held together."""
    end = events.agg(F.max(F.unix_micros("ts")).alias("end_us"))
    born = events.where("kind = 'save'").groupBy(*keys).agg(F.min("ts").alias("born"), F.count("*").alias("n_saves"), F.countDistinct("actor").alias("n_actors"))
    gone = events.where("kind = 'delete'").select("place", F.col("ts").alias("born"), F.lit(True).alias("removal"))
    both = born.withColumn("removal", F.lit(False)).unionByName(gone, allowMissingColumns=True)
    # at equal times the removal comes first on the way back
    order = W.partitionBy("place").orderBy(F.desc("born"), F.desc("removal")).rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("died_us", F.last(F.when(F.col("removal"), F.unix_micros("born")), True).over(order)).where(~F.col("removal"))
    rows = rows.crossJoin(F.broadcast(end)).withColumn("born_us", F.unix_micros("born"))  # end: one row
    life = (F.coalesce("died_us", "end_us") - F.col("born_us")) / 3.6e9
    return rows.select(*keys, "born_us", "died_us", F.round(life, 6).alias("lifetime_h"), "n_saves", "n_actors", iso_week(F.col("born")).alias("week"))


def by_flags(rows: DataFrame, flags: dict) -> DataFrame:
    """For each named flag, of the rows with it and without: n, dead, share dead, median lifetime of the dead."""
    each = rows.select("died_us", "lifetime_h", F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), v.alias("holds")) for k, v in flags.items()])).alias("f"))
    dead = F.col("died_us").isNotNull()
    return each.groupBy("f.flag", "f.holds").agg(F.count("*").alias("n"), F.count_if(dead).alias("dead"), F.round(F.avg(dead.cast("int")), 6).alias("dead_share"), F.round(F.median(F.when(dead, F.col("lifetime_h"))), 4).alias("median_h"))


def kaplan_meier(rows: DataFrame, group, horizon: int = 600, step: int = 24) -> DataFrame:
    """group_name, hours, at_risk, deaths, survival on a grid: at risk are lifetimes of at least the grid point before, deaths
    those that end in the step. Lifetimes are counted by step first, so the grid meets one row for each step."""
    slot = F.least(F.lit(horizon // step + 1), F.floor(F.col("lifetime_h") / step) + 1).cast("int")
    counts = rows.groupBy(group.alias("group_name"), slot.alias("slot")).agg(F.count("*").alias("n"), F.count_if(F.col("died_us").isNotNull()).alias("d"))
    groups = counts.select("group_name").distinct()
    grid = groups.select("group_name", F.explode(F.sequence(F.lit(0), F.lit(horizon // step))).alias("slot"))
    full = counts.join(grid, ["group_name", "slot"], "full_outer").na.fill(0, ["n", "d"])
    by = W.partitionBy("group_name")
    risk = F.sum("n").over(by.orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, 0))
    full = full.withColumn("at_risk", risk).where(F.col("slot") <= horizon // step)
    left = F.when((F.col("slot") == 0) | (F.col("at_risk") == 0), 1.0).otherwise(1 - F.col("d") / F.col("at_risk"))
    along = by.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    full = full.withColumn("left", left)
    curve = F.when(F.min("left").over(along) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("left") > 0, F.col("left")).otherwise(1.0))).over(along)))
    return full.select("group_name", (F.col("slot") * step).alias("hours"), F.when(F.col("slot") == 0, 0).otherwise(F.col("at_risk")).alias("at_risk"), F.when(F.col("slot") == 0, 0).otherwise(F.col("d")).alias("deaths"), F.round(curve, 6).alias("survival"))


def matched_weeks(rows: DataFrame, marked, least: int = 5) -> DataFrame:
    """For weeks with enough marked and other subjects: counts, shares dead, median lifetimes of the dead, and the Mann-Whitney
    U of the marked dead's lifetimes against the other dead's (null where either has none)."""
    dead = F.col("died_us").isNotNull()
    m = F.col("m")
    agg = rows.withColumn("m", marked).groupBy("week").agg(
        F.count_if(m).alias("n_marked"), F.count_if(~m).alias("n_other"), F.round(F.avg(F.when(m, dead.cast("int"))), 6).alias("dead_marked"), F.round(F.avg(F.when(~m, dead.cast("int"))), 6).alias("dead_other"),
        F.round(F.median(F.when(m & dead, F.col("lifetime_h"))), 4).alias("median_marked"), F.round(F.median(F.when(~m & dead, F.col("lifetime_h"))), 4).alias("median_other"),
    )
    u = rank_sums(rows.withColumn("g", marked).where(dead), "lifetime_h", "g", "week").select("week", "u")
    return agg.where((F.col("n_marked") >= least) & (F.col("n_other") >= least)).join(u, "week", "left")


def hourly_risk(events: DataFrame) -> DataFrame:
    """hour, risk: the hour's part of all removals."""
    counts = events.where("kind = 'delete'").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return counts.select("hour", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("risk"))


def exposure(events: DataFrame, *by) -> DataFrame:
    """n and exposure of saves: the mean risk of their hours."""
    saves = events.where("kind = 'save'").withColumn("hour", F.hour("ts")).join(F.broadcast(hourly_risk(events)), "hour", "left")  # 24 rows
    return saves.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("risk", F.lit(0.0))), 8).alias("exposure"))


def paired_exposure(events: DataFrame, era, least: int = 5) -> DataFrame:
    """Actors with enough saves in both eras: exposure before and after, and the difference."""
    each = exposure(events, F.col("actor"), era.alias("era"))
    wide = each.groupBy("actor").agg(*[F.max(F.when(F.col("era") == e, F.col(c))).alias(f"{c}_{e}") for e in ("before", "after") for c in ("n", "exposure")])
    return wide.where((F.col("n_before") >= least) & (F.col("n_after") >= least)).select("actor", "n_before", "n_after", "exposure_before", "exposure_after", F.round(F.col("exposure_after") - F.col("exposure_before"), 8).alias("difference"))
