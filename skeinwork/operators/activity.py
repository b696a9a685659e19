"""Activity in time: dense series, hours of the day, sessions, burstiness, dispersion."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dense_grid(events: DataFrame, unit: str) -> DataFrame:
    """All buckets from the first to the last event, as ts."""
    span = events.agg(F.date_trunc(unit, F.min("ts")).alias("a"), F.date_trunc(unit, F.max("ts")).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bucket"))


def series(events: DataFrame, unit: str, distinct: tuple[str, ...] = ()) -> DataFrame:
    """bucket_us, saves, actors, places, cents, deletes, probes, and for each further column of saves how many values it has: dense,
    zeros where nothing happened."""
    save = F.col("kind") == "save"
    counted = events.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(
        F.count_if(save).alias("saves"), F.countDistinct(F.when(save, F.col("actor"))).alias("actors"), F.countDistinct(F.when(save, F.col("place"))).alias("places"),
        F.sum(F.when(save, F.round(F.col("value") * 100).cast("long"))).alias("cents"), F.count_if(F.col("kind") == "delete").alias("deletes"), F.count_if(F.col("kind") == "probe").alias("probes"),
        *[F.countDistinct(F.when(save, F.col(c))).alias(f"{c}_values") for c in distinct],
    )
    names = [c for c in counted.columns if c != "bucket"]
    return dense_grid(events, unit).join(counted, "bucket", "left").select(F.unix_micros("bucket").alias("bucket_us"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def conserved(events: DataFrame, dense: DataFrame) -> DataFrame:
    """Raises where a dense series doesn't hold all saves, deletes and probes; else returns one row of totals."""
    names = {"saves": "save", "deletes": "delete", "probes": "probe"}
    right = events.agg(*[F.count_if(F.col("kind") == k).alias(f"raw_{n}") for n, k in names.items()])
    both = dense.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).crossJoin(right)  # one row each
    checks = [F.assert_true(F.col(n) == F.col(f"raw_{n}"), f"{n} aren't conserved").alias(f"_{n}") for n in names]
    return both.select("*", *checks).select(*names, *[f"raw_{n}" for n in names])


class Conservation:
    """Counts saves, deletes and probes of a log and of the series made from it while an action runs over the series, so that neither is
    read a second time: series = check.made(check.raw(events)); then, after the action, check.hold() raises where they differ."""

    NAMES = {"saves": "save", "deletes": "delete", "probes": "probe"}

    def __init__(self):
        self._raw, self._made = Observation(), Observation()

    def raw(self, events: DataFrame) -> DataFrame:
        return events.observe(self._raw, *[F.count_if(F.col("kind") == k).alias(n) for n, k in self.NAMES.items()])

    def made(self, dense: DataFrame) -> DataFrame:
        return dense.observe(self._made, *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in self.NAMES])

    def hold(self) -> dict[str, int]:
        """The counts, when the action is over."""
        raw, made = self._raw.get, self._made.get
        if off := [n for n in self.NAMES if raw[n] != made[n]]:
            raise ValueError(", ".join(f"{made[n]} of {raw[n]} {n}" for n in off) + " conserved")
        return raw


def conserved_series(events: DataFrame, unit: str, write) -> dict[str, int]:
    """The series of a log through write(df), which is the only action, and its conserved totals."""
    check = Conservation()
    save = F.col("kind") == "save"
    counted = check.raw(events).groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count_if(save).alias("saves"), F.count_if(F.col("kind") == "delete").alias("deletes"), F.count_if(F.col("kind") == "probe").alias("probes"))
    # empty buckets come from the buckets that are there, not from another look at the log
    after = F.lead("bucket").over(W.orderBy("bucket"))
    steps = counted.withColumn("until", F.coalesce(after - F.expr(f"interval 1 {unit}"), "bucket")).withColumn("at", F.explode(F.sequence("bucket", "until", F.expr(f"interval 1 {unit}"))))
    own = F.col("at") == F.col("bucket")
    write(check.made(steps.select(F.unix_micros("at").alias("bucket_us"), *[F.when(own, F.col(n)).otherwise(0).cast("long").alias(n) for n in check.NAMES])))
    return check.hold()


def hour_share(events: DataFrame) -> DataFrame:
    """hour 0 to 23, n, share."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def era_of(boundary: str):
    return F.when(F.col("ts") >= F.lit(boundary).cast("timestamp"), "after").otherwise("before")


def hour_profile(events: DataFrame, boundary: str) -> DataFrame:
    """era, hour, n, share of the era."""
    counts = events.groupBy(era_of(boundary).alias("era"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("era")), 6))


def day_hour(events: DataFrame) -> DataFrame:
    """day, hour, writes, deletions: cells with either."""
    at = [F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")]
    writes = events.where("kind = 'save'").groupBy(*at).agg(F.count("*").alias("writes"))
    gone = events.where("kind = 'delete'").groupBy(*at).agg(F.count("*").alias("deletions"))
    return writes.join(gone, ["day", "hour"], "full_outer").select("day", "hour", F.coalesce("writes", F.lit(0)).alias("writes"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


def dispersal(events: DataFrame, groups: list[str], group) -> DataFrame:
    """day, writes, off_main, off_main_share and a count for each group; the first group is the main one."""
    keyed = events.where("kind = 'save'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), group.alias("g"))
    counts = keyed.groupBy("day").pivot("g", groups).agg(F.count("g")).na.fill(0)
    total = sum((F.col(g) for g in groups[1:]), F.col(groups[0]))
    return counts.select("day", total.alias("writes"), (total - F.col(groups[0])).alias("off_main"), F.round((total - F.col(groups[0])) / total, 6).alias("off_main_share"), *groups)


def gaps(events: DataFrame, by: str) -> DataFrame:
    """events with gap: seconds since the event before, of the same key."""
    order = W.partitionBy(by).orderBy("ts", "id")
    return events.withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / F.lit(1e6))


def log_gaps(events: DataFrame) -> DataFrame:
    """One row for the whole log: n (gaps), mean and s (standard deviation) of seconds between successive events, span_s. Ranges of
    time are summed up where they lie; one row for each range carries its ends to the next."""
    ranged = events.select("ts", "id").repartitionByRange("ts", "id").withColumn("_range", F.spark_partition_id())
    us = F.unix_micros("ts")
    inner = ranged.withColumn("gap", (us - F.unix_micros(F.lag("ts").over(W.partitionBy("_range").orderBy("ts", "id")))) / F.lit(1e6))
    parts = inner.groupBy("_range").agg(F.count("gap").alias("n"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("xx"), F.min(us).alias("first"), F.max(us).alias("last"))
    border = (F.col("first") - F.lag("last").over(W.orderBy("_range"))) / F.lit(1e6)
    parts = parts.withColumn("border", border)  # a row for each range
    total = parts.agg((F.sum("n") + F.count("border")).alias("n"), (F.sum("x") + F.coalesce(F.sum("border"), F.lit(0.0))).alias("x"), (F.sum("xx") + F.coalesce(F.sum(F.col("border") * F.col("border")), F.lit(0.0))).alias("xx"), ((F.max("last") - F.min("first")) / F.lit(1e6)).alias("span_s"))
    mean = F.try_divide("x", "n")
    return total.select("n", mean.alias("mean"), F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("xx") - F.col("x") * mean), F.col("n") - 1)).alias("s"), "span_s")


def burstiness(events: DataFrame, by: str, least: int = 5) -> DataFrame:
    """n, burstiness (s - m) / (s + m) of gaps, span in hours, median gap: for keys with enough events."""
    rows = gaps(events, by).groupBy(by).agg(F.count("*").alias("n"), F.stddev_samp("gap").alias("s"), F.avg("gap").alias("m"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 3.6e9).alias("h"), F.median(F.round(F.col("gap") * 1e6)).alias("median"))
    return rows.where(F.col("n") >= least).select(by, "n", F.round((F.col("s") - F.col("m")) / (F.col("s") + F.col("m")), 4).alias("burstiness"), F.round("h", 4).alias("span_hours"), F.col("median").alias("median_gap_us"))


def fano(events: DataFrame, unit: str) -> DataFrame:
    """Variance over mean of dense counts; the first bucket is left out where it begins before the first event."""
    first = events.agg(F.min("ts").alias("first"))
    counts = dense_grid(events, unit).join(events.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    kept = counts.join(F.broadcast(first), F.col("bucket") >= F.col("first"))  # one row
    return kept.agg(F.count("*").alias("buckets"), F.round(F.var_samp("n") / F.avg("n"), 4).alias("fano"))


def sessions(events: DataFrame, by: str, gap_s: float) -> DataFrame:
    """events with session (0, 1, ... of the key; a new one after a gap of more than gap_s seconds) and position in it."""
    order = W.partitionBy(by).orderBy("ts", "id")
    fresh = gaps(events, by).withColumn("session", F.sum(F.when(F.col("gap") > gap_s, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return fresh.withColumn("position", F.row_number().over(W.partitionBy(by, "session").orderBy("ts", "id")) - 1)


def session_table(events: DataFrame, by: str, gap_s: float) -> DataFrame:
    rows = sessions(events, by, gap_s).groupBy(by, "session").agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    return rows.select(by, F.col("session").cast("long").alias("session"), "n", "first_us", "last_us")


def concentration(events: DataFrame) -> DataFrame:
    """Entropy in bits over the hours of the day, the share of the top three, hours that cover 80 %."""
    hours = events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))
    ranked = hours.withColumns({"k": F.row_number().over(W.orderBy(F.desc("n"), "hour")), "cum": F.sum("n").over(W.orderBy(F.desc("n"), "hour")), "all": F.sum("n").over(W.partitionBy())})
    return ranked.agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy_bits"), F.round(F.sum(F.when(F.col("k") <= 3, F.col("p"))), 6).alias("top3_share"), (F.count_if(F.col("cum") * 5 < F.col("all") * 4) + 1).alias("hours_80"))


def daily_mode(events: DataFrame, key: str) -> DataFrame:
    """day, mentions, distinct keys, the most frequent one (the smallest of equals)."""
    at = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), key).where(F.col(key).isNotNull())
    counts = at.groupBy("day", key).agg(F.count("*").alias("n"))
    return counts.groupBy("day").agg(F.sum("n").alias("mentions"), F.count("*").alias("distinct_keys"), F.min_by(key, F.struct(-F.col("n"), F.col(key))).alias("top_key"))
