"""Rank statistics in windows, and small distributions in plain Python for results of one row."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1, equal values share the mean of their ranks."""
    group = W.partitionBy(*by)
    return F.rank().over(group.orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def prefix_sums(counts: DataFrame, value: str, *sums: str, by: tuple[str, ...] = ()) -> DataFrame:
    """counts with below_<c>: the sum of c over the rows with a smaller value (values are distinct, within by if given). Without
    by the rows are dealt by ranges of the value; a table of one row for each range carries the sums over, so no task has
    them all. The ranges are written first: made twice, from other samples or merged otherwise, they would not be the same."""
    if by:
        along = W.partitionBy(*by).orderBy(value)
        return counts.withColumns({f"below_{c}": F.sum(c).over(along) - F.col(c) for c in sums})
    ranged = written(counts.repartitionByRange(F.col(value)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inner = W.partitionBy("_range").orderBy(value)
    found = ranged.withColumns({f"_in_{c}": F.sum(c).over(inner) - F.col(c) for c in sums}).join(F.broadcast(totals), "_range")  # a row for each range
    return found.select(*counts.columns, *[(F.col(f"_{c}") + F.col(f"_in_{c}")).alias(f"below_{c}") for c in sums])


def rank_sums(df: DataFrame, value: str, first: str, *by: str) -> DataFrame:
    """For each group: n1, n2, u (of the rows where first holds; null without rows on either side), ties (sum of t**3 - t).
    Equal values share a rank, so ranks are computed once for each distinct value, from counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("t"), F.count_if(first).alias("n1"))
    ranked = prefix_sums(counts, "v", "t", by=by).withColumn("r", F.col("below_t") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*by).agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("t") - F.col("n1")), F.lit(0)).alias("n2"), F.sum(F.col("n1") * F.col("r")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    u = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.round(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, 4))
    return sums.select(*by, "n1", "n2", u.alias("u"), "ties")


def mann_whitney(df: DataFrame, value: str, first: str, *by: str, ties: bool = False) -> DataFrame:
    """first: a boolean column. Returns n1, n2, u (of the rows where first holds), z by the normal approximation with
    corrections for ties and continuity; z is null where all values are equal or a side is empty. ties: with the sum of t**3 - t."""
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    return rank_sums(df, value, first, *by).select(*by, "n1", "n2", "u", *(["ties"] if ties else []), F.round(F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5, sd), 4).alias("z"))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n and rho for each group; rho is null where either side is constant."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"))
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in {"x": F.col("rx"), "y": F.col("ry"), "xx": F.col("rx") ** 2, "yy": F.col("ry") ** 2, "xy": F.col("rx") * F.col("ry")}.items()])
    spread = F.expr("sqrt((n * xx - x * x) * (n * yy - y * y))")
    return sums.select(*by, "n", F.round(F.try_divide(F.expr("n * xy - x * y"), spread), 6).alias("rho"))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """n (of differences that aren't zero), w_plus, w_minus, ties (sum of t**3 - t over sizes) and zeros. Ranks come from counts of the
    distinct sizes."""
    d = df.select(F.col(difference).alias("d")).where("d is not null")
    counts = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    zeros = counts.where("size = 0").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("zeros"))
    ranked = prefix_sums(counts.where("size > 0"), "size", "t").withColumn("r", F.col("below_t") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("r")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("t") - F.col("up")) * F.col("r")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"))
    return sums.crossJoin(zeros)  # one row each


def p_values(found: DataFrame, kind: str) -> DataFrame:
    """found, a table of few rows, with p_value: of mann_whitney (one-sided, greater, from z; exact where ties
    are given as none and a side has at most eight), wilcoxon (two-sided, exact up to 50
    differences without ties or zeros, else by the normal approximation, corrected for ties; null without differences) or
    spearman (two-sided, from n and rho)."""
    import pandas as pd

    def one(row) -> float | None:
        if kind == "mann_whitney":
            n1, n2 = int(row.n1), int(row.n2)
            if getattr(row, "ties", None) == 0 and 0 < min(n1, n2) <= 8:
                return u_exact_tail(n1, n2, int(row.u))
            return None if row.z is None or math.isnan(row.z) else normal_tail(row.z)
        if kind == "wilcoxon":
            n, low = int(row.n), min(row.w_plus, row.w_minus)
            if not n:
                return None
            if n <= 50 and not row.ties and not row.zeros:
                return min(1.0, 2 * wilcoxon_exact_tail(n, n * (n + 1) // 2 - low))
            spread = n * (n + 1) * (2 * n + 1) / 24 - row.ties / 48
            return min(1.0, 2 * normal_tail((n * (n + 1) / 4 - low) / math.sqrt(spread)))
        if row.rho is None or math.isnan(row.rho) or row.n < 3:
            return None
        return 0.0 if abs(row.rho) >= 1 else t_tail(row.rho * math.sqrt((row.n - 2) / (1 - row.rho**2)), int(row.n) - 2)

    run = lambda parts: (part.assign(p_value=pd.Series([one(r) for r in part.itertuples(index=False)], dtype=float)) for part in parts)
    return found.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in found.dtypes) + ", p_value double")


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def u_exact_tail(n1: int, n2: int, u: int) -> float:
    """P(U >= u) of two groups without ties, by counting orders: the largest value is of the first group, above all of the second, or it
    is of the second. Shares instead of counts, so no number is too large."""
    import numpy as np

    n, m = sorted((n1, n2))  # U has one distribution for both
    size = n * m + 1
    share = [np.eye(1, size)[0] for _ in range(n + 1)]  # of i and none
    for j in range(1, m + 1):
        for i in range(1, n + 1):
            above = np.zeros(size)
            above[j:] = share[i - 1][: size - j]
            share[i] = (i * above + j * share[i]) / (i + j)
    return float(share[n][max(0, u) :].sum())


def wilcoxon_exact_tail(n: int, w: float) -> float:
    """P(W+ >= w) of n untied differences, by counting subsets of ranks."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return sum(ways[math.ceil(w) :]) / 2**n


def t_tail(t: float, df: int) -> float:
    """P(|T| > |t|), by Simpson's rule on the density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    n, h = 2000, abs(t) / 2000
    body = h / 3 * sum(f(i * h) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1)) if t else 0.0
    return max(0.0, 1 - 2 * body)


def compare_to_null(replicates: DataFrame, value: str, observed: float, center: str = "mean") -> DataFrame:
    """observed, null_mean, null_std, z_score, p_value (two-sided, add-one; around the null's mean or around zero), n_samples."""
    sums = replicates.agg(F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"), F.collect_list(value).alias("all"))
    mid = F.col("m") if center == "mean" else F.lit(0.0)
    far = F.size(F.filter("all", lambda x: F.abs(x - mid) >= F.abs(F.lit(float(observed)) - mid)))
    z = F.when(F.col("s") > 0, (F.lit(float(observed)) - F.col("m")) / F.col("s")).otherwise(0.0)
    return sums.select(F.lit(float(observed)).alias("observed"), F.col("m").alias("null_mean"), F.col("s").alias("null_std"), z.alias("z_score"), ((far + 1) / (F.col("n") + 1)).alias("p_value"), F.col("n").alias("n_samples"))
