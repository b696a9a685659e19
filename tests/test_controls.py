"""Controls and verdicts on hand-built logs, against numpy and exact counts."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import ranks
from skeinwork.operators import controls, survival
from skeinwork.sources.shared import written

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    """rows: kind, day, hour, place, actor."""
    return spark.createDataFrame([(i, T0 + timedelta(days=d, hours=h, microseconds=i), a, p, k, 0.0) for i, (k, d, h, p, a) in enumerate(rows)], "id long, ts timestamp, actor long, place string, kind string, value double")


def test_headline_periods_and_verdict(spark):
    rows = [("delete", 0, 19, "x", 0)] * 3 + [("delete", 0, 20, "x", 0)] + [("save", 0, 9, "x", 1)] * 8 + [("save", 0, 19, "x", 1)] * 2 + [("save", 5, 20, "x", 1)] * 9 + [("save", 5, 3, "x", 1)] + [("save", 9, 2, "x", 1)] * 4
    events = log(spark, rows)
    after = F.col("ts") >= F.lit("2024-01-10").cast("timestamp")
    r = controls.headline(events, after, 2).first()
    assert (r.active_hours, r.peak_hour, r.peak_share, r.silent_from, r.silent_until, r.silent_until_local) == ("19,20", 19, 0.75, 0, 24, 2)
    assert (r.writes_before, r.writes_after, r.share_in_active_before, r.share_in_active_after, r.peak_hour_before, r.peak_hour_after) == (20, 4, 0.55, 0.0, 20, 2)
    day = F.dayofmonth("ts")
    got = {x.period: x for x in controls.period_summary(events, {"before": day < 5, "spike": day.between(5, 8), "all": F.lit(True), "never": F.lit(False)}).collect()}
    assert set(got) == {"before", "spike", "all"} and got["all"].writes == 24 and got["spike"].evening_share == 0.9 and got["spike"].night_share == 0.1 and got["before"].top3_hours == "9,19" and got["before"].exposure == pytest.approx(0.2 * 0.75)
    v = controls.baseline_verdict(controls.period_summary(events, {"before": day < 5, "spike": day.between(5, 8)}), "before", "spike").first()
    assert (v.spike_share, v.verdict) == (0.5, controls.PERIODS["spike"])
    none = controls.headline(events.limit(0), after).first()
    assert none.active_hours == "" and none.writes_before is None


def test_groups_shift_alike_or_not(spark):
    rng = np.random.default_rng(3)
    rows = [("delete", 0, h, "p", 0) for h in (18, 19, 19, 19, 20)]
    for place, late in (("p", 19), ("u", 19), ("few", 19)):
        n = 20 if place == "few" else 150
        rows += [("save", 0, int(rng.choice([late, 3, 9])), place, 1) for _ in range(n)] + [("save", 5, int(rng.choice([3, 9, 10])), place, 1) for _ in range(n)]
    events = log(spark, rows)
    early = F.dayofmonth("ts") < 3
    counts = controls.group_counts(events, F.col("place"), early, ~early)
    got = {r.group: r for r in controls.group_tests(counts, 400).collect()}
    assert got["few"].status == "too_few_writes" and got["few"].p_value is None and got["few"].difference is None
    assert all(got[k].status == "tested" and got[k].p_value < 0.01 and got[k].difference > 0 for k in "pu")
    # the drawn counts have the moments of whole shuffles
    risk = {18: 0.2, 19: 0.6, 20: 0.2}
    pool = np.array([risk.get(h, 0.0) for k, _, h, p, _ in rows if k == "save" and p == "p"])
    plain = [(lambda x: x[:150].mean() - x[150:].mean())(rng.permutation(pool)) for _ in range(3000)]
    assert got["p"].null_std == pytest.approx(np.std(plain), rel=0.12) and abs(got["p"].null_mean) < 0.01
    assert controls.group_verdict(controls.group_tests(counts, 200), "p", "u").first().verdict == controls.GROUPS["same"]
    assert controls.group_verdict(controls.group_tests(counts, 200), "p", "few").first().verdict == controls.GROUPS["specific"]


def test_paired_verdicts(spark):
    paired = lambda n, down: spark.createDataFrame([(i, 9, 9, 0.5, 0.5 - 0.01 * (i + 1) * (1 if i < down else -1)) for i in range(n)], "actor long, n_before long, n_after long, exposure_before double, exposure_after double").withColumn("difference", F.col("exposure_after") - F.col("exposure_before"))
    said = lambda p: controls.paired_verdict(p, ranks.p_values(ranks.wilcoxon(p, "difference"), "wilcoxon")).first()
    assert said(paired(23, 22)).verdict == controls.PAIRED["moved"] and said(paired(23, 22)).lowered == 22
    assert said(paired(12, 6)).verdict == controls.PAIRED["not"] and said(paired(4, 4)).verdict == controls.PAIRED["few"]


def test_sittings_over_ranges_and_their_order(spark):
    rng = np.random.default_rng(1)
    at, rows = 0, []
    for i in range(400):
        at += int(rng.choice([60, 300, 8000]))
        rows.append((i, T0 + timedelta(seconds=at), int(rng.integers(0, 26)) if i % 9 else None))
    frame = spark.createDataFrame(rows, "id long, ts timestamp, letter int").repartition(5)
    got = {r.id: r.sitting for r in controls.sittings(frame, 7200, written).collect()}
    want, k, last = {}, 0, None
    for i, t, _ in rows:
        k += last is not None and (t - last).total_seconds() > 7200
        want[i], last = k, t
    assert got == want
    ordered = spark.createDataFrame([(i, T0 + timedelta(minutes=i + 600 * (i // 5)), chr(65 + i % 5) + "x" if i // 5 < 3 else "same") for i in range(20)], "id long, ts timestamp, name string")
    found = controls.alphabet_in_sittings(ordered, F.ascii("name") - 65, 7200, written, 5)
    assert sorted((r.sitting, r.n, r.rho) for r in found.collect()) == [(0, 5, 1.0), (1, 5, 1.0), (2, 5, 1.0)]
    v = controls.alphabet_verdict(found).first()
    assert (v.sittings, v.median_rho, v.strongly_alphabetical, v.strongly_reverse, v.verdict) == (3, 1.0, 3, 0, controls.ORDER["ordered"])
    assert controls.alphabet_verdict(found.limit(0)).first().median_rho is None


def test_exact_tails_of_u():
    for n, m in ((1, 1), (2, 3), (3, 3), (4, 2), (5, 4)):
        us = [sum(a > b for a in x for b in range(n + m) if b not in x) for x in itertools.combinations(range(n + m), n)]
        for u in range(n * m + 1):
            assert ranks.u_exact_tail(n, m, u) == pytest.approx(np.mean(np.array(us) >= u))


def test_weeks_flags_and_gaps(spark):
    lives = spark.createDataFrame([("w1", True, float(x)) for x in (5, 6, 7, 8, 9)] + [("w1", False, float(x)) for x in (1, 2, 3)] + [("w2", True, 1.0)] * 5, "week string, m boolean, lifetime_h double")
    got = {r.week: r for r in survival.week_tests(lives, F.col("m")).collect()}
    assert (got["w1"].u, got["w1"].p_value) == (15.0, pytest.approx(1 / 56)) and got["w2"].u is None and got["w2"].p_value is None
    rows = spark.createDataFrame([("a", 0, 1), ("b", 10**15 * 2, None), ("c", 5, None)], "place string, born_us long, died_us long").withColumn("lifetime_h", F.lit(2.0))
    names = spark.createDataFrame([("a", "home", "zebra1704067200", True), ("b", "else", "xZzZ", None)], "place string, wiki string, name string, obfuscated boolean")
    flags = {r.place: r for r in survival.flagged(rows, names, "2024-01-01", "home").collect()}
    of = lambda p: tuple(flags[p][k] for k in ("starts_with", "contains", "epoch_suffix", "off_home", "born_after", "obfuscated"))
    assert of("a") == (True, False, True, False, False, True) and of("b") == (False, True, False, True, True, False) and of("c") == (False, False, False, True, False, False)
    tactics = {r.tactic: r for r in survival.by_tactic(survival.flagged(rows, names, "2024-01-01", "home"), "home").collect()}
    assert (tactics["all"].n, tactics["all"].home_n, tactics["starts_with"].dead_share, tactics["off_home"].n, tactics["off_home"].home_n) == (3, 1, 1.0, 2, 0)
    gaps = survival.removal_gaps(log(spark, [("delete", d, 0, p, 0) for d, p in ((0, "x"), (3, "x"), (1, "x"), (0, "y"))])).collect()
    assert [(r.place, r.removals, len(r.gaps_us), r.fastest_us == min(r.gaps_us)) for r in gaps] == [("x", 3, 2, True)]
