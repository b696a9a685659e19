"""Queries on hours, periods, groups and sittings, with their verdicts, and on the names of places."""

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import controls, populations, survival
from ..sources.shared import written
from ..sources.tables import BOUNDARY, EVENT_LOG_SQL, event_log, table
from .survival_queries import EXPOSURE, PAIRED, SURVIVAL, paired, subjects

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


E = f"WITH {EVENT_LOG_SQL}"
after = lambda: F.col("ts") >= F.lit(BOUNDARY).cast("timestamp")
SPIKE = ("2024-01-10 00:00:00", BOUNDARY)
HOURS = E + """, hr AS (SELECT h, (SELECT count(*) FROM ev WHERE kind = 'delete' AND hour(ts) = h) AS n FROM (SELECT unnest(range(24))::INTEGER AS h))"""
PEAK = "arg_min(h, (-n, h))"
query("exposure_headline", HOURS + f""", s AS (SELECT CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 'after' ELSE 'before' END AS era, hour(ts)::INTEGER AS h, count(*) AS n FROM ev WHERE kind = 'save' GROUP BY ALL
), a AS (SELECT era, sum(s.n)::BIGINT AS writes, round(sum(s.n) FILTER (hr.n > 0) / sum(s.n), 6) AS share, arg_min(s.h, (-s.n, s.h)) AS peak FROM s JOIN hr ON hr.h = s.h GROUP BY era
), w AS (SELECT min(h) FILTER (n = 0) AS low, max(h) FILTER (n = 0) + 1 AS high, coalesce(string_agg(h::VARCHAR, ',' ORDER BY h) FILTER (n > 0), '') AS active_hours, coalesce(string_agg(h::VARCHAR, ',' ORDER BY h) FILTER (n = 0), '') AS silent_hours, {PEAK} AS peak_hour, round(max(n) / sum(n), 6) AS peak_share FROM hr)
SELECT active_hours, silent_hours, low AS silent_from, high AS silent_until, (low + 2) % 24 AS silent_from_local, (high + 2) % 24 AS silent_until_local, peak_hour, peak_share,
  max(writes) FILTER (era = 'before') AS writes_before, max(writes) FILTER (era = 'after') AS writes_after, coalesce(max(share) FILTER (era = 'before'), 0) AS share_in_active_before, coalesce(max(share) FILTER (era = 'after'), 0) AS share_in_active_after,
  max(peak) FILTER (era = 'before') AS peak_hour_before, max(peak) FILTER (era = 'after') AS peak_hour_after FROM w, a GROUP BY ALL""", lambda s, d: controls.headline(event_log(s, d), after(), 2))
PERIODS = {"before": (None, SPIKE[0]), "spike": SPIKE, "after": (BOUNDARY, None)}
conditions = lambda: {k: (F.lit(True) if a is None else F.col("ts") >= F.lit(a).cast("timestamp")) & (F.lit(True) if b is None else F.col("ts") < F.lit(b).cast("timestamp")) for k, (a, b) in PERIODS.items()}
SUMMARY = EXPOSURE + f""", pr AS (SELECT CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 'after' WHEN ts >= TIMESTAMP '{SPIKE[0]}' THEN 'spike' ELSE 'before' END AS period, hour(ts)::INTEGER AS h, count(*) AS n FROM ev WHERE kind = 'save' GROUP BY ALL
), pl AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, h) AS k FROM pr LEFT JOIN (SELECT h AS rh, risk FROM risk) ON rh = h
), ps AS (SELECT period, sum(n)::BIGINT AS writes, round(round(sum(n * coalesce(risk, 0)) / sum(n), 8), 6) AS exposure, arg_min(h, (-n, h)) AS peak_hour, round(coalesce(sum(n) FILTER (h BETWEEN 18 AND 21), 0) / sum(n), 6) AS evening_share,
  round(coalesce(sum(n) FILTER (h BETWEEN 1 AND 7), 0) / sum(n), 6) AS night_share, string_agg(h::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS top3_hours, round(sum(n) FILTER (k <= 3) / sum(n), 6) AS top3_share FROM pl GROUP BY period)"""
periods = lambda s, d: controls.period_summary(event_log(s, d), conditions())
query("period_summary", SUMMARY + " SELECT * FROM ps", lambda s, d: periods(s, d).withColumn("exposure", F.round("exposure", 6)))
query("baseline_verdict", SUMMARY + f""", x AS (SELECT max(writes) FILTER (period = 'before') AS b, max(writes) FILTER (period = 'spike') AS s, max(evening_share) FILTER (period = 'before') AS e, max(evening_share) FILTER (period = 'spike') AS f FROM ps)
SELECT round(s / (s + b), 6) AS spike_share, CASE WHEN f > 3 * e THEN '{controls.PERIODS['spike']}' ELSE '{controls.PERIODS['stable']}' END AS verdict FROM x""", lambda s, d: controls.baseline_verdict(periods(s, d), "before", "spike"))
counts = lambda s, d: controls.group_counts(event_log(s, d), F.col("place").cast("int") % 3, ~after(), after())
query("group_exposure", EXPOSURE + f""", g AS (SELECT place::INTEGER % 3 AS "group", ts >= TIMESTAMP '{BOUNDARY}' AS after, coalesce(risk, 0) AS risk FROM ev LEFT JOIN risk ON h = hour(ts) WHERE kind = 'save'
), x AS (SELECT "group", count(*) FILTER (NOT after) AS n_before, count(*) FILTER (after) AS n_after, avg(risk) FILTER (NOT after) AS x, avg(risk) FILTER (after) AS y FROM g GROUP BY "group")
SELECT "group", n_before, n_after, CASE WHEN n_before >= 50 AND n_after >= 50 THEN 'tested' ELSE 'too_few_writes' END AS status, CASE WHEN n_before >= 50 AND n_after >= 50 THEN round(round(x, 8), 6) END AS exposure_before, CASE WHEN n_before >= 50 AND n_after >= 50 THEN round(round(y, 8), 6) END AS exposure_after,
  CASE WHEN n_before >= 50 AND n_after >= 50 THEN round(round(x - y, 8), 6) END AS difference FROM x""", lambda s, d: controls.group_exposure(counts(s, d)).select("group", "n_before", "n_after", "status", *[F.round(c, 6).alias(c) for c in ("exposure_before", "exposure_after", "difference")]))
query("group_tests", None, lambda s, d: controls.group_tests(counts(s, d)))
query("group_verdict", None, lambda s, d: controls.group_verdict(controls.group_tests(counts(s, d)).withColumn("group", F.col("group").cast("string")), "0", "1"))
query("paired_lowered", PAIRED + " SELECT count(*) AS actors, round(round(avg(exposure_before), 8), 6) AS mean_before, round(round(avg(exposure_after), 8), 6) AS mean_after, count(*) FILTER (exposure_after < exposure_before) AS lowered FROM paired", lambda s, d: paired_verdict(s, d).select("actors", F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), "lowered"))
query("paired_verdict", None, lambda s, d: paired_verdict(s, d))

# places have the names of parts, and their brands for wikis
NAMED = """nm AS (SELECT p_partkey::VARCHAR AS place, p_brand AS wiki, CASE WHEN p_size % 5 = 0 THEN p_name || '17040672' || lpad((p_partkey % 100)::VARCHAR, 2, '0') ELSE p_name END AS name, p_size % 7 = 0 AS obfuscated FROM part WHERE p_partkey < 100)"""


def place_names(s, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    name = F.when(size % 5 == 0, F.concat("p_name", F.lit("17040672"), F.lpad((key % 100).cast("string"), 2, "0"))).otherwise(F.col("p_name"))
    return table(s, d, "part").where("p_partkey < 100").select(key.cast("string").alias("place"), F.col("p_brand").alias("wiki"), name.alias("name"), (size % 7 == 0).alias("obfuscated"))


FLAGGED = SURVIVAL + f""", {NAMED}, fl AS (SELECT sv.*, wiki, name, upper(left(coalesce(name, ''), 1)) = 'R' AS starts_with, contains(lower(coalesce(name, '')), 'dg') AS contains, regexp_matches(coalesce(name, ''), '1[0-9]{{9}}$') AS epoch_suffix,
  wiki IS DISTINCT FROM 'Brand#3' AS off_home, born_us >= epoch_us(TIMESTAMP '{BOUNDARY}') AS born_after, coalesce(obfuscated, false) AS obfuscated FROM sv LEFT JOIN nm ON nm.place = sv.place)"""
flagged = lambda s, d: survival.flagged(subjects(s, d), place_names(s, d), BOUNDARY, "Brand#3", "R", "dg")
query("flagged_survival", FLAGGED + " SELECT place, actor, born_us, name, wiki, starts_with, contains, epoch_suffix, off_home, born_after, obfuscated FROM fl", lambda s, d: flagged(s, d).select("place", "actor", "born_us", "name", "wiki", "starts_with", "contains", "epoch_suffix", "off_home", "born_after", "obfuscated"))
TACTICS = ("all", "starts_with", "contains", "epoch_suffix", "obfuscated", "off_home")
query("survival_by_tactic", FLAGGED + ", x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS tactic, wiki, died_us, lifetime_h FROM fl WHERE {'true' if k == 'all' else k}" for k in TACTICS) + """
), h AS (SELECT tactic, count(*) AS n, round(avg((died_us IS NOT NULL)::INT), 6) AS dead_share, round(median(lifetime_h), 4) AS median_h, count(*) FILTER (wiki = 'Brand#3' AND tactic <> 'off_home') AS home_n,
  round(avg((died_us IS NOT NULL)::INT) FILTER (wiki = 'Brand#3' AND tactic <> 'off_home'), 6) AS home_dead_share, round(median(lifetime_h) FILTER (wiki = 'Brand#3' AND tactic <> 'off_home'), 4) AS home_median_h FROM x GROUP BY tactic
), t AS (SELECT unnest([""" + ", ".join(f"'{k}'" for k in TACTICS) + "]) AS tactic) SELECT t.tactic, coalesce(n, 0) AS n, dead_share, median_h, coalesce(home_n, 0) AS home_n, home_dead_share, home_median_h FROM t LEFT JOIN h ON h.tactic = t.tactic", lambda s, d: survival.by_tactic(flagged(s, d), "Brand#3"))
query("week_u", SURVIVAL + """, x AS (SELECT week, actor < 50 AS m, lifetime_h FROM sv), r AS (SELECT week, m, rank() OVER (PARTITION BY week ORDER BY lifetime_h) + (count(*) OVER (PARTITION BY week, lifetime_h) - 1) / 2 AS r FROM x)
SELECT week, count(*) FILTER (m) AS n_marked, count(*) FILTER (NOT m) AS n_rest, CASE WHEN count(*) FILTER (NOT m) > 0 THEN round(sum(r) FILTER (m) - count(*) FILTER (m) * (count(*) FILTER (m) + 1) / 2, 4) END AS u FROM r GROUP BY week HAVING count(*) FILTER (m) >= 5""", lambda s, d: survival.week_tests(subjects(s, d), F.col("actor") < 50).drop("z", "p_value"))
query("week_tests", None, lambda s, d: survival.week_tests(subjects(s, d), F.col("actor") < 50))
query("removal_gaps", E + """, t AS (SELECT place, count(*) AS removals FROM ev WHERE kind = 'delete' GROUP BY place HAVING count(*) > 1 ORDER BY removals DESC, place LIMIT 20
), g AS (SELECT e.place, removals, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY e.place ORDER BY ts)) AS gap FROM ev e JOIN t ON t.place = e.place WHERE kind = 'delete')
SELECT place, removals, min(us) AS first_us, max(us) AS last_us, string_agg(gap::VARCHAR, ',' ORDER BY us, gap) FILTER (gap IS NOT NULL) AS gaps_us, min(gap) AS fastest_us FROM g GROUP BY place, removals""", lambda s, d: survival.removal_gaps(event_log(s, d)).withColumn("gaps_us", F.array_join(F.col("gaps_us").cast("array<string>"), ",")))
LETTERED = E + f""", {NAMED}, lt AS (SELECT e.ts, e.id, ascii(upper(left(name, 1))) - 65 AS letter FROM ev e JOIN nm ON nm.place = e.place WHERE kind = 'delete' AND regexp_matches(name, '^[A-Za-z]')
), gp AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, id))) > 7200000000 AS new FROM lt), st AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS sitting FROM gp
), pl AS (SELECT *, row_number() OVER (PARTITION BY sitting ORDER BY ts, id)::DOUBLE AS rx, rank() OVER (PARTITION BY sitting ORDER BY letter) + (count(*) OVER (PARTITION BY sitting, letter) - 1) / 2 AS ry FROM st
), rh AS (SELECT sitting::BIGINT AS sitting, count(*) AS n, min(epoch_us(ts)) AS started_us, round(corr(rx, ry), 6) AS rho FROM pl GROUP BY sitting HAVING count(*) >= 3 AND count(DISTINCT letter) > 1)"""


def lettered(s, d):
    rows = event_log(s, d).where("kind = 'delete'").join(F.broadcast(place_names(s, d)), "place")  # a hundred places
    return controls.alphabet_in_sittings(rows, populations.letter_position(F.col("name")), 7200, written, 3)


query("sittings_alphabet", LETTERED + " SELECT * FROM rh", lettered)
query("alphabet_verdict", LETTERED + f" SELECT count(*) AS sittings, round(median(rho), 6) AS median_rho, count(*) FILTER (rho > 0.5) AS strongly_alphabetical, count(*) FILTER (rho < -0.5) AS strongly_reverse, CASE WHEN median(rho) < 0.3 THEN '{controls.ORDER['not']}' ELSE '{controls.ORDER['ordered']}' END AS verdict FROM rh", lambda s, d: controls.alphabet_verdict(lettered(s, d)))


def paired_verdict(s, d):
    found = paired(s, d)
    return controls.paired_verdict(found, ranks.p_values(ranks.wilcoxon(found, "difference"), "wilcoxon"))
