"""Queries on removals, survival and exposure."""

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import activity, survival
from ..sources.tables import BOUNDARY, EVENT_LOG_SQL, event_log

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str, f) -> None:
    QUERIES[name] = f
    ORACLE_SQL[name] = sql


E = f"WITH {EVENT_LOG_SQL}"
REWRITES = E + """, dl AS (SELECT * FROM ev WHERE kind = 'delete'), sv AS (SELECT place, ts, max(id) AS id FROM ev WHERE kind = 'save' GROUP BY place, ts), first AS (
  SELECT d.place, d.id AS removal, epoch_us(d.ts) AS deleted_us, epoch_us(s.ts) AS saved_us, s.ts AS sts FROM dl d ASOF JOIN (SELECT place, ts FROM sv) s ON d.place = s.place AND d.ts < s.ts
), rw AS (SELECT f.place, removal, deleted_us, saved_us, e.actor, saved_us - deleted_us AS latency_us FROM first f JOIN (SELECT place, ts, min_by(actor, id) AS actor FROM ev WHERE kind = 'save' GROUP BY place, ts) e ON e.place = f.place AND e.ts = f.sts)"""
query("rewrite_latency", REWRITES + " SELECT * FROM rw", lambda s, d: survival.rewrites(event_log(s, d)))
query("rewrite_latency_summary", REWRITES + """ SELECT count(*) AS n, median(latency_us) AS median_us, round(quantile_cont(latency_us, 0.1), 1) AS p10_us, round(quantile_cont(latency_us, 0.9), 1) AS p90_us,
  count(DISTINCT actor) AS responders, count(*) FILTER (latency_us <= 60000000) AS within_60s, count(*) FILTER (latency_us <= 3600000000) AS within_3600s, count(*) FILTER (latency_us <= 86400000000) AS within_86400s FROM rw""",
  lambda s, d: survival.latency_summary(survival.rewrites(event_log(s, d))))
query("top_responders", REWRITES + " SELECT actor, count(*) AS n FROM rw GROUP BY actor ORDER BY n DESC, actor LIMIT 15", lambda s, d: survival.rewrites(event_log(s, d)).groupBy("actor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor").limit(15))
query("multi_delete_gaps", E + """, g AS (SELECT place, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY place ORDER BY ts, id)) AS gap FROM ev WHERE kind = 'delete')
SELECT place, count(*) AS n_deletes, min(gap) AS fastest_us, max(gap) AS slowest_us FROM g GROUP BY place HAVING count(*) > 1""", lambda s, d: survival.multi_delete(event_log(s, d)))
# subjects are an actor's saves of a place: places alone are too few here
SURVIVAL = E + """, born AS (SELECT place, actor, min(ts) AS born, count(*) AS n_saves, count(DISTINCT actor) AS n_actors FROM ev WHERE kind = 'save' GROUP BY ALL
), died AS (SELECT b.place, b.actor, min(e.ts) AS died FROM born b JOIN ev e ON e.place = b.place AND e.kind = 'delete' AND e.ts >= b.born GROUP BY ALL
), sv AS (SELECT b.place, b.actor, epoch_us(born) AS born_us, epoch_us(died) AS died_us, round((epoch_us(coalesce(died, (SELECT max(ts) FROM ev))) - epoch_us(born)) / 3.6e9, 6) AS lifetime_h, n_saves, n_actors,
  strftime(born, '%G-%V') AS week FROM born b LEFT JOIN died x ON x.place = b.place AND x.actor = b.actor)"""
subjects = lambda s, d: survival.survival(event_log(s, d), ("place", "actor"))
query("page_survival", SURVIVAL + " SELECT * FROM sv", subjects)
FLAGS = lambda: {"many_saves": F.col("n_saves") > 1, "even_place": F.col("place").cast("int") % 2 == 0, "first_actors": F.col("actor") < 50}
query("survival_by_flag", SURVIVAL + """, f AS (SELECT 'many_saves' AS flag, n_saves > 1 AS holds, died_us, lifetime_h FROM sv UNION ALL SELECT 'even_place', place::INTEGER % 2 = 0, died_us, lifetime_h FROM sv UNION ALL SELECT 'first_actors', actor < 50, died_us, lifetime_h FROM sv)
SELECT flag, holds, count(*) AS n, count(died_us) AS dead, round(avg((died_us IS NOT NULL)::INTEGER), 6) AS dead_share, round(median(lifetime_h) FILTER (died_us IS NOT NULL), 4) AS median_h FROM f GROUP BY ALL""",
  lambda s, d: survival.by_flags(subjects(s, d), FLAGS()))
query("kaplan_meier", SURVIVAL + """, x AS (SELECT CASE WHEN actor < 50 THEN 'first' ELSE 'rest' END AS group_name, * FROM sv
), grid AS (SELECT group_name, h FROM (SELECT DISTINCT group_name FROM x), (SELECT unnest(range(0, 601, 24)) AS h)
), c AS (SELECT g.group_name, h, CASE WHEN h = 0 THEN 0 ELSE count(*) FILTER (lifetime_h >= h - 24) END AS r, CASE WHEN h = 0 THEN 0 ELSE count(*) FILTER (lifetime_h >= h - 24 AND lifetime_h < h AND died_us IS NOT NULL) END AS d
  FROM grid g JOIN x ON x.group_name = g.group_name GROUP BY g.group_name, h)
SELECT group_name, h::BIGINT AS hours, r AS at_risk, d AS deaths, round(CASE WHEN min(CASE WHEN r = 0 THEN 1.0 ELSE 1 - d / r END) OVER o <= 0 THEN 0 ELSE exp(sum(CASE WHEN r = 0 OR d = r THEN 0 ELSE ln(1 - d / r) END) OVER o) END, 6) AS survival
FROM c WINDOW o AS (PARTITION BY group_name ORDER BY h)""",
  lambda s, d: survival.kaplan_meier(subjects(s, d), F.when(F.col("actor") < 50, "first").otherwise("rest")))
query("matched_week", SURVIVAL + """, x AS (SELECT *, actor < 50 AS m FROM sv), k AS (SELECT week, count(*) FILTER (m) AS n_marked, count(*) FILTER (NOT m) AS n_other,
  round(avg((died_us IS NOT NULL)::INTEGER) FILTER (m), 6) AS dead_marked, round(avg((died_us IS NOT NULL)::INTEGER) FILTER (NOT m), 6) AS dead_other,
  round(median(lifetime_h) FILTER (m AND died_us IS NOT NULL), 4) AS median_marked, round(median(lifetime_h) FILTER (NOT m AND died_us IS NOT NULL), 4) AS median_other
FROM x GROUP BY week HAVING count(*) FILTER (m) >= 5 AND count(*) FILTER (NOT m) >= 5
), r AS (SELECT week, m, rank() OVER (PARTITION BY week ORDER BY lifetime_h) + (count(*) OVER (PARTITION BY week, lifetime_h) - 1) / 2 AS r FROM x WHERE died_us IS NOT NULL
), u AS (SELECT week, CASE WHEN count(*) FILTER (m) > 0 AND count(*) FILTER (NOT m) > 0 THEN round(sum(r) FILTER (m) - count(*) FILTER (m) * (count(*) FILTER (m) + 1) / 2, 4) END AS u FROM r GROUP BY week)
SELECT k.*, u FROM k LEFT JOIN u ON u.week = k.week""", lambda s, d: survival.matched_weeks(subjects(s, d), F.col("actor") < 50))
query("survival_totals", SURVIVAL + " SELECT count(*) AS n, count(died_us) AS dead, round(count(died_us) / count(*), 6) AS dead_share, count(DISTINCT place) AS places FROM sv",
  lambda s, d: subjects(s, d).agg(F.count("*").alias("n"), F.count("died_us").alias("dead"), F.round(F.count("died_us") / F.count("*"), 6).alias("dead_share"), F.countDistinct("place").alias("places")))
EXPOSURE = E + f""", risk AS (SELECT hour(ts) AS h, count(*) / (SELECT count(*) FROM ev WHERE kind = 'delete') AS risk FROM ev WHERE kind = 'delete' GROUP BY 1
), sx AS (SELECT actor, CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 'after' ELSE 'before' END AS era, coalesce(risk, 0) AS risk FROM ev LEFT JOIN risk ON h = hour(ts) WHERE kind = 'save')"""
PAIRED = EXPOSURE + """, each AS (SELECT actor, era, count(*) AS n, round(avg(risk), 8) AS exposure FROM sx GROUP BY ALL
), paired AS (SELECT b.actor, b.n AS n_before, a.n AS n_after, b.exposure AS exposure_before, a.exposure AS exposure_after, round(a.exposure - b.exposure, 8) AS difference
  FROM each b JOIN each a ON a.actor = b.actor AND a.era = 'after' WHERE b.era = 'before' AND b.n >= 5 AND a.n >= 5)"""
paired = lambda s, d: survival.paired_exposure(event_log(s, d), activity.era_of(BOUNDARY))
query("era_exposure", EXPOSURE + " SELECT era, count(*) AS n, round(avg(risk), 6) AS exposure FROM sx GROUP BY era", lambda s, d: survival.exposure(event_log(s, d), activity.era_of(BOUNDARY).alias("era")).withColumn("exposure", F.round("exposure", 6)))
query("paired_exposure", PAIRED + " SELECT actor, n_before, n_after, round(exposure_before, 6) AS exposure_before, round(exposure_after, 6) AS exposure_after, round(difference, 6) AS difference FROM paired", lambda s, d: paired(s, d).select("actor", "n_before", "n_after", *[F.round(c, 6).alias(c) for c in ("exposure_before", "exposure_after", "difference")]))
query("wilcoxon_w", PAIRED + """, r AS (SELECT difference AS d, rank() OVER (ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY abs(difference)) - 1) / 2 AS r FROM paired WHERE difference <> 0)
SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r""", lambda s, d: ranks.wilcoxon(paired(s, d), "difference").drop("ties", "zeros"))
query("removal_totals", E + """, c AS (SELECT place, count(*) AS n FROM ev WHERE kind = 'delete' GROUP BY place) SELECT count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS repeatedly, coalesce(sum(n), 0)::BIGINT AS removals, coalesce(max(n), 0) AS most,
  (SELECT count(*) FROM (SELECT DISTINCT ts, place FROM ev WHERE kind = 'delete')) AS "groups" FROM c""", lambda s, d: survival.removal_totals(event_log(s, d)))
query("mannwhitney_u", SURVIVAL + """, x AS (SELECT lifetime_h AS v, actor < 50 AS g FROM sv WHERE died_us IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x
), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)), a AS (SELECT count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, sum(r) FILTER (g) AS r1 FROM r)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, CASE WHEN n1 > 0 AND n2 > 0 THEN round(r1 - n1 * (n1 + 1) / 2, 4) END AS u,
  CASE WHEN n1 > 0 AND n2 > 0 THEN round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))), 0), 4) END AS z FROM a, t""",
  lambda s, d: ranks.mann_whitney(subjects(s, d).where("died_us is not null").withColumn("g", F.col("actor") < 50), "lifetime_h", "g"))
query("session_alpha_spearman", E + """, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY actor ORDER BY ts, id))) / 1e6 AS gap FROM ev
), s AS (SELECT *, sum(CASE WHEN gap > 28800 THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g
), p AS (SELECT actor, session, place::INTEGER AS letter, row_number() OVER (PARTITION BY actor, session ORDER BY ts, id) AS pos, count(*) OVER (PARTITION BY actor, session) AS n FROM s
), r AS (SELECT actor, session, rank() OVER (PARTITION BY actor, session ORDER BY letter) + (count(*) OVER (PARTITION BY actor, session, letter) - 1) / 2 AS rx, pos::DOUBLE AS ry FROM p WHERE n >= 8)
SELECT actor, session::BIGINT AS session, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY ALL HAVING corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry))""", lambda s, d: order_in_sessions(event_log(s, d)))


def order_in_sessions(events, gap_s: float = 28800, least: int = 8):
    """Spearman correlation of place number and position, in sessions that are long enough."""
    rows = activity.sessions(events, "actor", gap_s).withColumn("letter", F.col("place").cast("int"))
    found = ranks.spearman(rows, "letter", "position", "actor", "session")
    return found.where((F.col("n") >= least) & F.col("rho").isNotNull() & ~F.isnan("rho")).withColumn("session", F.col("session").cast("long"))
