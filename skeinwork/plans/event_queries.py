"""Queries over the event log: handoffs and activity."""

from pyspark.sql import functions as F

from ..operators import activity, handoff
from ..sources.tables import BOUNDARY, EVENT_LOG_SQL, event_log

QUERIES, ORACLE_SQL = {}, {}
WINDOWS = {"10m": 600, "1h": 3600, "6h": 21600, "24h": 86400, "inf": None}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


PAIRS = f"""
WITH {EVENT_LOG_SQL}, lagged AS (
  SELECT place, ts, id, actor AS target, lag(actor) OVER o AS source, (epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 1e6 AS gap
  FROM ev WINDOW o AS (PARTITION BY place ORDER BY ts, id)
), every AS (SELECT * FROM lagged WHERE source <> target), pairs AS (SELECT * FROM every WHERE gap <= 21600
), edges AS (
  SELECT source AS src, target AS dst, count(*) AS weight, count(DISTINCT place) AS n_places, min(epoch_us(ts)) AS first_us,
    max(epoch_us(ts)) AS last_us, median(round(gap * 1e6)) AS median_gap_us FROM pairs GROUP BY ALL
)"""


def pairs(s, d):
    return handoff.handoff_pairs(event_log(s, d))


def edges(s, d):
    return handoff.handoff_edges(pairs(s, d))


query("handoff_pairs", PAIRS + " SELECT source, target, place, id, epoch_us(ts) AS ts_us, round(gap, 6) AS gap_seconds FROM pairs")(
    lambda s, d: pairs(s, d).select("source", "target", "place", "id", F.unix_micros("ts").alias("ts_us"), F.round("gap_seconds", 6).alias("gap_seconds"))
)
query("handoff_edges", PAIRS + " SELECT * FROM edges")(edges)
query("handoff_nodes", PAIRS + " SELECT node, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us FROM (SELECT source AS node, epoch_us(ts) AS us FROM pairs UNION ALL SELECT target, epoch_us(ts) FROM pairs) GROUP BY node")(
    lambda s, d: handoff.handoff_nodes(pairs(s, d))
)
SWEEP = ", ".join(f"('{k}', {v if v is not None else 1e18}::DOUBLE)" for k, v in WINDOWS.items())
query("handoff_sensitivity", PAIRS + f"""
, w(win, lim) AS (VALUES {SWEEP}), e AS (SELECT win, source, target, count(*) AS c FROM every JOIN w ON gap <= lim GROUP BY ALL
), n AS (SELECT win, count(DISTINCT node) AS n FROM (SELECT win, source AS node FROM e UNION ALL SELECT win, target FROM e) GROUP BY win
), r AS (SELECT e.win, count(*) AS m FROM e JOIN e f ON f.win = e.win AND f.source = e.target AND f.target = e.source GROUP BY e.win)
SELECT e.win AS "window", sum(c)::BIGINT AS n_events, count(*) AS n_edges, any_value(n) AS n_nodes, round(count(*) / (any_value(n) * (any_value(n) - 1)), 6) AS density,
  round(coalesce(any_value(m), 0) / count(*), 6) AS reciprocity FROM e JOIN n ON n.win = e.win LEFT JOIN r ON r.win = e.win GROUP BY e.win""")(
    lambda s, d: handoff.sensitivity(event_log(s, d), WINDOWS)
)
query("graph_describe", PAIRS + """
SELECT (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) AS n_nodes, count(*) AS n_edges, sum(weight)::BIGINT AS total_weight,
  round(count(*) / ((SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) * ((SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) - 1)), 6) AS density FROM edges""")(lambda s, d: handoff.describe(edges(s, d)))
query("reciprocity", PAIRS + """
SELECT count(*) AS n_edges, count(f.src) AS n_mutual, round(count(f.src) / count(*), 6) AS reciprocity FROM edges e LEFT JOIN edges f ON f.src = e.dst AND f.dst = e.src""")(
    lambda s, d: handoff.reciprocity(edges(s, d))
)
DEGREES = PAIRS + """, deg AS (
SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree
FROM (SELECT src AS node, 0 AS i, 1 AS o, weight FROM edges UNION ALL SELECT dst, 1, 0, weight FROM edges) GROUP BY node)"""
query("degree_table", DEGREES + " SELECT node, in_degree, out_degree, degree FROM deg")(lambda s, d: handoff.degrees(edges(s, d)).drop("weighted_degree"))
query("weighted_degree", DEGREES + " SELECT node, weighted_degree FROM deg")(lambda s, d: handoff.degrees(edges(s, d)).select("node", "weighted_degree"))
query("density_by_era", PAIRS + f"""
, x AS (SELECT CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 'after' ELSE 'before' END AS era, source, target FROM pairs
), e AS (SELECT DISTINCT * FROM x), n AS (SELECT era, count(DISTINCT node) AS n FROM (SELECT era, source AS node FROM e UNION ALL SELECT era, target FROM e) GROUP BY era)
SELECT e.era, any_value(n) AS n_nodes, count(*) AS n_edges, round(count(*) / (any_value(n) * (any_value(n) - 1)), 6) AS density FROM e JOIN n ON n.era = e.era GROUP BY e.era""")(
    lambda s, d: density_by_era(pairs(s, d))
)


def density_by_era(found):
    ways = found.select(activity.era_of(BOUNDARY).alias("era"), "source", "target").distinct()
    nodes = ways.select("era", F.explode(F.array("source", "target")).alias("node")).groupBy("era").agg(F.countDistinct("node").alias("n_nodes"))
    n = F.col("n_nodes")
    return ways.groupBy("era").agg(F.count("*").alias("n_edges")).join(nodes, "era").select("era", "n_nodes", "n_edges", F.round(F.col("n_edges") / (n * (n - 1)), 6).alias("density"))


def series_sql(unit: str) -> str:
    return f"""
WITH {EVENT_LOG_SQL}, grid AS (SELECT unnest(generate_series(date_trunc('{unit}', min(ts)), date_trunc('{unit}', max(ts)), INTERVAL 1 {unit})) AS b FROM ev
), c AS (SELECT date_trunc('{unit}', ts) AS b, count(*) FILTER (kind = 'save') AS saves, count(DISTINCT actor) FILTER (kind = 'save') AS actors,
  count(DISTINCT place) FILTER (kind = 'save') AS places, sum(round(value * 100)::BIGINT) FILTER (kind = 'save') AS cents,
  count(*) FILTER (kind = 'delete') AS deletes, count(*) FILTER (kind = 'probe') AS probes FROM ev GROUP BY 1)
SELECT epoch_us(g.b) AS bucket_us, coalesce(saves, 0) AS saves, coalesce(actors, 0) AS actors, coalesce(places, 0) AS places, coalesce(cents, 0)::BIGINT AS cents,
  coalesce(deletes, 0) AS deletes, coalesce(probes, 0) AS probes FROM grid g LEFT JOIN c ON c.b = g.b"""


query("activity_daily", series_sql("day"))(lambda s, d: activity.series(event_log(s, d), "day"))
query("activity_hourly", series_sql("hour"))(lambda s, d: activity.series(event_log(s, d), "hour"))
query("activity_conserved", f"WITH {EVENT_LOG_SQL} SELECT count(*) FILTER (kind = 'save') AS saves, count(*) FILTER (kind = 'delete') AS deletes, count(*) FILTER (kind = 'probe') AS probes, saves AS raw_saves, deletes AS raw_deletes, probes AS raw_probes FROM ev")(
    lambda s, d: activity.conserved(event_log(s, d), activity.series(event_log(s, d), "day"))
)
query("hour_share", f"WITH {EVENT_LOG_SQL} SELECT h::INTEGER AS hour, count(id) AS n, round(count(id) / (SELECT count(*) FROM ev), 6) AS share FROM (SELECT unnest(range(24)) AS h) LEFT JOIN ev ON hour(ts) = h GROUP BY h")(
    lambda s, d: activity.hour_share(event_log(s, d))
)
query("hour_profile_by_era", f"WITH {EVENT_LOG_SQL}, c AS (SELECT CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 'after' ELSE 'before' END AS era, hour(ts)::INTEGER AS hour, count(*) AS n FROM ev GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY era), 6) AS share FROM c")(
    lambda s, d: activity.hour_profile(event_log(s, d), BOUNDARY)
)
query("day_hour_matrix", f"WITH {EVENT_LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INTEGER AS hour, count(*) FILTER (kind = 'save') AS writes, count(*) FILTER (kind = 'delete') AS deletions FROM ev WHERE kind IN ('save', 'delete') GROUP BY 1, 2")(
    lambda s, d: activity.day_hour(event_log(s, d))
)
query("dispersal_pivot", f"""WITH {EVENT_LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS writes, count(*) FILTER (place::INTEGER % 4 <> 0) AS off_main,
  round(count(*) FILTER (place::INTEGER % 4 <> 0) / count(*), 6) AS off_main_share, {", ".join(f"count(*) FILTER (place::INTEGER % 4 = {i}) AS g{i}" for i in range(4))} FROM ev WHERE kind = 'save' GROUP BY 1""")(
    lambda s, d: activity.dispersal(event_log(s, d), ["g0", "g1", "g2", "g3"], F.concat(F.lit("g"), (F.col("place").cast("int") % 4).cast("string")))
)
GAPS = f"WITH {EVENT_LOG_SQL}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY actor ORDER BY ts, id))) / 1e6 AS gap FROM ev)"
query("burstiness_by_actor", GAPS + " SELECT actor, count(*) AS n, round((stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap)), 4) AS burstiness, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9, 4) AS span_hours, median(round(gap * 1e6)) AS median_gap_us FROM g GROUP BY actor HAVING count(*) >= 5")(
    lambda s, d: activity.burstiness(event_log(s, d), "actor")
)
query("fano_hourly", f"""WITH {EVENT_LOG_SQL}, grid AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 hour)) AS b FROM ev
), c AS (SELECT g.b, count(id) AS n FROM grid g LEFT JOIN ev ON date_trunc('hour', ts) = g.b GROUP BY g.b) SELECT count(*) AS buckets, round(var_samp(n) / avg(n), 4) AS fano FROM c WHERE b >= (SELECT min(ts) FROM ev)""")(
    lambda s, d: activity.fano(event_log(s, d), "hour")
)
SESSIONS = GAPS + ", s AS (SELECT *, sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g)"
query("gap_sessions", SESSIONS + " SELECT actor, session::BIGINT AS session, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM s GROUP BY ALL")(
    lambda s, d: activity.session_table(event_log(s, d), "actor", 7200)
)
query("entropy_concentration", f"""WITH {EVENT_LOG_SQL}, h AS (SELECT hour(ts) AS hour, count(*) AS n FROM ev GROUP BY 1), r AS (SELECT *, n / sum(n) OVER () AS p, sum(n) OVER () AS every,
  row_number() OVER (ORDER BY n DESC, hour) AS k, sum(n) OVER (ORDER BY n DESC, hour) AS cum FROM h)
SELECT round(-sum(p * log2(p)), 6) AS entropy_bits, round(sum(p) FILTER (k <= 3), 6) AS top3_share, count(*) FILTER (cum * 5 < every * 4) + 1 AS hours_80 FROM r""")(lambda s, d: activity.concentration(event_log(s, d)))
query("daily_mode", f"""WITH {EVENT_LOG_SQL}, c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, place, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, place) AS k FROM c)
SELECT day, sum(n)::BIGINT AS mentions, count(*) AS distinct_keys, max(place) FILTER (k = 1) AS top_key FROM r GROUP BY day""")(lambda s, d: activity.daily_mode(event_log(s, d), "place"))
