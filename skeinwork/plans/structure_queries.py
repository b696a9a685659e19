"""Queries on directed structure, page references, hosts in texts, populations and further nulls."""

from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import text as T
from ..operators import activity, copies, diffusion, handoff, leiden, network, paths, populations, references, replicates, structure, survival
from ..sources.shared import written
from ..sources.tables import BOUNDARY, EVENT_LOG_SQL, event_log, table
from .event_queries import PAIRS, edges, pairs
from .text_queries import PLAIN

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


E = f"WITH {EVENT_LOG_SQL}"
ERA = f"CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 'after' ELSE 'before' END"

# directed structure
REACH = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges
), reach AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b)"""
STRONG = REACH + ", strong AS (SELECT x.a AS node, min(x.b) AS root FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"
query("strong_components", STRONG + " SELECT node, root FROM strong", lambda s, d: structure.strong_components(edges(s, d), written))
query("component_profile", STRONG.replace("strong AS (SELECT x.a", "bw AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), wreach AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.y FROM wreach r JOIN bw e ON e.x = r.b), weak AS (SELECT a AS node, min(b) AS root FROM wreach GROUP BY a), strong AS (SELECT x.a")
      + """, ws AS (SELECT count(*) AS k FROM weak GROUP BY root), ss AS (SELECT count(*) AS k FROM strong GROUP BY root)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM ws) AS weak_components, (SELECT max(k) FROM ws) AS giant_weak, round((SELECT max(k) FROM ws) / (SELECT count(*) FROM n), 6) AS giant_weak_share,
  (SELECT count(*) FROM ss) AS strong_components, (SELECT max(k) FROM ss) AS giant_strong, round((SELECT max(k) FROM ss) / (SELECT count(*) FROM n), 6) AS giant_strong_share""",
      lambda s, d: structure.component_profile(edges(s, d), written))
query("triad_census", PAIRS + """, p AS (SELECT src AS a, dst AS b FROM edges), n AS (SELECT a AS v FROM p UNION SELECT b FROM p
), t AS (SELECT x.v AS x, y.v AS y, z.v AS z FROM n x JOIN n y ON x.v < y.v JOIN n z ON y.v < z.v
), c AS (SELECT (q1.a IS NOT NULL)::INT AS xy, (q2.a IS NOT NULL)::INT AS yx, (q3.a IS NOT NULL)::INT AS xz, (q4.a IS NOT NULL)::INT AS zx, (q5.a IS NOT NULL)::INT AS yz, (q6.a IS NOT NULL)::INT AS zy FROM t
  LEFT JOIN p q1 ON q1.a = x AND q1.b = y LEFT JOIN p q2 ON q2.a = y AND q2.b = x LEFT JOIN p q3 ON q3.a = x AND q3.b = z LEFT JOIN p q4 ON q4.a = z AND q4.b = x LEFT JOIN p q5 ON q5.a = y AND q5.b = z LEFT JOIN p q6 ON q6.a = z AND q6.b = y
), d AS (SELECT xy * yx + xz * zx + yz * zy AS m, (xy <> yx)::INT + (xz <> zx)::INT + (yz <> zy)::INT AS w, list_sort([xy + xz, yx + yz, zx + zy]) AS o, list_sort([yx + zx, xy + zy, xz + yz]) AS i FROM c
), k AS (SELECT CASE WHEN m = 3 THEN '300' WHEN m = 2 THEN CASE w WHEN 1 THEN '210' ELSE '201' END
  WHEN m = 1 AND w = 2 THEN CASE WHEN i = [0, 2, 2] THEN '120D' WHEN o = [0, 2, 2] THEN '120U' ELSE '120C' END WHEN m = 1 AND w = 1 THEN CASE WHEN i = [0, 1, 2] THEN '111D' ELSE '111U' END WHEN m = 1 THEN '102'
  WHEN w = 3 THEN CASE WHEN o = [1, 1, 1] THEN '030C' ELSE '030T' END WHEN w = 2 THEN CASE WHEN o = [0, 0, 2] THEN '021D' WHEN i = [0, 0, 2] THEN '021U' ELSE '021C' END WHEN w = 1 THEN '012' ELSE '003' END AS triad FROM d
), names AS (SELECT unnest(['003', '012', '102', '021D', '021U', '021C', '111D', '111U', '030T', '030C', '201', '120D', '120U', '120C', '210', '300']) AS triad)
SELECT names.triad, count(k.triad) AS n FROM names LEFT JOIN k ON k.triad = names.triad GROUP BY names.triad""", lambda s, d: structure.triad_census(edges(s, d), written))
MARKS = ", mk AS (SELECT era, round(avg(a::INT), 6) AS crowded_share, round(avg(b::INT), 6) AS low_share, round(avg((a OR b)::INT), 6) AS any_share FROM (SELECT " + ERA + " AS era, place::INTEGER % 7 = 0 AS a, place::INTEGER < 10 AS b FROM ev WHERE kind = 'save') GROUP BY era)"
query("structural_break", PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", x AS (SELECT {ERA} AS era, source AS src, target AS dst, count(*) AS w FROM pairs GROUP BY ALL
), n AS (SELECT era, src AS v FROM x UNION SELECT era, dst FROM x), nn AS (SELECT era, count(*) AS n FROM n GROUP BY era
), u AS (SELECT DISTINCT era, least(src, dst) AS a, greatest(src, dst) AS b FROM x), b2 AS (SELECT era, a AS x, b AS y FROM u UNION ALL SELECT era, b, a FROM u
), tri AS (SELECT p.era, count(*) AS t FROM u p JOIN u q ON q.era = p.era AND q.a = p.b JOIN u r ON r.era = p.era AND r.a = p.a AND r.b = q.b GROUP BY p.era), dg AS (SELECT era, x, count(*) AS d FROM b2 GROUP BY ALL), tp AS (SELECT era, sum(d * (d - 1) // 2) AS p FROM dg GROUP BY era
), reach AS (SELECT era, v AS a, v AS b FROM n UNION SELECT r.era, r.a, e.y FROM reach r JOIN b2 e ON e.era = r.era AND e.x = r.b), gi AS (SELECT era, max(k) AS g FROM (SELECT era, a, count(*) AS k FROM reach GROUP BY ALL) GROUP BY era
), rc AS (SELECT e.era, count(*) AS m FROM x e JOIN x f ON f.era = e.era AND f.src = e.dst AND f.dst = e.src GROUP BY e.era){MARKS}
SELECT x.era, sum(w)::BIGINT AS events, any_value(n) AS nodes, count(*) AS edges, round(count(*) / (any_value(n) * (any_value(n) - 1)), 6) AS density, round(coalesce(any_value(m), 0) / count(*), 6) AS reciprocity,
  round(coalesce(3 * any_value(t), 0) / any_value(p), 6) AS transitivity, round(any_value(g) / any_value(n), 6) AS giant_share, round(count(*) / any_value(n), 6) AS mean_out_degree, any_value(crowded_share) AS crowded_share, any_value(low_share) AS low_share, any_value(any_share) AS any_share
FROM x JOIN nn ON nn.era = x.era LEFT JOIN tri ON tri.era = x.era JOIN tp ON tp.era = x.era JOIN gi ON gi.era = x.era LEFT JOIN rc ON rc.era = x.era JOIN mk ON mk.era = x.era GROUP BY x.era""", lambda s, d: eras(s, d, False, False).drop("max_core", "modularity"))
query("structural_break_cores", None, lambda s, d: eras(s, d).select("era", "max_core", "modularity"))
query("centrality_table", None, lambda s, d: structure.centrality_table(edges(s, d), written))
# betweenness by layers of at most three hops: the SQL holds for networks of no longer shortest paths
BETWEEN = PAIRS + """, g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), l AS (SELECT a AS x, b AS y FROM g UNION ALL SELECT b, a FROM g), n AS (SELECT x AS v, count(*) AS degree FROM l GROUP BY x
), s1 AS (SELECT x AS s, y AS v, 1 AS p FROM l
), s2 AS (SELECT s, y AS v, sum(p) AS p FROM s1 JOIN l ON l.x = s1.v WHERE y <> s AND NOT EXISTS (SELECT 1 FROM s1 q WHERE q.s = s1.s AND q.v = y) GROUP BY s, y
), s3 AS (SELECT s2.s, y AS v, sum(p) AS p FROM s2 JOIN l ON l.x = s2.v WHERE y <> s2.s AND NOT EXISTS (SELECT 1 FROM s1 q WHERE q.s = s2.s AND q.v = y) AND NOT EXISTS (SELECT 1 FROM s2 q WHERE q.s = s2.s AND q.v = y) GROUP BY s2.s, y
), d2 AS (SELECT s2.s, s2.v, sum(s2.p / s3.p) AS d FROM s2 JOIN l ON l.x = s2.v JOIN s3 ON s3.s = s2.s AND s3.v = l.y GROUP BY ALL
), d1 AS (SELECT s1.s, s1.v, sum(s1.p / s2.p * (1 + coalesce(d2.d, 0))) AS d FROM s1 JOIN l ON l.x = s1.v JOIN s2 ON s2.s = s1.s AND s2.v = l.y LEFT JOIN d2 ON d2.s = s2.s AND d2.v = s2.v GROUP BY s1.s, s1.v
), b AS (SELECT v, sum(d) AS t FROM (SELECT v, d FROM d1 UNION ALL SELECT v, d FROM d2) GROUP BY v
), bt AS (SELECT n.v AS node, degree, round(coalesce(t, 0) / greatest(1, ((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)), 9) AS betweenness FROM n LEFT JOIN b ON b.v = n.v)"""
RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2) / count(*) OVER ()"
query("avg_rank_brokerage", BETWEEN + f" SELECT node, degree, betweenness, CASE WHEN count(*) OVER () > 2 AND min(degree) OVER () < max(degree) OVER () THEN round({RANK.format('betweenness')} - {RANK.format('degree')}, 6) END AS brokerage FROM bt",
      lambda s, d: structure.brokerage(written(network.degree(undirected(s, d)).select("node", "degree").join(replicates.betweenness(undirected(s, d), keep=written), "node"), "betweenness")))
query("betweenness_exact", BETWEEN + " SELECT node, betweenness FROM bt", lambda s, d: replicates.betweenness(undirected(s, d), keep=written))
DEG = PAIRS + ", deg AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree FROM (SELECT src AS node, 0 AS i, 1 AS o, weight FROM edges UNION ALL SELECT dst, 1, 0, weight FROM edges) GROUP BY node)"
TOP = DEG + ", top AS (SELECT * FROM edges ORDER BY weight DESC, src, dst LIMIT 150)"
customers = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("segment"))
query("graph_payload_nodes", TOP + ", t AS (SELECT src AS v FROM top UNION SELECT dst FROM top) SELECT c_custkey AS node, c_mktsegment AS segment, in_degree, out_degree, degree, weighted_degree FROM customer JOIN t ON v = c_custkey LEFT JOIN deg ON node = c_custkey",
      lambda s, d: structure.graph_payload(edges(s, d), customers(s, d), 150)[0])
query("graph_payload_links", TOP + " SELECT src, dst, weight FROM top", lambda s, d: structure.graph_payload(edges(s, d), customers(s, d), 150)[1].select("src", "dst", "weight"))
query("node_metadata", DEG + " SELECT node, degree, c_mktsegment AS segment FROM deg LEFT JOIN customer ON c_custkey = node", lambda s, d: handoff.degrees(edges(s, d)).select("node", "degree").join(customers(s, d), "node", "left"))
query("mean_clustering", PAIRS + """, g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), l AS (SELECT a AS x, b AS y FROM g UNION ALL SELECT b, a FROM g), n AS (SELECT x, count(*) AS d FROM l GROUP BY x
), t AS (SELECT p.x, count(*) AS t FROM l p JOIN l q ON q.x = p.x AND q.y > p.y JOIN g ON g.a = p.y AND g.b = q.y GROUP BY p.x) SELECT round(avg(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END), 6) AS mean_clustering FROM n LEFT JOIN t ON t.x = n.x""",
      lambda s, d: network.local_clustering(undirected(s, d)).agg(F.round(F.avg("clustering"), 6).alias("mean_clustering")))
LN = "(-ln(degree) - ln(sd) - 0.5 * ln(2 * pi()) - pow(ln(degree) - mu, 2) / (2 * sd * sd))"
query("power_law_or_lognormal", PAIRS + f""", g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), deg AS (SELECT x, count(*) AS degree FROM (SELECT a AS x FROM g UNION ALL SELECT b FROM g) GROUP BY x
), f AS (SELECT count(*) AS n, 1 + count(*) / sum(ln(degree / 0.5)) AS alpha, avg(ln(degree)) AS mu, stddev_samp(ln(degree)) AS sd, avg(degree) AS mean, max(degree) AS most FROM deg
), r AS (SELECT *, ln((alpha - 1) / 0.5) - alpha * ln(degree / 0.5) AS p, {LN} AS q FROM deg, f)
SELECT any_value(n) AS n, round(any_value(alpha), 6) AS alpha, round(sum(p), 4) AS loglik_power_law, round(sum(q), 4) AS loglik_lognormal, round(sum(p - q), 4) AS likelihood_ratio, round(sum(p - q) / (stddev_samp(p - q) * sqrt(any_value(n))), 4) AS z, round(any_value(mean), 6) AS mean, any_value(most) AS most FROM r""",
      lambda s, d: network.power_law_or_lognormal(undirected(s, d)).drop("p_value", "preferred"))
query("power_law_verdict", None, lambda s, d: network.power_law_or_lognormal(undirected(s, d)).select("n", "p_value", "preferred"))

query("betweenness_by_joins", BETWEEN + " SELECT node, betweenness FROM bt", lambda s, d: paths.betweenness(undirected(s, d), written))

# layers of two kinds, with nodes
query("bipartite_nodes", E + """, f AS (SELECT 'actor:' || actor AS node, 'actor' AS kind, 0 AS bipartite, ts FROM ev WHERE kind = 'save' UNION ALL SELECT 'place:' || place, 'place', 1, ts FROM ev WHERE kind = 'save')
SELECT node, kind, bipartite, count(*) AS n_events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM f GROUP BY ALL""", lambda s, d: network.bipartite_nodes(event_log(s, d).where("kind = 'save'"), "actor", "place"))
query("label_prefix_edges", E + " SELECT 'label:' || actor AS src, 'prefix:' || left(place, 1) AS dst, count(*) AS weight, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM ev WHERE kind = 'save' AND actor NOT IN (0, 1, 2) GROUP BY 1, 2",
      lambda s, d: network.bipartite(populations.agent_rows(event_log(s, d).where("kind = 'save'"), "actor", [0, 1, 2]).select(F.col("actor").alias("label"), F.substring("place", 1, 1).alias("prefix"), "ts"), "label", "prefix"))
query("projection_nodes", "WITH m AS (SELECT DISTINCT l_partkey AS g, l_suppkey AS m FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM m) SELECT m AS node, sum(k - 1)::BIGINT AS touches, count(*) AS strength FROM k WHERE k >= 2 GROUP BY m",
      lambda s, d: network.projection_nodes(table(s, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_suppkey").alias("m")).distinct(), "g", "m"))
query("projection_seen", E + """, m AS (SELECT place, actor, max(epoch_us(max(ts))) OVER (PARTITION BY place) AS seen FROM ev WHERE kind = 'save' GROUP BY place, actor), k AS (SELECT *, count(*) OVER (PARTITION BY place) AS k FROM m)
SELECT x.actor AS a, y.actor AS b, round(sum(1 / (x.k - 1)), 6) AS w, count(*) AS shared, min(x.seen) AS first_seen, max(x.seen) AS last_seen FROM k x JOIN k y ON x.place = y.place AND x.actor < y.actor GROUP BY x.actor, y.actor""", lambda s, d: projection_seen(s, d))
query("first_touch", E + """, r AS (SELECT place, kind, value, row_number() OVER (PARTITION BY place ORDER BY ts, id) AS k, row_number() OVER (PARTITION BY place, value > 50 ORDER BY ts, id) AS j FROM ev)
SELECT place, max(kind) FILTER (k = 1) AS kind, max(value) FILTER (value > 50 AND j = 1) AS large FROM r GROUP BY place""", lambda s, d: network.first_touch(event_log(s, d).withColumn("large", F.when(F.col("value") > 50, F.col("value"))), "place", "kind", "large"))
query("core_view", DEG.replace("deg AS (", "und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst GROUP BY ALL), deg AS (") + ", ud AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM und UNION ALL SELECT b FROM und) GROUP BY node) SELECT node FROM ud ORDER BY d DESC, node LIMIT 12", lambda s, d: structure.inner_core(undirected(s, d), network.k_core(undirected(s, d), written), 1 << 30, 12))
query("kind_counts", E + " SELECT 'actor' AS kind, count(DISTINCT actor) AS n FROM ev WHERE kind = 'save' UNION ALL SELECT 'place', count(DISTINCT place) FROM ev WHERE kind = 'save'", lambda s, d: network.bipartite_nodes(event_log(s, d).where("kind = 'save'"), "actor", "place").groupBy("kind").agg(F.count("*").alias("n")))
query("layer_report", None, lambda s, d: layer_report(s, d))
query("activity_prefixes", E + ", g AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 day)) AS b FROM ev) SELECT epoch_us(b) AS bucket_us, count(DISTINCT left(place, 1)) FILTER (kind = 'save') AS prefix_values FROM g LEFT JOIN ev ON date_trunc('day', ts) = b GROUP BY b",
      lambda s, d: activity.series(event_log(s, d).withColumn("prefix", F.substring("place", 1, 1)), "day", ("prefix",)).select("bucket_us", "prefix_values"))
query("orders_of_large_customers", "SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000 GROUP BY 1",
      lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal > 5000"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers")))
page_rows = lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 17).alias("label"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("page"), F.timestamp_seconds(F.col("page_id") * 1000).alias("ts"), F.col("url").alias("body"))
PAGEROWS = f"WITH p AS (SELECT page_id, page_id % 17 AS label, 'p' || page_id AS page, page_id * 1000000000 AS us, {PLAIN} AS host FROM pages)"
layer = lambda s, d, left: network.bipartite(references.host_mentions(page_rows(s, d), T.TEST_RULES).select(left, "host", "ts"), left, "host")
query("page_host_edges", PAGEROWS + " SELECT 'page:' || page AS src, 'host:' || host AS dst, count(*) AS weight, min(us) AS first_us, max(us) AS last_us FROM p GROUP BY 1, 2", lambda s, d: layer(s, d, "page"))
query("label_host_edges", PAGEROWS + " SELECT 'label:' || label AS src, 'host:' || host AS dst, count(*) AS weight, min(us) AS first_us, max(us) AS last_us FROM p GROUP BY 1, 2", lambda s, d: layer(s, d, "label"))
query("label_host_agents", PAGEROWS + " SELECT 'label:' || label AS src, 'host:' || host AS dst, count(*) AS weight, min(us) AS first_us, max(us) AS last_us FROM p WHERE label NOT IN (0, 1, 2) GROUP BY 1, 2",
      lambda s, d: network.bipartite(populations.agent_rows(references.host_mentions(page_rows(s, d), T.TEST_RULES), "label", [0, 1, 2]).select("label", "host", "ts"), "label", "host"))
query("host_techniques", PAGEROWS + " SELECT CASE WHEN regexp_matches(host, '\\.example\\.(com|org|net)$') THEN 'example' WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){3}$') THEN 'address' WHEN regexp_matches(host, '[0-9]') THEN 'numbered' ELSE 'other' END AS technique, count(*) AS n, count(DISTINCT host) AS hosts, false AS obfuscated FROM p GROUP BY 1",
      lambda s, d: references.host_mentions(page_rows(s, d), T.TEST_RULES).groupBy("technique").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.max("obfuscated").alias("obfuscated")))
ESCAPED = "CASE WHEN page_id % 3 = 0 THEN replace(url, '.', '%2e') WHEN page_id % 3 = 1 THEN replace(url, 'example', '%65xample') ELSE url END"
escaped = lambda s, d: page_rows(s, d).withColumn("actor", F.col("label")).withColumn("body", F.expr(ESCAPED.replace("page_id", "id").replace("url", "body")))
query("obfuscated_hosts", f"""WITH p AS (SELECT page_id AS id, page_id % 17 AS actor, page_id * 1000000000 AS us, {PLAIN} AS host, lower({ESCAPED}) <> lower(url) AS obfuscated, regexp_extract({ESCAPED}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS raw FROM pages
), o AS (SELECT * FROM p WHERE obfuscated AND raw LIKE '%\\%%' ESCAPE '\\') SELECT host, count(*) AS mentions, count(DISTINCT id) AS texts, count(DISTINCT actor) AS actors, count(DISTINCT raw) AS forms, min(us) AS first_us, max(us) AS last_us, count(DISTINCT us // 86400000000) AS days FROM o GROUP BY host""",
      lambda s, d: references.obfuscated_hosts(references.host_mentions(escaped(s, d), T.TEST_RULES)).drop("examples"))

# page references: bodies made of a page's URL (of every third page with an escaped host), its links in brackets, and a bare word
BODY = "url || ' ' || array_to_string(list_transform(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1), lambda h: '[[' || h || '|see]]'), ' ') || ' Nation' || (page_id % 30) || 'Word NationWord'"
bodies = lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("w").alias("wiki"), F.concat(F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"\.example\.", "%2eexample%252e")).otherwise(F.col("url")), F.lit(" "), F.array_join(F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda h: F.concat(F.lit("[["), h, F.lit("|see]]"))), " "), F.lit(" Nation"), (F.col("page_id") % 30).cast("string"), F.lit("Word NationWord")).alias("body"))
nations = lambda s, d: table(s, d, "nation").select(F.lit("w").alias("wiki"), F.concat(F.lit("Nation"), F.col("n_nationkey").cast("string"), F.lit("Word")).alias("name"))
refs = lambda s, d: references.page_refs(bodies(s, d), nations(s, d), r"\.example\.(com|org|net)$", r"/([a-z]{2})/[0-9]", r"[?&](?:page|ref)=([^&#\s]+)")
REFS = f"""WITH p AS (SELECT page_id AS id, url, {BODY} AS body, {PLAIN} AS host FROM pages
), u AS (SELECT id, coalesce(nullif(regexp_extract(url, '/([a-z]{{2}})/[0-9]', 1), ''), 'w') AS wiki, unnest(regexp_extract_all(url, '[?&](?:page|ref)=([^&# ]+)', 1)) AS name, 0 AS r FROM p WHERE regexp_matches(host, '\\.example\\.(com|org|net)$')
), b AS (SELECT id, 'w' AS wiki, unnest(regexp_extract_all(body, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) AS name, 1 AS r FROM p
), c AS (SELECT id, wiki, split_part(regexp_replace(trim(name), '[.,;:!?]+$', ''), '#', 1) AS name, r FROM (SELECT * FROM u UNION ALL SELECT * FROM b)
), w AS (SELECT id, 'w' AS wiki, 'Nation' || (id % 30) || 'Word' AS name, 2 AS r FROM p WHERE id % 30 IN (SELECT n_nationkey FROM nation)
), e AS (SELECT id, wiki, name, min(r) AS r FROM (SELECT * FROM c WHERE name <> '' UNION ALL SELECT * FROM w) GROUP BY ALL
), f AS (SELECT id, 'w' AS source_wiki, wiki, name, ['cgi_url', 'bracket', 'wikiword'][r + 1] AS mechanism FROM e)"""
query("page_refs", REFS + " SELECT * FROM f", refs)
query("page_links", REFS + """, x AS (SELECT 'w~P' || (id % 40) AS src, wiki || '~' || name AS dst, mechanism, id * 1000000 AS us, id FROM f), y AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY us, id, mechanism) AS k FROM x WHERE src <> dst)
SELECT src, dst, count(*) AS weight, min(us) AS first_us, max(us) AS last_us, max(mechanism) FILTER (k = 1) AS mechanism, dst IN (SELECT 'w~Nation' || n_nationkey || 'Word' FROM nation) AS in_corpus FROM y GROUP BY src, dst""",
      lambda s, d: page_links(s, d))
TECHNIQUE = "CASE WHEN regexp_matches(host, '\\.example\\.(com|org|net)$') THEN 'example' WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){3}$') THEN 'address' WHEN regexp_matches(host, '[0-9]') THEN 'numbered' ELSE 'other' END"
query("extraction_summary", REFS + f""", h AS (SELECT id, host FROM p), x(section, key, n) AS (
SELECT 'total', 'texts', count(*) FROM p UNION ALL SELECT 'total', 'urls', count(*) FROM h UNION ALL SELECT 'total', 'distinct_hosts', count(DISTINCT host) FROM h UNION ALL SELECT 'total', 'texts_with_obfuscated_host', count(*) FROM p WHERE id % 3 = 0 AND contains(url, '.example.')
UNION ALL SELECT 'total', 'obfuscated_mentions', count(*) FROM p WHERE id % 3 = 0 AND contains(url, '.example.') UNION ALL SELECT 'total', 'page_refs', count(*) FROM f UNION ALL SELECT 'technique', {TECHNIQUE}, count(*) FROM h GROUP BY 2
UNION ALL SELECT 'mechanism', mechanism, count(*) FROM f GROUP BY 2 UNION ALL (SELECT 'host', host, count(*) AS k FROM h GROUP BY 2 ORDER BY k DESC, host LIMIT 40) UNION ALL SELECT 'motif', 'has_number', count(*) FROM p WHERE regexp_matches(url, '[0-9]') HAVING count(*) > 0)
SELECT section, key, n::BIGINT AS n FROM x""", lambda s, d: summary(s, d))
query("marked_names", f"WITH p AS (SELECT {PLAIN} AS host, url, page_id FROM pages) SELECT host, count(*) FILTER (regexp_matches(url, '[0-9]{{3}}')) AS marked, count(*) FILTER (regexp_matches(url, '[0-9]{{3}}') AND page_id % 2 = 0) AS marked_gone, count(*) AS n FROM p GROUP BY host",
      lambda s, d: references.marked_share(table(s, d, "pages").withColumn("host", T.plain_host(T.raw_host(F.col("url")))), "host", F.col("url").rlike("[0-9]{3}"), F.col("page_id") % 2 == 0))
query("dominant_without_placeholder", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY ALL) SELECT source, lang AS category, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1", lambda s, d: references.dominant_category(table(s, d, "documents"), "source", "lang", ("en",)))

# which rows count
query("agent_rows", E + " SELECT kind, count(*) AS n, count(DISTINCT actor) AS actors FROM ev WHERE actor NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 6) AND place <> '' GROUP BY kind",
      lambda s, d: populations.agent_rows(event_log(s, d), "actor", table(s, d, "supplier").where("s_suppkey < 6").select("s_suppkey")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("actor").alias("actors")))
query("member_rows", E + " SELECT count(*) FILTER (i) AS inside, count(*) FILTER (NOT i) AS outside FROM (SELECT actor IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS i FROM ev)", lambda s, d: membership(s, d))
BOUNDS = {"early": (None, "2024-01-10"), "middle": ("2024-01-10", "2024-01-20"), "late": ("2024-01-20", None)}
query("era_counts", E + " SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'early' WHEN ts < TIMESTAMP '2024-01-20' THEN 'middle' ELSE 'late' END AS era, count(*) AS n, count(*) FILTER (hour(ts) BETWEEN 18 AND 21) AS evening, count(*) FILTER ((hour(ts) + 2) % 24 BETWEEN 1 AND 7) AS local_night FROM ev GROUP BY 1",
      lambda s, d: event_log(s, d).groupBy(populations.era(F.col("ts"), BOUNDS).alias("era")).agg(F.count("*").alias("n"), F.count_if(F.hour("ts").between(18, 21)).alias("evening"), F.count_if(populations.local_hour(F.col("ts"), 2).between(1, 7)).alias("local_night")))
query("any_motif_share", "SELECT round(avg((contains(url, '-') OR regexp_matches(lower(url), 'page|item') OR regexp_matches(lower(url), 'news|blog|post'))::INT), 6) AS any_share, count(*) AS n FROM pages",
      lambda s, d: table(s, d, "pages").select(populations.any_of(*[T.motif_flags(F.col("url"))[k] for k in ("has_dash", "has_page", "has_news")]).alias("x")).agg(F.round(F.avg(F.col("x").cast("int")), 6).alias("any_share"), F.count("*").alias("n")))
query("thinned_days", E + ", c AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM ev GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS k FROM c) SELECT epoch_us(day) AS day_us, n FROM r WHERE k % 3 = 0",
      lambda s, d: populations.thinned(event_log(s, d).groupBy(F.unix_micros(F.date_trunc("day", "ts")).alias("day_us")).agg(F.count("*").alias("n")), "day_us"))
query("split_names", "SELECT c_custkey AS id, split_part(c_name, '#', 1) AS wiki, split_part(c_name, '#', 2) AS name, split_part(c_name, '#', 1) || '~' || left(split_part(c_name, '#', 2), 12) AS block, CASE WHEN upper(left(c_mktsegment, 1)) BETWEEN 'A' AND 'Z' THEN ascii(upper(left(c_mktsegment, 1))) - 65 END AS letter FROM customer", lambda s, d: names(s, d))

# nulls and verdicts
query("share_null", None, lambda s, d: share_null(s, d))
query("reciprocity_null", None, lambda s, d: ranks.compare_to_null(replicates.reciprocity_null(edges(s, d), 200), "reciprocity", handoff.reciprocity(edges(s, d)).first()["reciprocity"]))
query("partition_null", None, lambda s, d: replicates.partition_test(table(s, d, "documents"), "lang", "source"))
query("community_profile", None, lambda s, d: structure.community_profile(undirected(s, d), written))
query("community_evolution", None, lambda s, d: leiden.evolution(pairs(s, d).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.unix_micros("ts").alias("us")), written))
query("exposure_tests", None, lambda s, d: exposure_tests(s, d))
query("test_p_values", None, lambda s, d: p_values(s, d))


def page_links(s, d):
    return references.hyperlinks(refs(s, d), table(s, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("w~P"), (F.col("page_id") % 40).cast("string")).alias("page"), F.timestamp_seconds("page_id").alias("ts")), nations(s, d))


def summary(s, d):
    rows = bodies(s, d)
    return references.extraction_summary(rows, references.host_mentions(rows.select("id", "body"), T.TEST_RULES), refs(s, d), table(s, d, "pages").select(F.col("url").alias("name")), {"has_number": "[0-9]"})


def projection_seen(s, d):
    saves = event_log(s, d).where("kind = 'save'")
    seen = saves.groupBy("place").agg(F.max(F.unix_micros("ts")).alias("seen"))
    return network.newman_projection(saves.select("place", "actor").distinct().join(seen, "place"), "place", "actor", seen="seen")


def undirected(s, d):
    return network.undirected(edges(s, d), "weight")


def layer_report(s, d):
    saves = event_log(s, d).where("kind = 'save'")
    people = populations.agent_rows(saves, "actor", [0, 1, 2])
    mentions = references.host_mentions(page_rows(s, d), T.TEST_RULES)
    docs = table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    seen = saves.groupBy("place", "actor").agg(F.lit(1).alias("there"))
    pairs_of = network.newman_projection(seen.select("place", "actor"), "place", "actor")
    layers = {
        "handoff": (edges(s, d), True, False), "two kinds": (network.bipartite(saves, "actor", "place"), False, True), "projection": (pairs_of.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")), False, True),
        "links": (page_links(s, d), True, False), "page and host": (network.bipartite(mentions, "page", "host"), False, True), "label and host": (network.bipartite(mentions.where("label > 2"), "label", "host"), False, True),
        "label and prefix": (network.bipartite(people.select(F.col("actor").alias("label"), F.substring("place", 1, 1).alias("prefix"), "ts"), "label", "prefix"), False, True),
        "copies": (copies.exact_chain(docs, "digest", "doc_id", None).select("src", "dst", F.lit(1).alias("weight")), True, False),
    }
    return structure.layer_report(layers, written)


def eras(s, d, parts: bool = True, inner: bool = True):
    marks = event_log(s, d).where("kind = 'save'").select("ts", (F.col("place").cast("int") % 7 == 0).alias("crowded"), (F.col("place").cast("int") < 10).alias("low"))
    return structure.structural_break(pairs(s, d), marks, activity.era_of(BOUNDARY), written, parts=parts, inner=inner)


def membership(s, d):
    there = table(s, d, "customer").where("c_acctbal > 0").select("c_custkey")
    inside, outside = (populations.members(event_log(s, d), "actor", there, i).agg(F.count("*").alias(n)) for i, n in ((True, "inside"), (False, "outside")))
    return inside.crossJoin(outside)  # one row each


def names(s, d):
    wiki, name = populations.split_key(F.regexp_replace("c_name", "#", "~"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), wiki.alias("wiki"), F.coalesce(name, F.lit("")).alias("name"), populations.blocking_key(wiki, F.coalesce(name, F.lit(""))).alias("block"), populations.letter_position(F.col("c_mktsegment")).alias("letter"))


def share_null(s, d, n: int = 2000):
    """Whether saves in hours with removals are a smaller share after the boundary; against shuffled eras."""
    log = event_log(s, d)
    hours = log.where("kind = 'delete'").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("k")).where(F.col("k") >= 2)
    saves = log.where("kind = 'save'").select(F.hour("ts").alias("hour"), (activity.era_of(BOUNDARY) == "before").alias("first")).join(F.broadcast(hours), "hour", "left")  # 24 rows
    r = saves.agg(F.count("*").alias("n"), F.count_if("first").alias("first"), F.count("k").alias("inside"), F.count_if(F.col("first") & F.col("k").isNotNull()).alias("both")).first()
    seen = r.both / max(1, r["first"]) - (r.inside - r.both) / max(1, r.n - r["first"])
    return ranks.compare_to_null(replicates.drawn_share(r.inside, r.n, r["first"], s, n), "difference", seen, "zero")


def exposure_tests(s, d, n: int = 200):
    """The exposure test for every place that anyone saved."""
    firsts = diffusion.first_use(event_log(s, d).where("kind = 'save'"), "place", "actor")
    return diffusion.exposure_tests(firsts, "place", undirected(s, d), n)


def p_values(s, d):
    """test, n, p_value of the rank tests."""
    log = event_log(s, d)
    lives = survival.survival(log, ("place", "actor")).where("died_us is not null").withColumn("g", F.col("actor") < 50)
    u = ranks.p_values(ranks.mann_whitney(lives, "lifetime_h", "g"), "mann_whitney").select(F.lit("mann_whitney").alias("test"), (F.col("n1") + F.col("n2")).alias("n"), "p_value")
    w = ranks.p_values(ranks.wilcoxon(survival.paired_exposure(log, activity.era_of(BOUNDARY)), "difference"), "wilcoxon").select(F.lit("wilcoxon").alias("test"), "n", "p_value")
    rho = ranks.p_values(ranks.spearman(log.select(F.col("place").cast("int").alias("x"), F.col("value").alias("y")), "x", "y"), "spearman").select(F.lit("spearman").alias("test"), "n", "p_value")
    return u.unionByName(w).unionByName(rho)
