"""Queries on networks: the handoff graph, projections, partitions, components, replicates."""

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import activity, components, diffusion, leiden, network, replicates, structure, survival
from ..sources import files
from ..sources.shared import written
from ..sources.tables import BOUNDARY, EVENT_LOG_SQL, event_log, table
from .event_queries import PAIRS, edges, pairs

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def graph(s, d):
    return network.undirected(edges(s, d), "weight")


G = PAIRS + """, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight)::BIGINT AS w FROM edges GROUP BY ALL
), ends AS (SELECT a AS node, b AS other, w FROM g UNION ALL SELECT b, a, w FROM g), deg AS (SELECT node, count(*) AS degree, sum(w)::BIGINT AS strength FROM ends GROUP BY node)"""
query("bipartite_edges", f"WITH {EVENT_LOG_SQL} SELECT 'actor:' || actor AS src, 'place:' || place AS dst, count(*) AS weight, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM ev WHERE kind = 'save' GROUP BY 1, 2",
  lambda s, d: network.bipartite(event_log(s, d).where("kind = 'save'"), "actor", "place"))
query("newman_projection", "WITH m AS (SELECT DISTINCT l_partkey AS g, l_suppkey AS m FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM m) SELECT x.m AS a, y.m AS b, round(sum(1 / (x.k - 1)), 6) AS w, count(*) AS shared FROM k x JOIN k y ON x.g = y.g AND x.m < y.m GROUP BY x.m, y.m",
  lambda s, d: network.newman_projection(table(s, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_suppkey").alias("m")).distinct(), "g", "m"))
query("degree_ccdf", G + " SELECT degree, count(*) AS n, round((SELECT count(*) FROM deg y WHERE y.degree >= x.degree) / (SELECT count(*) FROM deg), 6) AS ccdf FROM deg x GROUP BY degree", lambda s, d: network.degree_ccdf(graph(s, d)))
query("power_law_fit", G + """, f AS (SELECT count(*) AS n, 1 + count(*) / sum(ln(degree / 0.5)) AS alpha FROM deg), c AS (SELECT degree, (SELECT count(*) FROM deg y WHERE y.degree <= x.degree) AS cum FROM (SELECT DISTINCT degree FROM deg) x)
SELECT any_value(n) AS n, round(any_value(alpha), 6) AS alpha, round(max(abs(cum / n - (1 - pow(degree / 0.5, 1 - alpha)))), 6) AS ks FROM c, f""", lambda s, d: network.power_law(graph(s, d)))
TRI = G + ", tri AS (SELECT x.a, x.b, y.b AS c FROM g x JOIN g y ON x.b = y.a JOIN g z ON z.a = x.a AND z.b = y.b)"
query("triangles_transitivity", TRI + " SELECT (SELECT count(*) FROM tri) AS n_triangles, sum(degree * (degree - 1) // 2)::BIGINT AS n_triples, round(3 * (SELECT count(*) FROM tri) / sum(degree * (degree - 1) // 2), 6) AS transitivity FROM deg", lambda s, d: network.transitivity(graph(s, d)))
query("local_clustering", TRI + ", t AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY node) SELECT deg.node, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (degree * (degree - 1)) END, 6) AS clustering FROM deg LEFT JOIN t ON t.node = deg.node",
  lambda s, d: network.local_clustering(graph(s, d)))
query("degree_assortativity", G + " SELECT count(*) AS n, round(corr(x.degree, y.degree), 6) AS assortativity FROM ends JOIN deg x ON x.node = ends.node JOIN deg y ON y.node = ends.other", lambda s, d: network.degree_assortativity(graph(s, d)))
labels = lambda s, d: event_log(s, d).select(F.col("actor").alias("node")).distinct().withColumn("label", (F.col("node") % 3).cast("string"))
query("attribute_assortativity", G + ", m AS (SELECT node % 3 AS l, other % 3 AS o, count(*) / (SELECT count(*) FROM ends) AS e FROM ends GROUP BY ALL), r AS (SELECT l, sum(e) AS a, coalesce(sum(e) FILTER (l = o), 0) AS d FROM m GROUP BY l) SELECT count(*) AS n_labels, round((sum(d) - sum(a * a)) / (1 - sum(a * a)), 6) AS assortativity FROM r",
  lambda s, d: network.attribute_assortativity(graph(s, d), labels(s, d)))
query("modularity_given_partition", G + ", p AS (SELECT node % 3 AS c, sum(w) AS d, coalesce(sum(w) FILTER (node % 3 = other % 3), 0) AS i FROM ends GROUP BY 1) SELECT count(*) AS n_classes, round(sum(i / (SELECT sum(w) FROM ends) - pow(d / (SELECT sum(w) FROM ends), 2)), 6) AS modularity FROM p",
  lambda s, d: network.modularity(graph(s, d), labels(s, d).withColumnRenamed("label", "c")))
query("ari_nmi", """WITH x AS (SELECT lang AS p, source AS q, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS h FROM x
), a AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM x GROUP BY p)), b AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM x GROUP BY q))
SELECT t.n::BIGINT AS n, round((t.c - a.c * b.c / (t.n * (t.n - 1) / 2)) / ((a.c + b.c) / 2 - a.c * b.c / (t.n * (t.n - 1) / 2)), 6) AS ari,
  round(((ln(t.n) - a.h / t.n) + (ln(t.n) - b.h / t.n) - (ln(t.n) - t.h / t.n)) / (((ln(t.n) - a.h / t.n) + (ln(t.n) - b.h / t.n)) / 2), 6) AS nmi FROM t, a, b""", lambda s, d: network.agreement(table(s, d, "documents"), "lang", "source"))
copies_sql = "g AS (SELECT lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS a, doc_id AS b FROM documents)"
query("weak_components", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1",
  lambda s, d: components.components(chain(s, d), written))
query("bfs_hops", G.replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT e.other, r.hops + 1 FROM r JOIN ends e ON e.node = r.node WHERE r.hops < 4) SELECT node, min(hops) AS hops FROM r GROUP BY node", lambda s, d: network.bfs(graph(s, d), F.lit(0), written))
SAVES = ", f AS (SELECT place, actor, min(epoch_us(ts)) AS first_us FROM ev WHERE kind = 'save' GROUP BY ALL)"
EXPOSED = G + SAVES + """, m AS (SELECT f.place, f.actor, max((o.first_us < f.first_us)::INTEGER) AS x, count(*) AS c FROM f JOIN ends e ON e.node = f.actor JOIN f o ON o.place = f.place AND o.actor = e.other GROUP BY ALL
), r AS (SELECT f.place, count(*) AS adopters, coalesce(sum(x), 0)::BIGINT AS exposed, (coalesce(sum(c), 0) // 2)::BIGINT AS internal_edges FROM f LEFT JOIN m ON m.place = f.place AND m.actor = f.actor GROUP BY f.place HAVING count(*) >= 10)"""
adopted = lambda s, d: diffusion.exposed_share(diffusion.first_use(event_log(s, d).where("kind = 'save'"), "place", "actor"), edges(s, d), "place")
query("exposed_share", EXPOSED + " SELECT place, adopters, exposed, round(exposed / adopters, 6) AS exposed_share FROM r", lambda s, d: adopted(s, d).drop("internal_edges"))
query("adopter_internal_edges", EXPOSED + " SELECT place, adopters, internal_edges FROM r", lambda s, d: adopted(s, d).select("place", "adopters", "internal_edges"))
query("reconcile_counts", "SELECT l_orderkey AS key, max(l_linenumber) AS declared, count(*) AS loaded, max(l_linenumber) = count(*) AS ok FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_orderkey",
  lambda s, d: reconciled(s, d))
PR = G + ", n AS (SELECT DISTINCT node FROM ends), c AS (SELECT count(*) AS n FROM n), o AS (SELECT src, sum(weight) AS out FROM edges GROUP BY src), p AS (SELECT e.src, e.dst, weight / out AS p FROM edges e JOIN o ON o.src = e.src), r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM n, c)"
for i in range(1, 6):
    PR += f", x{i} AS (SELECT dst AS node, sum(r * p) AS x FROM p JOIN r{i - 1} ON r{i - 1}.node = src GROUP BY dst), l{i} AS (SELECT 1 - sum(x) AS l FROM x{i}), r{i} AS (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(x, 0) + l / c.n) AS r FROM n LEFT JOIN x{i} ON x{i}.node = n.node, c, l{i})"
query("pagerank_fixed_iter", PR + " SELECT node, round(r, 8) AS rank FROM r5", lambda s, d: network.pagerank(edges(s, d), 5).select("node", F.round("rank", 8).alias("rank")))
PERC = PAIRS + ", u AS (SELECT min(epoch_us(ts)) AS us, least(source, target) AS a, greatest(source, target) AS b FROM pairs GROUP BY 2, 3), t AS (SELECT us - us % 86400000000 AS bucket_us, a, b FROM u), bk AS (SELECT DISTINCT bucket_us FROM t), n AS (SELECT node, min(bucket_us) AS first FROM (SELECT a AS node, bucket_us FROM t UNION ALL SELECT b, bucket_us FROM t) GROUP BY node)"
query("percolation_by_bucket", PERC + " SELECT bucket_us, (SELECT count(*) FROM t WHERE t.bucket_us <= bk.bucket_us) AS unique_edges, (SELECT count(*) FROM n WHERE first <= bk.bucket_us) AS nodes FROM bk", lambda s, d: percolation(s, d).select("bucket_us", "unique_edges", "nodes"))
RECURSIVE = PERC.replace("WITH ", "WITH RECURSIVE ", 1) + """, bw AS (SELECT bk.bucket_us, a AS x, b AS y FROM bk JOIN t ON t.bucket_us <= bk.bucket_us UNION ALL SELECT bk.bucket_us, b, a FROM bk JOIN t ON t.bucket_us <= bk.bucket_us
), reach AS (SELECT DISTINCT bucket_us, x AS a, x AS b FROM bw UNION SELECT r.bucket_us, r.a, e.y FROM reach r JOIN bw e ON e.bucket_us = r.bucket_us AND e.x = r.b
), root AS (SELECT bucket_us, a, min(b) AS root FROM reach GROUP BY ALL), cs AS (SELECT bucket_us, count(*) AS components, max(k) AS giant FROM (SELECT bucket_us, root, count(*) AS k FROM root GROUP BY ALL) GROUP BY bucket_us
), cv AS (SELECT bk.bucket_us, (SELECT count(*) FROM n WHERE first <= bk.bucket_us) AS nodes, (SELECT count(*) FROM t WHERE t.bucket_us <= bk.bucket_us) AS unique_edges, components, giant FROM bk JOIN cs ON cs.bucket_us = bk.bucket_us
), pc AS (SELECT *, giant / nodes AS giant_share, 2 * unique_edges / nodes AS mean_degree FROM cv)"""
query("percolation_curve", RECURSIVE + " SELECT * FROM pc", lambda s, d: percolation(s, d))
query("percolation_threshold", RECURSIVE + """, e AS (SELECT * FROM pc WHERE nodes >= 20 OR (SELECT max(nodes) FROM pc) < 20), r AS (SELECT *, coalesce(giant_share - lag(giant_share) OVER (ORDER BY bucket_us), 0) AS rise FROM e)
SELECT (SELECT bucket_us FROM r ORDER BY rise DESC, bucket_us LIMIT 1) AS steepest_us, min(bucket_us) FILTER (giant_share >= 0.5) AS half_us, min(bucket_us) FILTER (mean_degree >= 1) AS degree_one_us FROM r""", lambda s, d: structure.percolation_threshold(percolation(s, d)))
query("k_core", None, lambda s, d: network.k_core(graph(s, d), written))
query("betweenness_sampled", None, lambda s, d: replicates.betweenness(graph(s, d), 500, keep=written))
query("communities", None, lambda s, d: leiden.communities(graph(s, d), written))
query("community_sweep", None, lambda s, d: structure.community_sizes(leiden.communities(graph(s, d), written, (0.5, 1.0, 1.5, 2.0))))
query("rewired_null", None, lambda s, d: rewired(s, d))
query("permuted_exposure", None, lambda s, d: permuted(s, d))
query("poisson_null", None, lambda s, d: poisson(s, d))
query("logistic_fit", None, lambda s, d: replicates.fit_logistic(diffusion.adoption_curve(diffusion.first_use(event_log(s, d).where("kind = 'save'"), "place", "actor"), "place", 1), "place"))


def chain(s, d):
    from ..operators.copies import exact_chain

    return exact_chain(table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digest", "doc_id", 1 << 40).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def reconciled(s, d):
    """Each order declares as many lines as its highest line number; the third lines are missing, so some counts are off."""
    lines = table(s, d, "lineitem").where("l_linenumber <> 3")
    declared = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_linenumber").alias("value"))
    return files.reconcile(lines, "l_orderkey", declared)


def percolation(s, d):
    return structure.percolation(pairs(s, d))


def rewired(s, d, n: int = 200):
    g = graph(s, d)
    seen, null = network.transitivity(g).first()["transitivity"], written(replicates.rewired_null(g, n, written), "rewired")
    mixing = network.degree_assortativity(g).first()["assortativity"]
    each = [ranks.compare_to_null(null, k, v).withColumn("statistic", F.lit(k)) for k, v in (("transitivity", seen), ("assortativity", mixing)) if v is not None]
    return each[0] if len(each) == 1 else each[0].unionByName(each[1])


def permuted(s, d, n: int = 5000):
    """Exposure of saves before and after the boundary, against shuffled eras: 24 hourly counts, however long the log."""
    risk = survival.hourly_risk(event_log(s, d))
    saves = event_log(s, d).where("kind = 'save'").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(activity.era_of(BOUNDARY) == "before").alias("first")).join(risk, "hour", "left").orderBy("hour").toPandas()
    value, count, first = saves.risk.fillna(0.0).to_numpy(), saves.n.to_numpy(), saves["first"].to_numpy()
    seen = (value * first).sum() / max(1, first.sum()) - (value * (count - first)).sum() / max(1, (count - first).sum())
    return ranks.compare_to_null(replicates.permuted_difference(value, count, int(first.sum()), s, n), "difference", float(seen), "zero")


def poisson(s, d, n: int = 200):
    gaps = activity.log_gaps(event_log(s, d)).first()
    return ranks.compare_to_null(replicates.poisson_null(s, gaps.n + 1, n), "burstiness", (gaps.s - gaps.mean) / (gaps.s + gaps.mean))
