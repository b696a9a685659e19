"""Queries over texts: hosts, links, tokens, motifs, copies, adoption."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import copies, diffusion, references
from ..sources.shared import written
from ..sources.tables import EVENT_LOG_SQL, event_log, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


HOST = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^$', '')"
PLAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({HOST})), '[.,;:!?]+$', ''), '^[.]+|[.]+$', '', 'g'), '_[0-9]{{3,}}$', ''), '^www\\.', '')"
CLASS = "CASE WHEN regexp_matches(host, '^(localhost|127\\.)') THEN 'local' WHEN regexp_matches(host, '\\.example\\.(com|org|net)$') THEN 'example' WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){3}$') THEN 'address' WHEN regexp_matches(host, '^xn--|\\.xn--') THEN 'punycode' WHEN regexp_matches(host, '[0-9]') THEN 'numbered' ELSE 'other' END"


def hosts(s, d):
    return table(s, d, "pages").select("page_id", "url", T.plain_host(T.raw_host(F.col("url"))).alias("host"))


query("url_hosts", f"SELECT {PLAIN} AS host, count(*) AS n FROM pages GROUP BY 1", lambda s, d: hosts(s, d).groupBy("host").agg(F.count("*").alias("n")))
query("host_class", f"SELECT {CLASS} AS host_class, count(*) AS n_pages, count(DISTINCT host) AS n_hosts FROM (SELECT {PLAIN} AS host FROM pages) GROUP BY 1",
  lambda s, d: hosts(s, d).groupBy(T.host_class(F.col("host"), T.TEST_RULES).alias("host_class")).agg(F.count("*").alias("n_pages"), F.countDistinct("host").alias("n_hosts")))
query("decoded_hosts", f"SELECT DISTINCT lower({HOST}) AS raw, {PLAIN} AS host FROM pages", lambda s, d: decoded(table(s, d, "pages")))
query("query_params", "SELECT p AS parameter, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(url), '[?&]([a-z0-9_]{2,14})=', 1)) AS p FROM pages) WHERE p NOT IN ('ref') GROUP BY 1",
  lambda s, d: table(s, d, "pages").select(F.explode(T.query_parameters(F.col("url"))).alias("parameter")).where(~F.col("parameter").isin("ref")).groupBy("parameter").agg(F.count("*").alias("n")))
query("href_refs", "SELECT page_id, h AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY ALL",
  lambda s, d: refs(s, d).groupBy("page_id", "href").agg(F.count("*").alias("n")))
query("hyperlink_edges", f"""WITH p AS (SELECT page_id, url, {PLAIN} AS host, html FROM pages), r AS (SELECT host AS src, page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM p)
SELECT src, dst, count(*) AS weight, min(page_id) AS first_page, max(page_id) AS last_page, dst IN (SELECT '/' || n_name FROM nation) AS in_corpus FROM r WHERE src <> dst GROUP BY src, dst""", lambda s, d: hyperlinks(s, d))
query("name_motifs", "SELECT motif, count(*) AS n FROM (SELECT unnest(list_filter(['has_number', 'long_number', 'has_dash', 'has_page', 'has_home', 'has_news'], lambda m: CASE m WHEN 'has_number' THEN regexp_matches(url, '[0-9]') WHEN 'long_number' THEN regexp_matches(url, '[0-9]{9,}') WHEN 'has_dash' THEN contains(url, '-') WHEN 'has_page' THEN regexp_matches(lower(url), 'page|item') WHEN 'has_home' THEN regexp_matches(lower(url), 'home|index|main') ELSE regexp_matches(lower(url), 'news|blog|post') END)) AS motif FROM pages) GROUP BY motif",
  lambda s, d: table(s, d, "pages").select(F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in T.motif_flags(F.col("url")).items()]))).alias("motif")).groupBy("motif").agg(F.count("*").alias("n")))
query("motif_diffusion", f"""WITH p AS (SELECT page_id, {PLAIN} AS host, url FROM pages), m AS (SELECT 'has_number' AS motif, page_id, host, url FROM p WHERE regexp_matches(url, '[0-9]') UNION ALL SELECT 'has_page', page_id, host, url FROM p WHERE regexp_matches(lower(url), 'page|item') UNION ALL SELECT 'has_news', page_id, host, url FROM p WHERE regexp_matches(lower(url), 'news|blog|post')
), f AS (SELECT motif, host, min(page_id) AS first, count(*) AS n FROM m GROUP BY ALL)
SELECT motif, count(*) AS n_actors, any_value((SELECT count(DISTINCT url) FROM m x WHERE x.motif = f.motif)) AS n_names, sum(n)::BIGINT AS n_uses, min(first) AS first_use, median(first) AS median_adoption, max(first) AS last_use FROM f GROUP BY motif""", lambda s, d: motif_diffusion(s, d))
TOKENS = "SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS token FROM conversations"
query("summary_tokens", f"SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY token", lambda s, d: uses(s, d).groupBy("token").agg(F.count("*").alias("n")))
query("token_diffusion", f"WITH u AS ({TOKENS}), f AS (SELECT token, conv_id, min(turn) AS a FROM u GROUP BY ALL) SELECT token, count(*) AS n_actors, min(a) AS first_at, max(a) AS last_at, max(a) - min(a) AS span_h, round(count(*) * 24 / greatest((max(a) - min(a))::DOUBLE, 1e-6), 4) AS per_day FROM f GROUP BY token ORDER BY n_actors DESC, token LIMIT 25",
  lambda s, d: diffusion.token_diffusion(uses(s, d)))
query("exact_copy_chain", "WITH g AS (SELECT doc_id AS dst, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS src, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT src, dst, n FROM g WHERE src IS NOT NULL",
  lambda s, d: copies.exact_chain(table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digest", "doc_id", None))
GRAMS = r"""w AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents
), g AS (SELECT doc_id, lang, source, md5(text) AS digest, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w)"""
query("near_copy_pairs", f"""WITH {GRAMS}, b AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS size FROM g
), e AS (SELECT doc_id, lang, source, digest, len(grams) AS n, unnest(grams) AS gram FROM b WHERE size >= 2
), p AS (SELECT x.doc_id AS src, y.doc_id AS dst, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c FROM e x JOIN e y ON x.lang = y.lang AND x.source = y.source AND x.gram = y.gram AND x.doc_id < y.doc_id AND x.digest <> y.digest GROUP BY ALL)
SELECT src, dst, round(c / (m + n - c), 6) AS score FROM p WHERE round(c / (m + n - c), 6) >= 0.5""", lambda s, d: copies.near_copies(table(s, d, "documents"), F.concat_ws("~", "lang", "source"), 0.5, most=None))
CLASSES = f"""WITH {GRAMS}, t AS (SELECT lang, source, digest, min(doc_id) AS rep, any_value(grams) AS grams FROM g GROUP BY ALL), e AS (SELECT lang, source, rep, len(grams) AS n, unnest(grams) AS gram FROM t
), l AS (SELECT x.rep AS src, y.rep AS dst, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS score FROM e x JOIN e y ON x.lang = y.lang AND x.source = y.source AND x.gram = y.gram AND x.rep < y.rep GROUP BY x.rep, y.rep HAVING round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) >= 0.8)"""
near = lambda s, d: copies.near_copy_classes(table(s, d, "documents"), F.concat_ws("~", "lang", "source"), written)
query("near_copy_links", CLASSES + " SELECT src, dst, score FROM l", lambda s, d: near(s, d)[0])
query("near_copy_classes", CLASSES + ", x AS (SELECT rep, count(*) AS n_links FROM (SELECT src AS rep FROM l UNION ALL SELECT dst FROM l) GROUP BY rep) SELECT g.doc_id, t.rep, coalesce(n_links, 0) AS n_links FROM g JOIN t ON t.lang = g.lang AND t.source = g.source AND t.digest = g.digest LEFT JOIN x ON x.rep = t.rep", lambda s, d: near(s, d)[1])
query("ngram_jaccard", f"""WITH {GRAMS}, n AS (SELECT doc_id, grams, lead(doc_id) OVER o AS other, lead(grams) OVER o AS og FROM g WINDOW o AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, other, round(CASE WHEN len(grams) = 0 AND len(og) = 0 THEN 1 ELSE len(list_intersect(grams, og)) / len(list_distinct(list_concat(grams, og))) END, 6) AS jaccard FROM n WHERE other IS NOT NULL""", lambda s, d: neighbours(s, d))
query("sha256_text", "SELECT doc_id, sha256(text) AS digest FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
query("oriented_copies", """WITH t AS (SELECT doc_id, text, 1000 * (doc_id % 7) + doc_id % 3 AS t0, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 900 END AS slack, doc_id % 5 <> 0 AS firm FROM documents
), g AS (SELECT t.*, lag(doc_id) OVER o AS a, lag(t0) OVER o AS t1, lag(slack) OVER o AS slack_a, lag(firm) OVER o AS firm_a FROM t WINDOW o AS (PARTITION BY text ORDER BY doc_id))
SELECT CASE WHEN t1 <= t0 THEN a ELSE doc_id END AS src, CASE WHEN t1 <= t0 THEN doc_id ELSE a END AS dst, abs(t0 - t1)::DOUBLE AS gap_seconds,
  coalesce(abs(t0 - t1) > slack + slack_a, false) AND firm AND firm_a AS orderable FROM g WHERE a IS NOT NULL""", lambda s, d: oriented(s, d))
query("dominant_category", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang AS category, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1",
  lambda s, d: references.dominant_category(table(s, d, "documents"), "source", "lang"))
FIRST = f"WITH {EVENT_LOG_SQL}, f AS (SELECT place, actor, min(epoch_us(ts)) AS first_us FROM ev WHERE kind = 'save' GROUP BY ALL)"
firsts = lambda s, d: diffusion.first_use(event_log(s, d).where("kind = 'save'"), "place", "actor")
query("first_use", FIRST + " SELECT * FROM f", firsts)
CURVE = FIRST + """, h AS (SELECT place, first_us - first_us % 3600000000 AS hour_us, count(*) AS n FROM f GROUP BY ALL), sp AS (SELECT place, min(hour_us) AS a, max(hour_us) AS b FROM h GROUP BY place HAVING sum(n) >= 20
), gr AS (SELECT place, unnest(range(a, b + 1, 3600000000)) AS hour_us FROM sp), cv AS (SELECT g.place, g.hour_us, (sum(coalesce(n, 0)) OVER (PARTITION BY g.place ORDER BY g.hour_us))::BIGINT AS adopters FROM gr g LEFT JOIN h ON h.place = g.place AND h.hour_us = g.hour_us)"""
query("adoption_curve", CURVE + " SELECT * FROM cv", lambda s, d: diffusion.adoption_curve(firsts(s, d), "place"))
query("adoption_half_life", CURVE + ", t AS (SELECT *, max(adopters) OVER (PARTITION BY place) AS top FROM cv) SELECT place, max(top) AS final, ((min(hour_us) FILTER (adopters * 2 >= top) - min(hour_us)) // 3600000000)::BIGINT AS half_hours FROM t GROUP BY place",
  lambda s, d: diffusion.half_life(diffusion.adoption_curve(firsts(s, d), "place"), "place"))


def decoded(pages):
    """Distinct raw hosts, then their decoded and plain forms: the UDF sees each host once."""
    raw = pages.select(F.lower(T.raw_host(F.col("url"))).alias("raw")).distinct()
    return raw.select("raw", T.plain_host(T.unescaped(F.col("raw"), True)).alias("host"))


def refs(s, d):
    return table(s, d, "pages").select("page_id", "url", F.explode(T.hrefs(F.col("html"))).alias("href"))


def hyperlinks(s, d):
    known = table(s, d, "nation").select(F.concat(F.lit("/"), F.col("n_name")).alias("dst"), F.lit(True).alias("known"))
    rows = refs(s, d).select(T.plain_host(T.raw_host(F.col("url"))).alias("src"), F.col("href").alias("dst"), "page_id").where("src <> dst")
    edges = rows.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))
    return edges.join(known, "dst", "left").select("src", "dst", "weight", "first_page", "last_page", F.coalesce("known", F.lit(False)).alias("in_corpus"))


def motif_diffusion(s, d):
    motifs = {k: T.MOTIFS[k] for k in ("has_number", "has_page", "has_news")}
    return references.motif_diffusion(hosts(s, d).select(F.col("host").alias("actor"), F.col("url").alias("name"), F.col("page_id").alias("at")), motifs)


def uses(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("actor"), F.col("turn").alias("at"), F.explode(T.tokens(F.col("text"))).alias("token"))


def neighbours(s, d):
    """Only ids go through the window; the sets join them behind it. Sets are made once, and are hashes of the grams, not the grams, which
    are five times as long as the text."""
    from pyspark.sql import Window as W

    docs = table(s, d, "documents")
    sets = written(docs.select("doc_id", F.transform(T.shingles(F.col("text")), lambda g: F.xxhash64(g)).alias("grams")), "grams")
    pairs = docs.select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("other")).where("other is not null")
    both = pairs.join(sets, "doc_id").join(sets.toDF("other", "og"), "other")
    return both.select("doc_id", "other", F.round(T.jaccard(F.col("grams"), F.col("og")), 6).alias("jaccard"))


def oriented(s, d):
    """Copies with made-up times, uncertainties (some unknown) and grades, so that all cases come up."""
    docs = table(s, d, "documents")
    chain = copies.exact_chain(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digest", "doc_id", 1 << 40)
    at = lambda c: F.timestamp_seconds(1000 * (F.col(c) % 7) + F.col(c) % 3)
    slack = lambda c: F.when(F.col(c) % 11 != 0, F.col(c) % 900).cast("double")
    pairs = chain.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return copies.oriented(pairs.select("a", "b", at("a").alias("time_a"), at("b").alias("time_b"), slack("a").alias("slack_a"), slack("b").alias("slack_b"), (F.col("a") % 5 != 0).alias("firm_a"), (F.col("b") % 5 != 0).alias("firm_b")))
