"""Graph and null operators against brute force on small graphs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import ranks
from skeinwork.functions import text as T
from skeinwork.operators import diffusion, network, paths, populations, references, replicates, spectral, structure, survival
from skeinwork.plans import registry, structure_queries
from skeinwork.sources import files
from skeinwork.sources.shared import written

TRIADS = {
    "003": "", "012": "ab", "102": "ab ba", "021D": "ba bc", "021U": "ab cb", "021C": "ab bc", "111D": "ab ba cb", "111U": "ab ba bc", "030T": "ab cb ac", "030C": "ab bc ca",
    "201": "ab ba bc cb", "120D": "ba bc ac ca", "120U": "ab cb ac ca", "120C": "ab bc ac ca", "210": "ab bc cb ac ca", "300": "ab ba bc cb ac ca",
}


def digraph(seed, n=9, share=0.2):
    rng = np.random.default_rng(seed)
    return {(int(u), int(v)) for u, v in zip(*np.nonzero(rng.random((n, n)) < share), strict=True) if u != v}


def frame(spark, arcs):
    return spark.createDataFrame([(u, v, 1) for u, v in arcs], "src long, dst long, weight long")


def test_strong_components_and_profile(spark):
    arcs = digraph(1, 9, 0.15) | {(20, 21), (21, 20), (30, 31)}
    nodes = {x for a in arcs for x in a}
    reach = {u: {u} for u in nodes}
    for _ in nodes:
        for u, v in arcs:
            for s in reach.values():
                if u in s:
                    s.add(v)
    root = {u: min(v for v in reach[u] if u in reach[v]) for u in nodes}
    assert {r.node: r.root for r in structure.strong_components(frame(spark, arcs), written).collect()} == root
    one = structure.component_profile(frame(spark, arcs), written).first()
    assert (one.nodes, one.strong_components) == (len(nodes), len(set(root.values())))


@pytest.mark.parametrize("seed, share", [(5, 0.3), (6, 0.15), (7, 0.6)])
def test_triads_equal_enumeration(spark, seed, share):
    arcs = digraph(seed, 8, share)
    shapes = {}
    for name, text in TRIADS.items():
        for p in itertools.permutations("abc"):
            shapes[frozenset((p.index(x), p.index(y)) for x, y in text.split())] = name
    count = dict.fromkeys(TRIADS, 0)
    for t in itertools.combinations(sorted({x for a in arcs for x in a}), 3):
        count[shapes[frozenset((t.index(u), t.index(v)) for u, v in arcs if u in t and v in t)]] += 1
    assert {r.triad: r.n for r in structure.triad_census(frame(spark, arcs), written).collect()} == count
    assert len(shapes) == 64


def test_triads_of_a_large_star(spark):
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    got = {r.triad: r.n for r in structure.triad_census(star, written).collect()}
    assert got.pop("021D") == n * (n - 1) // 2 and got.pop("003") == n * (n - 1) * (n - 2) // 6 and not any(got.values())
    assert sum(r.n for r in structure.triad_census(star.limit(0), written).collect()) == 0 and {r.n for r in structure.triad_census(star.limit(1), written).collect()} == {0}


def test_directed_betweenness_equals_paths(spark):
    arcs = digraph(7, 7, 0.3)
    nodes = sorted({x for a in arcs for x in a})
    total = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        walks, found = [[s]], []
        while walks and not found:
            walks = [p + [v] for p in walks for u, v in arcs if u == p[-1] and v not in p]
            found = [p for p in walks if p[-1] == t]
        for p in found:
            for x in p[1:-1]:
                total[x] += 1 / len(found)
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    edges = spark.createDataFrame(sorted(arcs), "a long, b long")
    for got in (replicates.betweenness(edges, directed=True), paths.betweenness(edges, written, directed=True, block=3)):
        assert {r.node: r.betweenness for r in got.collect()} == {k: pytest.approx(v / scale, abs=1e-8) for k, v in total.items()}
    simple = spark.createDataFrame(sorted({tuple(sorted(a)) for a in arcs}), "a long, b long")
    assert {tuple(r) for r in paths.betweenness(simple, written).collect()} == {tuple(r) for r in replicates.betweenness(simple).collect()}
    some = paths.betweenness(edges, written, sources=3).collect()
    assert len(some) == len(nodes) and any(r.betweenness for r in some)


def test_eigenvector_equals_numpy(spark):
    rng, n = np.random.default_rng(3), 8
    m = np.triu(rng.integers(0, 4, (n, n)), 1)
    edges = spark.createDataFrame([(i, j, int(m[i, j])) for i in range(n) for j in range(n) if m[i, j]] + [(50, 51, 9)], "a long, b long, w long")
    want = np.abs(np.linalg.eigh(m + m.T)[1][:, -1])
    assert {r.node: r.eigenvector for r in spectral.eigenvector(edges, written).collect()} == {i: pytest.approx(want[i], abs=1e-5) for i in range(n)}
    star = spark.createDataFrame([(0, i, 2) for i in range(1, 5)], "a long, b long, w long")  # bipartite
    assert {r.node: r.eigenvector for r in spectral.eigenvector(star, written).collect()} == {i: pytest.approx(2**-0.5 if not i else 8**-0.5, abs=1e-6) for i in range(5)}
    assert {r.eigenvector for r in spectral.eigenvector(edges, written, rounds=1, loose=1e-12).collect()} == {None} and spectral.eigenvector(edges.limit(0), written).count() == 0


def test_pagerank_to_a_tolerance(spark):
    arcs = sorted(digraph(4, 9, 0.25) | {(0, 20), (20, 21)})  # 21 is a dead end
    nodes = sorted({x for a in arcs for x in a})
    m = np.array([[((u, v) in arcs) for u in nodes] for v in nodes], float)
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / len(nodes))
    x = np.linalg.solve(np.eye(len(nodes)) - 0.85 * m, np.full(len(nodes), 0.15 / len(nodes)))
    got = {r.node: r["rank"] for r in spectral.pagerank(frame(spark, arcs), written, attempts=((100, 1e-9),)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-7) for k, v in zip(nodes, x, strict=True)}
    loose = spectral.pagerank(frame(spark, arcs), written, attempts=((2, 1e-12), (60, 1e-4)))
    assert sum(r["rank"] for r in loose.collect()) == pytest.approx(1)
    with pytest.raises(RuntimeError):
        spectral.pagerank(frame(spark, arcs), written, attempts=((1, 1e-12), (2, 1e-12)))


def test_swaps_keep_degrees():
    arcs = sorted(digraph(11, 30, 0.1))
    a, b = (np.array(x) for x in zip(*arcs, strict=True))
    x, y = replicates.directed_swaps(a, b, 3)
    assert (np.bincount(x) == np.bincount(a)).all() and (np.bincount(y, minlength=30) == np.bincount(b, minlength=30)).all()
    there = set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(there) == len(arcs) and there != set(arcs) and all(u != v for u, v in there)


def test_nulls_have_the_right_moments(spark):
    value, count = np.array([0.0, 1.0, 3.0]), np.array([40, 30, 30])
    rng = np.random.default_rng(0)
    rows = np.repeat(value, count)
    want = [(lambda p: p[:25].mean() - p[25:].mean())(rng.permutation(rows)) for _ in range(4000)]
    got = replicates.permuted_difference(value, count, 25, spark, 2000).toPandas().difference
    assert abs(got.mean() - np.mean(want)) < 0.03 and abs(got.std() - np.std(want)) < 0.02
    share = replicates.drawn_share(30, 100, 25, spark, 2000).toPandas().difference
    assert abs(share.mean()) < 0.01 and abs(share.std() - np.std([(lambda p: p[:25].mean() - p[25:].mean())(rng.permutation(rows == 1)) for _ in range(4000)])) < 0.01
    bursts = replicates.poisson_null(spark, 500, 300).toPandas().burstiness
    gaps = [np.diff(np.sort(rng.random(500))) for _ in range(300)]
    plain = [(g.std(ddof=1) - g.mean()) / (g.std(ddof=1) + g.mean()) for g in gaps]
    assert abs(bursts.mean() - np.mean(plain)) < 0.01 and abs(bursts.std() - np.std(plain)) < 0.01
    assert replicates.poisson_null(spark, 2_500_000, 1).first()["burstiness"] == pytest.approx(0, abs=0.01)


def test_agreement_of_shuffles(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    both = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x long, y long")

    def plain(x, y):
        """By counting pairs of rows, and by probabilities."""
        same = lambda v: v[:, None] == v[None, :]
        off = np.triu(np.ones((len(x), len(x)), bool), 1)
        a, b, c, n = (same(x) & same(y))[off].sum(), same(x)[off].sum(), same(y)[off].sum(), off.sum()
        p = np.array([[np.mean((x == i) & (y == j)) for j in set(y)] for i in set(x)])
        h = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
        return (a - b * c / n) / ((b + c) / 2 - b * c / n), (h(p.sum(0)) + h(p.sum(1)) - h(p)) / ((h(p.sum(0)) + h(p.sum(1))) / 2)

    one = network.agreement(both, "x", "y").first()
    assert (one.ari, one.nmi) == tuple(pytest.approx(v, abs=1e-6) for v in plain(x, y))
    want = np.array([plain(rng.permutation(x), y) for _ in range(1500)])
    got = replicates.partition_null(both, "x", "y", 1500).toPandas()
    for k, column in enumerate(("ari", "nmi")):
        assert abs(got[column].mean() - want[:, k].mean()) < 0.15 * want[:, k].std() and abs(got[column].std() / want[:, k].std() - 1) < 0.15
    wide = spark.range(300_000).selectExpr("id % 7 as x", "id % 5 as y", "'a' as z")
    assert {r.statistic: r.status for r in replicates.partition_test(wide, "x", "y", 20).collect()} == {"ari": "tested", "nmi": "tested"}
    assert [(r.rows, r.status, r.p_value) for r in replicates.partition_test(both.limit(1), "x", "y", 20).collect()] == [(1, "insufficient_overlap", None)] * 2
    assert replicates.partition_test(both.limit(0), "x", "y", 20).first().rows == 0
    assert replicates.partition_test(wide, "x", "z", 20).count() == 2 and replicates.shuffled_scores(np.array([60]), np.array([60]), rng) == (1.0, 1.0)


def test_exposure_along_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)], "a long, b long")
    firsts = spark.createDataFrame([(i, i * 10) for i in range(12)], "actor long, first_us long")
    seen = diffusion.exposure_test(firsts, edges, 60).first()
    assert (seen.exposed, seen.inside) == (pytest.approx(11 / 12), 11) and seen.rho == pytest.approx(1)
    assert diffusion.exposure_test(firsts, edges, 60).first().verdict == "spread along network ties"
    assert diffusion.exposure_test(firsts.limit(5), edges, 10).first().verdict == "insufficient_adopters"


def test_exposure_of_all_items_equals_a_plain_count(spark):
    rng = np.random.default_rng(8)
    arcs = sorted({tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(70)} | {(50, 51)})
    near = {}
    for u, v in arcs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    uses = [(i, int(u), int(t)) for i in range(6) for u, t in zip(rng.choice(60, 4 + 4 * i, replace=False), rng.integers(0, 9, 4 + 4 * i), strict=True)]
    got = {r.item: r for r in diffusion.exposure_tests(spark.createDataFrame(uses, "item long, actor long, first_us long"), "item", spark.createDataFrame(arcs, "a long, b long"), 50).collect()}
    assert set(got) == set(range(6))
    for i, r in got.items():
        order = [u for _, u in sorted((t, u) for j, u, t in uses if j == i and u in near)]
        assert r.adopters == len(order)
        if len(order) < 10:
            assert (r.exposed, r.rho, r.verdict) == (None, None, "insufficient_adopters")
            continue
        assert r.exposed == pytest.approx(sum(bool(near[u] & set(order[:k])) for k, u in enumerate(order)) / len(order))
        assert r.inside == sum(u in order and v in order for u, v in arcs) and 0 < r.exposed_p <= 1 and 0 < r.inside_p <= 1


def test_percolation_of_a_hand_built_log(spark):
    log = [("a", "b", 1), ("b", "a", 2), ("c", "d", 86_401), ("b", "c", 172_802), ("a", "d", 172_803)]
    pairs = spark.createDataFrame(log, "source string, target string, s long").select("source", "target", F.timestamp_seconds("s").alias("ts"))
    rows = [(r.nodes, r.unique_edges, r.components, r.giant) for r in structure.percolation(pairs).orderBy("bucket_us").collect()]
    assert rows == [(2, 1, 1, 2), (4, 2, 2, 2), (4, 4, 1, 4)]


def test_rank_tests_of_known_values(spark):
    assert ranks.wilcoxon_exact_tail(5, 15) == 1 / 32 and ranks.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-3) and ranks.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)
    w = ranks.p_values(ranks.wilcoxon(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, 5.0, 0.0)], "d double"), "d"), "wilcoxon").first()
    assert (w.n, w.w_plus, w.w_minus, w.zeros, w.p_value) == (5, 15.0, 0.0, 1, pytest.approx(0.0431144, abs=1e-6))  # a zero: no exact form
    signed = lambda d: ranks.p_values(ranks.wilcoxon(spark.createDataFrame([(float(x),) for x in d], "d double"), "d"), "wilcoxon").first()
    assert signed(range(1, 6)).p_value == signed(range(-5, 0)).p_value == 1 / 16
    assert signed([1, *range(-23, -1)]).p_value == pytest.approx(4 / 2**23)  # 22 of 23 are lower: one-sided it was nearly 1
    assert signed([1, 1, -1, 1]).p_value == pytest.approx(0.3173105, abs=1e-6) and signed([]).p_value is None and signed([1, -2, 3, -4]).p_value == pytest.approx(0.875)
    sample = np.random.default_rng(1).normal(0.4, 1, 9)
    w_plus = lambda d: sum(r for r, x in zip(np.argsort(np.argsort(np.abs(d))) + 1, d, strict=True) if x > 0)
    every = [w_plus(np.abs(sample) * f) for f in itertools.product((1, -1), repeat=9)]
    far = np.mean(np.abs(np.array(every) - 22.5) >= abs(w_plus(sample) - 22.5))
    assert signed(sample).p_value == pytest.approx(far)
    rows = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (9.0, False)], "v double, g boolean")
    assert ranks.mann_whitney(rows, "v", "g").first().u == 0.5
    for bad in (rows.where("g"), rows.where("v = 2"), rows.limit(0)):
        assert ranks.mann_whitney(bad, "v", "g").first().z is None
    few = network.power_law_or_lognormal(spark.createDataFrame([(1, 2, 1)], "a long, b long, w long")).first()
    assert (few.n, few.preferred, few.alpha) == (2, "insufficient_data", None)


def test_logistic_curve_is_found_again(spark):
    curve = [("x", h * 3_600_000_000, round(500 / (1 + math.exp(-0.2 * (h - 30))))) for h in range(80)] + [("y", h * 3_600_000_000, 1) for h in range(3)]
    got = {r.item: r for r in replicates.fit_logistic(spark.createDataFrame(curve, "item string, hour_us long, adopters long"), "item").collect()}
    assert (got["x"].top, got["x"].rate, got["x"].mid_hours) == (pytest.approx(500, rel=0.02), pytest.approx(0.2, rel=0.02), pytest.approx(30, rel=0.02)) and got["x"].r2 > 0.999
    assert got["y"].fit == "insufficient_data" and got["y"].top is None


def test_iso_weeks_at_the_ends_of_years(spark):
    days = spark.sql("select explode(array('2024-12-30', '2027-01-01', '2021-01-03', '2020-12-31')) as d").select("d", survival.iso_week(F.col("d").cast("timestamp")).alias("w"))
    assert {r.d: r.w for r in days.collect()} == {"2024-12-30": "2025-01", "2027-01-01": "2026-53", "2021-01-03": "2020-53", "2020-12-31": "2020-53"}


def test_page_references(spark):
    body = "see https://www.wikiservice.at/Dse/wiki.cgi?action=browse&id=Alpha%20One, [[Beta#top|b]] [[http://x.y]] and KnownWord KnownWord UnknownWord [[KnownWord]] http://prowiki.org/x?id=Gamma&amp;id=Delta"
    bodies = spark.createDataFrame([(1, "dse", body), (2, "dse", None)], "id long, wiki string, body string")
    known = spark.createDataFrame([("dse", "KnownWord"), ("other", "UnknownWord")], "wiki string, name string")
    got = {(r.wiki, r.name): r.mechanism for r in references.page_refs(bodies, known).collect()}
    assert got == {("dse", "Alpha"): "cgi_url", ("dse", "Gamma"): "cgi_url", ("dse", "Delta"): "cgi_url", ("dse", "Beta"): "bracket", ("dse", "KnownWord"): "bracket"}
    escaped = spark.createDataFrame([(1, "dse", "https://www.wikiservice%2eat/pro/wiki.cgi?id=PageA and https://wikiservice%252Eat/wiki.cgi?id=PageB")], "id long, wiki string, body string")
    assert {(r.wiki, r.name) for r in references.page_refs(escaped, known).collect()} == {("pro", "PageA"), ("dse", "PageB")}
    hosts = spark.createDataFrame([("http://a.b:80/x",), ("http://me:pw@a.b:c/x",), ("https://a.b",)], "u string").select(T.raw_host(F.col("u")).alias("h"))
    assert {r.h for r in hosts.collect()} == {"a.b"}


def test_host_records(spark):
    raws = ["www.Example.com.", "ex%2561mple&#46;org", "r.jina.ai", "a.blob.core.windows.net", "www.investor.gov_6000", "plain+host_12.net"]
    got = {r.raw: r.h for r in spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", T.host_record(F.col("raw")).alias("h")).collect()}
    assert [(got[x].host, got[x].technique, got[x].obfuscated) for x in raws] == [
        ("example.com", "sink_or_test", False), ("example.org", "sink_or_test", True), ("r.jina.ai", "markdown_proxy", False), ("a.blob.core.windows.net", "azure_blob", False),
        ("investor.gov", "upstream_data", False), ("plain+host_12.net", "other", False),
    ]


def test_populations(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "id long, label string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(populations.agent_rows(rows, "label", ["b"])) == {1} and ids(populations.agent_rows(rows, "label", ["b"], False)) == {1, 2, 3}
    assert ids(populations.agent_rows(rows, "label", spark.createDataFrame([("a",), ("a",)], "x string"))) == {4}
    names = spark.createDataFrame([("w~n~m",), ("w",), ("éa",), ("Zed",)], "k string").select(*populations.split_key(F.col("k")), populations.letter_position(F.col("k")))
    assert [tuple(r) for r in names.collect()] == [("w", "n~m", 22), ("w", None, 22), ("éa", None, None), ("Zed", None, 25)]


def test_verification_stops_before_counting(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    found, counted, kept = files.checksums(spark, [str(tmp_path / "a.txt")]), [], []
    right = found.selectExpr("'a.txt' as name", "sha256")
    wrong = spark.createDataFrame([("a.txt", "0")], "name string, sha256 string")
    report = lambda ok: lambda: (counted.append(ok), spark.createDataFrame([("k", 1, 1 if ok else 2, ok)], "key string, declared long, loaded long, ok boolean"))[1]
    with pytest.raises(files.VerificationError, match="checksums"):
        files.verify(found, wrong, report(True), kept.append)
    assert not counted and not kept
    assert files.verify(found, right, report(True), kept.append).count() == 1
    with pytest.raises(files.VerificationError, match="counts"):
        files.verify(found, right, report(False), kept.append)
    assert len(kept) == 2


def test_tables_are_built_once_and_values_are_plain(spark, tmp_path):
    made = []
    build = lambda: (made.append(1), spark.createDataFrame([(float("nan"), [3.0, float("inf")], None, ["b", "a"])], "x double, y array<double>, z string, s array<string>"))[1]
    for _ in range(2):
        df = files.read_or_build(spark, f"{tmp_path}/cache", build)
    assert len(made) == 1
    files.write_json(df.withColumn("t", F.timestamp_seconds(F.lit(0))), f"{tmp_path}/json")
    assert files.read_metrics(spark, f"{tmp_path}/none") is None
    r = files.read_metrics(spark, f"{tmp_path}/json").first()
    assert (r.x, r.y, r.z, r.t[:19]) == (None, [3.0, None], None, "1970-01-01T00:00:00")
    files.write_graph(df.select("z", "s"), spark.createDataFrame([("u", "v", 2)], "src string, dst string, weight long"), f"{tmp_path}/graph")
    nodes, edges = files.read_graph(spark, f"{tmp_path}/graph")
    assert tuple(nodes.first()) == ("", "a|b") and edges.first().weight == 2.0
    (tmp_path / "r.jsonl").write_text('{"rev_id": "1", "body": "b", "time": "2024-01-01T00:00:00Z"}\n\n')
    assert "body" not in files.revisions(spark, f"{tmp_path}/r.jsonl").columns and files.revisions(spark, f"{tmp_path}/r.jsonl", True).first().body == "b"


def test_ranks_when_ranges_merge_otherwise_for_each_use(spark):
    """Ranges that are made twice have other bounds or other numbers as soon as exchanges of other widths are merged."""
    rows = spark.range(20_000, numPartitions=4).select((F.xxhash64("id") % 20_000).alias("v"), (F.col("id") % 3 == 0).alias("g"))
    seen = rows.toPandas()
    r, g = seen.v.rank().to_numpy(), seen.g.to_numpy()
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = ranks.mann_whitney(rows, "v", "g").first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.u == r[g].sum() - g.sum() * (g.sum() + 1) / 2


def test_betweenness_holds_arrays_only_and_follows_few_links():
    """A hub, a ring and an island against plain counting; links in parts; few links are followed once all but a few are found."""
    rng = np.random.default_rng(3)
    links = sorted({(0, i) for i in range(1, 12)} | {(i, i % 30 + 1) for i in range(1, 31)} | {tuple(sorted(map(int, rng.choice(np.arange(1, 31), 2, replace=False)))) for _ in range(25)} | {(31, 32), (32, 33)})
    a, b = (np.array(x, np.int32) for x in zip(*sorted({(min(e), max(e)) for e in links}), strict=True))
    n = 34
    net = replicates.rows_of(np.concatenate((a, b)), np.concatenate((b, a)), n)
    turned = replicates.rows_of(a, b, n), replicates.rows_of(b, a, n)
    for on, back in ((net, net), turned):
        got, want = np.zeros(n), np.zeros(n)
        near = [on[1][on[0][u] : on[0][u + 1]].tolist() for u in range(n)]
        for s in range(n):
            replicates.add_dependencies(on, back, s, got)
            order, far, ways, part = [s], {s: 0}, {s: 1}, dict.fromkeys(range(n), 0.0)
            for u in order:
                for v in near[u]:
                    if v not in far:
                        far[v], ways[v] = far[u] + 1, 0
                        order.append(v)
                    ways[v] += ways[u] if far[v] == far[u] + 1 else 0
            for u in reversed(order):
                part[u] = sum(ways[u] / ways[v] * (1 + part[v]) for v in near[u] if far[v] == far[u] + 1)
                want[u] += part[u] if u != s else 0
        assert np.allclose(got, want)
    pairs = [(int(u), int(v)) for at in replicates.steps_from(*net, np.arange(n)) for u, v in zip(*at, strict=True)]
    assert len(pairs) == 2 * len(a) and set(pairs) == set(zip(a.tolist(), b.tolist(), strict=True)) | set(zip(b.tolist(), a.tolist(), strict=True))


def test_directed_swaps_hold_no_set_of_all_edges():
    """Degrees stay, no loops or repeated edges, the same reciprocity as by sets; arrays of four bytes an end are enough."""
    rng = np.random.default_rng(4)
    k = np.unique(rng.integers(0, 40, 300) * 40 + rng.integers(0, 40, 300))
    k = k[k // 40 != k % 40]
    a, b = (k // 40).astype(np.int32), (k % 40).astype(np.int32)
    x, y = replicates.directed_swaps(a, b, 7)
    there = set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(there) == len(a) and not (x == y).any() and (y != b).any()
    assert (np.bincount(x, minlength=40) == np.bincount(a, minlength=40)).all() and (np.bincount(y, minlength=40) == np.bincount(b, minlength=40)).all()
    assert replicates.small_reciprocity(x, y) == sum((v, u) in there for u, v in there) / len(there)
    assert replicates.small_reciprocity(a[:0], b[:0]) == 0.0


def test_percolation_reads_its_meetings_batch_by_batch(spark):
    """Meetings come in batches of seven, in order of time: the curve is that of all of them together."""
    rng = np.random.default_rng(6)
    met = [(int(u), int(v), "p", int(t)) for u, v, t in zip(rng.integers(0, 60, 300), rng.integers(60, 120, 300), rng.integers(0, 40 * 86_400, 300), strict=True)]
    frame = spark.createDataFrame(met, "source long, target long, place string, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = structure.Union()
    want = {}
    for u, v, _, t in sorted(met, key=lambda m: m[3]):
        plain.join(u, v)
        want[t // 86_400 * 86_400_000_000] = (plain.parts, plain.giant)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {r.bucket_us: (r.components, r.giant) for r in structure.percolation(frame).collect()}
        plan = structure.forest(structure.first_meetings(frame))._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: want[k] for k in got} and "Sort [us" in plan


def test_exposure_of_networks_of_any_size(spark, monkeypatch):
    """Networks of more edges than replicates hold were refused, and adopters were joined with all their neighbours."""
    monkeypatch.setattr(replicates, "MOST_EDGES", 3)
    monkeypatch.setattr(replicates, "LINKS_AT_ONCE", 5)
    rng = np.random.default_rng(9)
    arcs = [tuple(map(int, rng.choice(30, 2))) for _ in range(90)]
    uses = [(f"p{i}", int(u), int(t)) for i in range(5) for u, t in zip(rng.choice(40, 12 + i, replace=False), rng.integers(0, 9, 12 + i), strict=True)] + [(None, 1, 3), (None, 2, 4)]
    firsts, edges = spark.createDataFrame(uses, "item string, actor long, first_us long"), spark.createDataFrame(arcs, "src long, dst long")
    near = {frozenset(e) for e in arcs if len(set(e)) == 2}
    got = {r.item: (r.adopters, r.exposed, r.internal_edges) for r in diffusion.exposed_share(firsts, edges, "item", 1).collect()}
    for item in {i for i, _, _ in uses}:
        own = {u: t for i, u, t in uses if i == item}
        want = sum(any(frozenset((u, v)) in near and s < t for v, s in own.items()) for u, t in own.items()), sum(e <= own.keys() for e in near)
        assert got[item] == (len(own), *want)
    pairs = edges.where("src <> dst").selectExpr("least(src, dst) AS a", "greatest(src, dst) AS b").distinct()
    tests = {r.item: r for r in diffusion.exposure_tests(firsts, "item", pairs, 20).collect()}
    assert len(got) == len(tests) == 6 and tests[None].verdict == "insufficient_adopters" and all(r.inside <= got[i][2] for i, r in tests.items() if r.inside is not None)


def test_eras_without_core_numbers_make_none(spark, monkeypatch):
    monkeypatch.setattr(network, "k_core", None)  # its rounds took time though the column was dropped
    kept = []
    monkeypatch.setattr(structure_queries, "written", lambda df, name, **options: kept.append(name) or written(df, name, **options))
    rows = {r.era: r for r in registry.QUERIES["structural_break"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"before", "after"} and "max_core" not in rows["after"].asDict() and kept.count("eras") == 1
