"""Page sections, and small operators that no SQL covers."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import handoff, network, payload, structure, survival
from skeinwork.plans import control_queries, event_queries
from skeinwork.sources import files
from skeinwork.sources.shared import written
from skeinwork.sources.tables import BOUNDARY, event_log, table
from skeinwork.streaming import activity as streamed

from .oracle import SF


def test_sections_are_written_and_inlined(spark, tmp_path):
    log = event_log(spark, SF)
    pairs, edges = event_queries.pairs(spark, SF), event_queries.edges(spark, SF)
    after = F.col("ts") >= F.lit(BOUNDARY).cast("timestamp")
    sections = payload.network_sections(log, log.where("kind = 'save' and actor > 2"), pairs, edges, table(spark, SF, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment"), written, 40, 5)
    rows = control_queries.flagged(spark, SF)
    sections |= payload.removal_sections(log, rows, "Brand#3", F.coalesce("wiki", F.lit("none")))
    sections |= payload.hours_sections(log, after, {"before": ~after, "after": after}, F.col("place").cast("int") % 2)
    files.write_payload(sections, str(tmp_path / "p"))
    read = {k: files.read_metrics(spark, str(tmp_path / "p" / k)) for k in sections}
    assert set(read) == {"meta", "timeline", "percolation", "nodes", "links", "adoption", "brokers", "survival_curves", "tactics", "gaps", "epoch", "rewrites", "headline", "day_hour", "periods", "groups"}
    assert read["links"].count() == 40 and read["meta"].first().saves == log.where("kind = 'save'").count() and read["periods"].count() == 2 and read["brokers"].count() <= 25
    few = {k: sections[k] for k in ("meta", "links", "headline")}
    page = files.inlined("<script>x = /*DATA*/;</script>", few, "/*DATA*/")
    held = json.loads(page[len("<script>x = ") : -len(";</script>")])
    assert {k: len(v) for k, v in held.items()} == {"meta": 1, "links": 40, "headline": 1}
    with pytest.raises(ValueError, match="no /"):
        files.inlined("<script></script>", few, "/*DATA*/")
    with pytest.raises(ValueError, match="links"):
        files.inlined("/*DATA*/", few, "/*DATA*/", 39)
    odd = spark.createDataFrame([("</script>", float("nan"))], "a string, b double")
    assert json.loads(files.inlined("T", {"s": odd}, "T")) == {"s": [{"a": "</script>", "b": None}]} and "</" not in files.inlined("T", {"s": odd}, "T")


def test_core_view_takes_the_inner_core_or_the_top(spark):
    clique = [(i, j, 1) for i in range(5) for j in range(i)] + [(9, 0, 1)]
    g = network.undirected(spark.createDataFrame(clique, "src long, dst long, weight long"), "weight")
    cores = network.k_core(g, written)
    assert {r.node for r in structure.inner_core(g, cores).collect()} == set(range(5))
    assert {r.node for r in structure.inner_core(g, cores, 5, 1).collect()} == {0}


def test_budgets_of_layers():
    assert structure.layer_budget(100, False) == (200, 500, 25) and structure.layer_budget(50_000, False) == (25, 500, 25)
    assert structure.layer_budget(100, True) == (10, 300, 10) and structure.layer_budget(100, False, 40, 100) == (40, 100, 10)


def test_projection_and_first_touch(spark):
    members = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("h", 1, 9), ("h", 2, 9), ("h", 3, 9)], "g string, m long, seen long")
    got = {(r.a, r.b): (r.w, r.shared, r.first_seen, r.last_seen) for r in network.newman_projection(members, "g", "m", seen="seen").collect()}
    assert got == {(1, 2): (1.5, 2, 5, 9), (1, 3): (0.5, 1, 9, 9), (2, 3): (0.5, 1, 9, 9)}
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("x", 1, t0, None), ("x", 2, t0 + timedelta(1), "b"), ("x", 0, t0 + timedelta(1), "a"), (None, 3, t0, "z"), ("y", 4, t0, None)], "k string, id long, ts timestamp, v string")
    assert {r.k: r.v for r in network.first_touch(rows, "k", "v").collect()} == {"x": "a", "y": None}


def test_first_sightings_of_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0), (1, t0 + timedelta(hours=1)), (2, t0), (1, t0 + timedelta(hours=2))], "actor long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("actor long, ts timestamp").parquet(str(tmp_path / "in"))
    query = streamed.first_seen(stream, ["actor"]).writeStream.format("memory").queryName("sightings").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.actor for r in spark.table("sightings").collect()) == [1, 2]


def test_rewrites_after_nothing(spark):
    empty = event_log(spark, SF).where("false")
    assert survival.removal_gaps(empty).count() == 0 and payload.meta(empty, empty).first().saves == 0 and handoff.handoff_pairs(empty).count() == 0


def test_projections_by_squares_equal_those_by_joins(spark, monkeypatch):
    """Members of crowded groups were joined with each other once for each group that they share."""
    rows = [(f"g{g}", f"m{(7 * g * g + 5 * m * m + m * g) % 11}", g % 4) for g in range(9) for m in range(8)]
    members = spark.createDataFrame(sorted(set(rows)), "g string, m string, seen long")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    monkeypatch.setattr(network, "CROWDED", 1 << 30)
    want = {seen: plain(network.newman_projection(members, "g", "m", seen=seen)) for seen in ("seen", None)}
    monkeypatch.setattr(network, "CROWDED", 0)
    monkeypatch.setattr(network, "SIDE", 4)
    for seen, pairs in want.items():
        got = plain(network.newman_projection(members, "g", "m", seen=seen))
        assert len(got) == len(pairs) > 20 and all(g[:2] == p[:2] and g[2] == pytest.approx(p[2], abs=1e-6) and g[3:] == p[3:] for g, p in zip(got, pairs, strict=True))
    assert network.newman_projection(members.limit(0), "g", "m", seen="seen").count() == 0


def test_groups_are_dealt_to_as_many_tasks_as_their_pairs_ask_for(spark, monkeypatch):
    monkeypatch.setattr(network, "PAIRS_AT_ONCE", 10)
    rows = [(g, 7 * g + m) for g in range(20) for m in range(6)]
    found = network.newman_projection(spark.createDataFrame(rows, "g long, m long"), "g", "m")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 30), REPARTITION_BY_NUM" in plan  # 20 groups of 15 pairs
    assert found.count() == 20 * 15 and {(r.w, r.shared) for r in found.collect()} == {(0.2, 1)}
