import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import activity
from skeinwork.sources import files
from skeinwork.streaming import activity as streamed


def test_jsonl_and_manifest(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text('{"event_type": "delete", "time": "2026-06-19T10:00:00Z", "page_key": "w~a"}\n\n{"event_type": "probe"}\n')
    rows = files.jsonl(spark, str(tmp_path / "events.jsonl"), files.EVENTS)
    assert [(r.event_type, r.page_key) for r in rows.orderBy("event_type").collect()] == [("delete", "w~a"), ("probe", None)]
    declared = spark.createDataFrame([("delete", 1), ("probe", 2)], "key string, value long")
    assert {r.key: r.ok for r in files.reconcile(rows, "event_type", declared).collect()} == {"delete": True, "probe": False}
    (tmp_path / "m.json").write_text(json.dumps({"checks": [{"name": "a", "ok": True}, {"name": "b", "ok": False}]}, indent=1))
    assert [r.name for r in files.failed_checks(files.manifest(spark, str(tmp_path / "m.json"))).collect()] == ["b"]
    data = (tmp_path / "events.jsonl").read_bytes()
    sums = spark.createDataFrame([("events.jsonl", hashlib.sha256(data).hexdigest()), ("gone", "x")], "name string, sha256 string")
    assert {r.name: r.ok for r in files.verify_checksums(files.checksums(spark, [str(tmp_path / "events.jsonl")]), sums).collect()} == {"events.jsonl": True, "gone": False}


def test_broken_lines_are_told(spark, tmp_path):
    lines = ['{"event_type": "delete", "page_key": "w~a"}', "", "   ", '{"event_type": "pro', '{"event_type": "probe", "time": "no time"}', "[1]", "{}"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "x.jsonl")
    with pytest.raises(Exception, match='"event_type": "pro'):
        files.jsonl(spark, path, files.EVENTS).count()
    rows = files.jsonl(spark, path, files.EVENTS, broken="leave")
    assert sorted((r.event_type or "", r.time) for r in rows.collect()) == [("", None), ("delete", None), ("probe", None)]
    assert {r.line for r in files.broken_lines(spark, path, files.EVENTS).collect()} == {lines[3], "[1]"}
    (tmp_path / "good.jsonl").write_text('{"uncertainty_seconds": NaN, "rev_id": "a"}\n')
    assert [(r.rev_id, r.uncertainty_seconds) for r in files.revisions(spark, str(tmp_path / "good.jsonl")).collect()] == [("a", None)]


def test_conservation_in_one_pass(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    events = spark.createDataFrame([(t0 + timedelta(days=d), k) for d, k in ((0, "save"), (0, "save"), (3, "delete"), (5, "probe"))], "ts timestamp, kind string")
    totals = activity.conserved_series(events, "day", lambda df: df.write.parquet(str(tmp_path / "s")))
    assert totals == {"saves": 2, "deletes": 1, "probes": 1}
    assert [(r.saves, r.deletes, r.probes) for r in spark.read.parquet(str(tmp_path / "s")).orderBy("bucket_us").collect()] == [(2, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)]
    check = activity.Conservation()
    check.made(check.raw(events).groupBy("ts").agg(F.count_if(F.col("kind") == "save").alias("saves"), F.lit(0).alias("deletes"), F.count_if(F.col("kind") == "probe").alias("probes"))).collect()
    with pytest.raises(ValueError, match="0 of 1 deletes"):
        check.hold()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["b", "a"])], "a long, b double, c array<string>")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().c == "a|b"
    assert spark.read.json(str(tmp_path / "j")).first().b is None
    files.write_json(spark.sql("select map('k', double('NaN'), 'l', 1d) as m"), str(tmp_path / "m"))
    assert spark.read.schema("m map<string,double>").json(str(tmp_path / "m")).first().m == {"k": None, "l": 1.0}


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=s), i % 2, "x", "save") for i, s in enumerate([0, 100, 7300, 7400, 20000, 30000])] + [(99, t0 + timedelta(days=30), 7, "x", "probe")]
    events = spark.createDataFrame(rows, "id long, ts timestamp, actor long, place string, kind string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, out in (("counts", streamed.windowed_counts(stream)), ("sess", streamed.sessions(stream, "actor", 7200))):
        query = out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    batch = activity.session_table(events, "actor", 7200).where("actor < 7")
    assert {tuple(r) for r in spark.table("sess").where("actor < 7").select("actor", "n", "first_us", "last_us").collect()} == {tuple(r) for r in batch.select("actor", "n", "first_us", "last_us").collect()}
    assert spark.table("counts").agg(F.sum("saves")).first()[0] == 6
