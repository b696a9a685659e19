"""The percolation stream against the batch curve, in one go and from its checkpoint."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import structure
from skeinwork.streaming import percolation

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, percolation.ROCKS)
    yield spark
    spark.conf.set(name, before)


def meetings(seed, n=120, days=6):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b), T0 + timedelta(seconds=int(s))) for a, b, s in zip(rng.integers(0, 40, n), rng.integers(0, 40, n), np.sort(rng.integers(0, days * 86400, n)), strict=True)]


def run(spark, at, rows, part):
    spark.createDataFrame(rows, "source long, target long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("source long, target long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    query = percolation.percolation(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()


def test_stream_equals_batch_and_restarts(rocks, tmp_path):
    rows = meetings(2)
    cut = len(rows) // 2
    run(rocks, tmp_path, rows[:cut], 0)
    first = rocks.read.parquet(f"{tmp_path}/out").count()
    # a meeting far ahead closes all buckets; its own stays open
    run(rocks, tmp_path, rows[cut:] + [(1, 2, T0 + timedelta(days=40))], 1)
    columns = ["bucket_us", "nodes", "unique_edges", "components", "giant", "giant_share", "mean_degree"]
    got = sorted(tuple(r) for r in rocks.read.parquet(f"{tmp_path}/out").select(*columns).collect())
    batch = structure.percolation(rocks.createDataFrame([r for r in rows if r[0] != r[1]], "source long, target long, ts timestamp"))
    assert got == sorted(tuple(r) for r in batch.select(*columns).collect()) and 0 < first < len(got)


def test_networks_are_apart(rocks, tmp_path):
    rows = [("x", 1, 2, T0), ("x", 2, 3, T0), ("y", 1, 2, T0), ("x", 2, 1, T0 + timedelta(days=1)), ("y", 8, 9, T0 + timedelta(days=2)), ("x", 5, 6, T0 + timedelta(days=9))]
    rocks.createDataFrame(rows, "site string, source long, target long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema("site string, source long, target long, ts timestamp").parquet(f"{tmp_path}/in")
    query = percolation.percolation(stream, network="site").writeStream.format("memory").queryName("apart").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.network, r.nodes, r.unique_edges, r.components, r.giant) for r in rocks.table("apart").select("network", F.col("nodes"), "unique_edges", "components", "giant").collect()}
    assert got == {("x", 3, 2, 1, 3), ("y", 2, 1, 1, 2), ("y", 4, 2, 2, 2)}
