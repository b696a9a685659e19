"""The percolation curve of a stream of meetings: components in keyed state, a row for each bucket of time once the watermark has passed
it. On a bounded input it gives the rows of the batch curve, and it goes on from its checkpoint.

A network is one key, so its meetings pass through one task; networks (layers, sites) are dealt. State is a map of parents and sizes, the
meetings known and those of buckets that are still open: it grows with the network, in the state store, and not with the stream.
The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CURVE = "network string, bucket_us long, nodes long, unique_edges long, components long, giant long, giant_share double, mean_degree double"


class Percolation(StatefulProcessor):
    """Rows: network, a, b (strings, a < b), us. unit_us: of a bucket."""

    def __init__(self, unit_us: int):
        self.unit_us = unit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parents = handle.getMapState("parents", "node string", "parent string, size long")
        self.met = handle.getMapState("met", "a string, b string", "there boolean")
        self.waiting = handle.getMapState("waiting", "bucket_us long, a string, b string", "there boolean")
        self.totals = handle.getValueState("totals", "nodes long, edges long, components long, giant long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        registered = {int(x) for x in self.handle.listTimers()}
        for pdf in rows:
            for us, a, b in zip(pdf["us"].tolist(), pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                if self.met.containsKey((a, b)):
                    continue
                bucket = us - us % self.unit_us
                self.waiting.updateValue((bucket, a, b), (True,))
                if (end := (bucket + self.unit_us) // 1000) not in registered:
                    registered.add(end)
                    self.handle.registerTimer(end)
        yield pd.DataFrame()

    def find(self, node: str) -> tuple[str, int]:
        """A node's root and its size; nodes on the way are linked to it."""
        path, at = [], node
        while (row := self.parents.getValue((at,)))[0] != at:
            path.append(at)
            at = row[0]
        for x in path[:-1]:
            self.parents.updateValue((x,), (at, 0))
        return at, int(row[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        end = int(expiredTimerInfo.getExpiryTimeInMs()) * 1000
        due = sorted((int(k[0]), k[1], k[2]) for k in self.waiting.keys() if int(k[0]) + self.unit_us <= end)
        state = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        nodes, edges, components, giant = (int(x) for x in state)
        out, last = [], None

        def row(bucket):
            return (str(key[0]), bucket, nodes, edges, components, giant, giant / nodes, 2 * edges / nodes)

        for bucket, a, b in due:
            self.waiting.removeKey((bucket, a, b))
            if self.met.containsKey((a, b)):
                continue
            if last is not None and bucket != last:
                out.append(row(last))
            last = bucket
            self.met.updateValue((a, b), (True,))
            edges += 1
            for x in (a, b):
                if not self.parents.containsKey((x,)):
                    self.parents.updateValue((x,), (x, 1))
                    nodes, components, giant = nodes + 1, components + 1, max(giant, 1)
            (p, n), (q, m) = self.find(a), self.find(b)
            if p != q:
                large, small = (p, q) if (n, q) >= (m, p) else (q, p)
                self.parents.updateValue((small,), (large, 0))
                self.parents.updateValue((large,), (large, n + m))
                components, giant = components - 1, max(giant, n + m)
        if last is not None:
            out.append(row(last))
            self.totals.update((nodes, edges, components, giant))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CURVE.split(", ")])

    def close(self) -> None:
        pass


def percolation(pairs: DataFrame, unit_us: int = 86_400_000_000, late: str = "1 hour", network: str | None = None) -> DataFrame:
    """pairs: a stream with source, target, ts (and network, if named). network, bucket_us, nodes, unique_edges, components, giant,
    giant_share, mean_degree, as structure.percolation has them: a row for each bucket that has a first meeting. Meetings that
    come later than `late` behind the newest aren't seen."""
    source, target = F.col("source").cast("string"), F.col("target").cast("string")
    rows = pairs.withWatermark("ts", late).where("source <> target")
    rows = rows.select((F.col(network).cast("string") if network else F.lit("all")).alias("network"), F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), F.unix_micros("ts").alias("us"), "ts")
    return rows.groupBy("network").transformWithStateInPandas(Percolation(unit_us), CURVE, "Append", "EventTime")
