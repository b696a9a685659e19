"""Networks in blocks: nodes are numbered in order, and a block holds the links of a range of numbers as arrays, some LINKS of them. What
is known of each node is an array of a few bytes a node that tasks get and send back parts of; links stay in their blocks. So a
round over a network is one pass over its blocks, without an exchange, and no task holds more than a block or two."""

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import prefix_sums
from ..sources.shared import written

#: Links of a block, about (a node's links are never parted); nodes whose numbers a task may hold: networks of more go by joins.
LINKS, MOST_NODES = 1 << 20, 20_000_000
BLOCK = "key int, block int, first long, starts binary, others binary, weights binary"


def numbered(nodes: DataFrame, value: str = "node") -> DataFrame:
    """nodes: distinct. With code: numbers from 0 in order of value."""
    ranked = prefix_sums(nodes.withColumn("_one", F.lit(1).cast("long")), value, "_one")
    return written(ranked.select(*nodes.columns, F.col("below__one").alias("code")), "numbered")


def blocked(links: DataFrame, nodes: int, large: int = 1) -> tuple[DataFrame, int]:
    """links: key, u, v, w: numbers below nodes, of one or several networks by their key. A written table of their blocks of large times LINKS, a
    file each, and how many numbers a block covers."""
    most = links.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    width = max(1, -(-nodes // max(1, -(-most // (LINKS * large)))))

    def packed(table):
        import pyarrow as pa

        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        order = np.argsort(u.astype(np.int64) * nodes + v)
        block = table.column("block")[0].as_py()
        first = block * width
        starts = np.searchsorted(u[order], np.arange(first, min(first + width, nodes) + 1))
        row = [table.column("key")[0].as_py(), block, first, starts.astype(np.int64).tobytes(), v[order].astype(np.int32).tobytes(), table.column("w").to_numpy()[order].astype(np.float64).tobytes()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    rows = links.select(F.col("key").cast("int"), F.col("u").cast("int"), F.col("v").cast("int"), F.col("w").cast("double"), F.expr(f"int(u div {width})").alias("block"))
    return written(rows.groupBy("key", "block").applyInArrow(packed, BLOCK), "blocks", maxRecordsPerFile=1), width


def over(blocks: DataFrame, f: Callable[..., Iterator[tuple]], schema: str, state) -> DataFrame:
    """Rows of f(key, first, starts, others, weights, state) for each block. state: what all tasks get, a few bytes a node."""
    held, kinds = blocks.sparkSession.sparkContext.broadcast(state), [c.split() for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        for batch in batches:
            for i in range(batch.num_rows):
                key, first = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                arrays = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((3, np.int64), (4, np.int32), (5, np.float64))]
                for columns in f(key, first, *arrays, held.value):
                    yield pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(columns, kinds, strict=True)], names=[c for c, _ in kinds])

    return blocks.mapInArrow(run, schema)


def told(blocks: DataFrame, f, schema: str, state) -> list[dict]:
    """The rows of over(), which are few: arrays of a block's nodes as bytes."""
    return over(blocks, f, schema, state).toArrow().to_pylist()


def by_node(spark, schema: str, nodes: int, arrays: list[np.ndarray]) -> DataFrame:
    """code and a column for each array, as long as there are nodes."""
    import pyarrow as pa

    held, names = spark.sparkContext.broadcast(arrays), [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[at]) for x in held.value]], names=names)

    return spark.range(0, nodes, 1, max(1, min(spark.sparkContext.defaultParallelism, nodes // 10_000))).mapInArrow(run, schema)


def coded(links: DataFrame, nodes: DataFrame, **ends: str) -> DataFrame:
    """links with the numbers of the nodes in some columns, under other names: coded(links, nodes, a="u")."""
    for column, name in ends.items():
        links = links.join(nodes.select(F.col("node").alias(column), F.col("code").alias(name)), column)
    return links


def h_indices(cores: np.ndarray, first: int, starts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each node of a block the largest h, up to its number, such that h neighbours have a number of h or more."""
    counts = np.diff(starts)
    own = np.repeat(np.arange(len(counts)), counts)
    top = int(cores.max()) + 1
    keyed = np.sort(own * top + (top - 1 - np.minimum(cores[others], cores[first + own])))
    place = np.arange(len(keyed)) - np.repeat(starts[:-1], counts) + 1
    found, some = np.zeros(len(counts), cores.dtype), counts > 0
    found[some] = np.maximum.reduceat(np.minimum(top - 1 - keyed % top, place), starts[:-1][some])
    return found


def core_numbers(blocks: DataFrame, nodes: int, most: int) -> np.ndarray:
    """The core number of each node. It starts as the degree and falls to the h-index of the neighbours' numbers until nothing changes: in each
    block as long as something does there, then with what the others found. More than most rounds raise an error."""
    cores, rounds = np.zeros(nodes, np.int32), 0
    for row in told(blocks, lambda key, first, starts, *_: [([first], [np.diff(starts).astype(np.int32).tobytes()])], "first long, found binary", None):
        found = np.frombuffer(row["found"], np.int32)
        cores[row["first"] : row["first"] + len(found)] = found

    def fall(key, first, starts, others, _, cores):
        cores, steps, n = cores.copy(), 0, len(starts) - 1
        while steps <= most:
            found, steps = h_indices(cores, first, starts, others), steps + 1
            if (found == cores[first : first + n]).all():
                break
            cores[first : first + n] = found
        yield [first], [steps - 1], [cores[first : first + n].tobytes()]

    while True:
        rows, new = told(blocks, fall, "first long, steps long, found binary", cores), cores.copy()
        for row in rows:
            found = np.frombuffer(row["found"], np.int32)
            new[row["first"] : row["first"] + len(found)] = found
        rounds += max((row["steps"] for row in rows), default=0)
        if rounds > most:
            raise RuntimeError(f"core numbers not settled after {most} rounds")
        if (new == cores).all():
            return cores
        cores = new


#: Pairs of links that are looked at together; bytes that bits of the links of two blocks may take, and how many words of them cost what a pair does.
WEDGES, BIT_BYTES, WORDS = 1 << 20, 32 << 20, 8


def looked_up(nodes: int, first, starts, others, w, far, far_starts, far_others, far_w):
    """x, y, z, xy, xz, yz of the triangles with x in the one block and y in the other, in parts."""
    n = len(far_starts) - 1
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keyed = np.repeat(np.arange(n), np.diff(far_starts)) * nodes + far_others
    at = np.flatnonzero((others >= far) & (others < far + n))
    counts = starts[own[at] + 1] - at - 1
    upto, low = np.cumsum(counts), 0
    while low < len(at) and len(keyed):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + WEDGES, side="right")))
        some = counts[low:high]
        link = np.repeat(at[low:high], some)
        z = others[link + 1 + np.arange(len(link)) - np.repeat(np.cumsum(some) - some, some)].astype(np.int64)
        wanted = (others[link] - far) * np.int64(nodes) + z
        found = np.minimum(np.searchsorted(keyed, wanted), len(keyed) - 1)
        there = np.flatnonzero(keyed[found] == wanted)
        on = (link + 1 + np.arange(len(link)) - np.repeat(np.cumsum(some) - some, some))[there]
        link = link[there]
        yield own[link] + first, others[link].astype(np.int64), z[there], w[link], w[on], far_w[found[there]]
        low = high


def bits_of(starts: np.ndarray, others: np.ndarray, nodes: int) -> np.ndarray:
    """A row of words for each node of a block: a bit for each node that it is linked to."""
    n, words = len(starts) - 1, -(-nodes // 64)
    out, step = np.zeros((n, words), np.uint64), max(1, (1 << 24) // (64 * words))
    for low in range(0, n, step):
        high = min(n, low + step)
        there = np.zeros((high - low, 64 * words), bool)
        there[np.repeat(np.arange(high - low), np.diff(starts[low : high + 1])), others[starts[low] : starts[high]]] = True
        out[low:high] = np.packbits(there, axis=1).view(np.uint64)
    return out


def counted(nodes: int, first, starts, others, w, far, far_starts, far_others, far_w) -> int:
    """How many triangles have x in the one block and y in the other. Where a node's links are many among all nodes, links are compared as bits:
    a link costs a bit for each node then, not a look at each other link of its ends."""
    n, words = len(far_starts) - 1, -(-nodes // 64)
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero((others >= far) & (others < far + n))
    wedges = int((starts[own[at] + 1] - at - 1).sum())
    if wedges * WORDS <= len(at) * words or 8 * words * (len(starts) + n) > BIT_BYTES:
        return sum(len(x) for x, *_ in looked_up(nodes, first, starts, others, w, far, far_starts, far_others, far_w))
    mine, theirs, total, step = bits_of(starts, others, nodes), bits_of(far_starts, far_others, nodes), 0, max(1, (1 << 20) // words)
    for low in range(0, len(at), step):
        some = at[low : low + step]
        total += int(np.bitwise_count(mine[own[some]] & theirs[others[some] - far]).sum(dtype=np.int64))
    return total


def met(table: DataFrame, f: Callable[..., Iterator[list]], schema: str) -> DataFrame:
    """Rows of f(first, starts, others, weights of the one block, and of the other) for each two blocks, the first before the second or the same."""
    columns = ("block", "first", "starts", "others", "weights")
    side = lambda k: table.select(*[F.col(c).alias(f"{k}_{c}") for c in columns])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i]  # noqa: E731, B023
                sides = [x for c in (1, 6) for x in (value(c).as_py(), *[np.frombuffer(value(c + k).as_buffer(), t) for k, t in ((1, np.int64), (2, np.int32), (3, np.float64))])]
                for found in f(*sides):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return side("i").crossJoin(side("j")).where("i_block <= j_block").mapInArrow(run, schema)


def triangles(table: DataFrame, nodes: int) -> DataFrame:
    """table: blocks of links from a smaller number to a larger. x < y < z: the numbers of each triangle once. Each two blocks meet in a row: for links
    from x in the one to y in the other, the links from x beyond y are looked up among those of y. Only triangles leave a task, not
    the pairs of links. xy, xz, yz: the weights of the links."""
    return met(table, lambda *sides: looked_up(nodes, *sides), "x long, y long, z long, xy double, xz double, yz double")


def triangle_counts(table: DataFrame, nodes: int) -> DataFrame:
    """n: how many triangles each two blocks make; none leaves a task."""
    return met(table, lambda *sides: [[[counted(nodes, *sides)]]], "n long")
