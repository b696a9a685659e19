"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

Each shard stands on the ring with many points; a key belongs to the first point at or after its hash. A shard's bound
is its even part of all rows (counts at most one apart). Keys come in the order of the ring; those that find their shard full
go on clockwise to the free places of shards with room, which are shared out among these shards' points in proportion to
their arcs. All bounds together are the number of rows, so each place is taken, and only what full shards can't hold moves:
no other assignment with these bounds moves fewer keys away from their shards.

How many rows each arc has is counted first; from these counts (one row for each point, however many documents there
are) windows compute who moves where, and the rows look it up. The one shuffle of rows carries no text.

Law: rows. Keys are doc_id; a null doc_id is the key ''. A null text has size 8 and CRC-32 0. Rows of one doc_id stand
side by side on the ring, ordered by CRC-32 and size; equal rows are interchangeable. Columns besides doc_id and text may have
any names; an empty table gives no rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SHARDS, POINTS = 24, 64
RING_BITS, CELL_BITS = 32, 12


def ring_hash(key: Column) -> Column:
    """A place on the ring: the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")


def ring_points(spark, shards: int, points: int) -> DataFrame:
    """arc, shard, at, size: the points in ring order, and the length of the arc that ends at each."""
    order = W.orderBy("at", "shard", "point")
    placed = spark.range(0, shards * points, 1, 1).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("point"))
    placed = placed.withColumn("at", ring_hash(F.concat_ws(" ", F.lit("shard"), F.col("shard").cast("string"), F.lit("point"), F.col("point").cast("string"))))
    last = F.max("at").over(W.partitionBy()) - F.lit(1 << RING_BITS)
    return placed.select((F.row_number().over(order) - 1).alias("arc"), "shard", "at", (F.col("at") - F.coalesce(F.lag("at").over(order), last)).alias("size"))


def cells(spark, points: DataFrame, n: int) -> DataFrame:
    """For each cell of the ring (its first bits): the points in it, and the first one after it."""
    inside = points.groupBy(F.shiftright("at", RING_BITS - CELL_BITS).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("at", "arc"))).alias("inside"))
    every = spark.range(0, 1 << CELL_BITS, 1, 1).select(F.col("id").alias("cell")).join(inside, "cell", "left")
    held = F.when(F.col("inside").isNull(), 0).otherwise(F.size("inside"))
    before = F.sum(held).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    return every.select("cell", "inside", F.pmod(before, F.lit(n)).cast("int").alias("after"))


def places(points: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """arc, shard, kept (how many of the arc's rows find room in it), base (their first slot),
    beyond (how many moved on before the arc's), moves (where those that it moves on go: from, until, shard, base)."""
    everything = points.join(counts, "arc", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole, own = W.partitionBy(), W.partitionBy("shard")
    rows, along_own = F.sum("n").over(whole), own.orderBy("arc")
    goal = F.floor(rows / shards) + F.when(F.col("shard") < rows % shards, 1).otherwise(0)
    arcs = everything.withColumns({"goal": goal, "load": F.sum("n").over(own), "to": F.sum("size").over(along_own), "ring": F.sum("size").over(own), "base": F.sum("n").over(along_own) - F.col("n")})
    arcs = arcs.withColumn("kept", F.least(F.col("n"), F.greatest(F.col("goal") - F.col("base"), F.lit(0))))
    # whole-number division throughout: what is free adds up
    arcs = arcs.withColumns({"over": F.col("n") - F.col("kept"), "free": F.expr("(greatest(goal - load, 0) * to) div ring - (greatest(goal - load, 0) * (to - size)) div ring")})
    arcs = arcs.withColumns({"taken": F.col("load") + F.sum("free").over(along_own) - F.col("free"), "level": F.sum(F.col("over") - F.col("free")).over(W.orderBy("arc"))})
    # start behind the arc after which the fewest rows are on their way: there are none
    start = F.min(F.struct("level", "arc")).over(whole)["arc"]
    arcs = arcs.withColumn("turn", F.pmod(F.col("arc") - start - 1, F.count("*").over(whole)))
    turn = W.orderBy("turn")
    arcs = arcs.withColumns({"beyond": F.sum("over").over(turn) - F.col("over"), "open": F.sum("free").over(turn) - F.col("free")})
    # the q-th row that moves takes the q-th free place: cut both sequences where either changes
    source = arcs.where("over > 0").select(F.col("beyond").alias("at"), F.col("arc").alias("source"), F.lit(None).cast("struct<shard:bigint,base:bigint>").alias("goal"))
    goals = arcs.where("free > 0").select(F.col("open").alias("at"), F.lit(None).cast("int").alias("source"), F.struct("shard", (F.col("taken") - F.col("open")).alias("base")).alias("goal"))
    cuts = source.unionByName(goals)
    along = W.orderBy("at")
    until = F.coalesce(F.lead("at").over(along), F.lit((1 << 62)))
    seen = along.rowsBetween(W.unboundedPreceding, 0)
    parts = cuts.select("at", until.alias("until"), F.last("source", True).over(seen).alias("arc"), F.last("goal", True).over(seen).alias("goal")).where("until > at and goal is not null and arc is not null")
    moves = parts.groupBy("arc").agg(F.collect_list(F.struct("at", "until", "goal")).alias("moves"))
    return arcs.join(moves, "arc", "left").select("arc", "shard", "kept", "base", "beyond", "moves")


def shard_documents(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), home_shard
    (whose point is next on the ring: what differs from it has moved)."""
    spark = docs.sparkSession
    ring = ring_points(spark, shards, points)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), ring_hash(key).alias("at"))
    found = rows.withColumn("cell", F.shiftright("at", RING_BITS - CELL_BITS)).join(F.broadcast(cells(spark, ring, shards * points)), "cell")  # a broadcast of 4096 rows
    found = found.withColumn("arc", F.coalesce(F.get(F.filter("inside", lambda p: p["at"] >= F.col("at")), F.lit(0))["arc"], F.col("after")))
    counts = found.groupBy("arc").agg(F.count("*").alias("n"))
    plan = F.broadcast(places(ring, counts, shards))  # a broadcast of one row for each point
    ranked = found.select("doc_id", "size", "text_crc32", "arc", (F.row_number().over(W.partitionBy("arc").orderBy("at", "doc_id", "text_crc32", "size")) - 1).alias("rank"))
    to = ranked.join(plan, "arc").withColumn("q", F.col("beyond") + F.col("rank") - F.col("kept"))
    move = F.get(F.filter("moves", lambda m: (m["at"] <= F.col("q")) & (F.col("q") < m["until"])), F.lit(0))["goal"]
    to = to.withColumn("move", F.when(F.col("rank") >= F.col("kept"), move))
    return to.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.coalesce(F.col("move.shard"), F.col("shard")).cast("int").alias("shard"),
        F.coalesce(F.col("move.base") + F.col("q"), F.col("base") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("shard").cast("int").alias("home_shard"),
    )


ORACLE_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), hexed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, size, pos, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS text_crc32
  FROM hexed, crc_table
), placed AS (
  SELECT id % {SHARDS} AS shard, id // {SHARDS} AS point, ('0x' || substr(md5('shard ' || (id % {SHARDS}) || ' point ' || (id // {SHARDS})), 1, 8))::BIGINT AS pos
  FROM (SELECT unnest(range({SHARDS * POINTS})) AS id)
), ring AS (
  SELECT row_number() OVER o - 1 AS arc, shard, pos, pos - coalesce(lag(pos) OVER o, max(pos) OVER () - 4294967296) AS size
  FROM placed WINDOW o AS (ORDER BY pos, shard, point)
), ends AS (
  SELECT pos, min(arc) AS arc FROM ring GROUP BY pos
), found AS (
  SELECT k.doc_id, k.size, k.text_crc32, k.pos, coalesce(e.arc, 0) AS arc FROM keyed k ASOF LEFT JOIN ends e ON k.pos <= e.pos
), counted AS (
  SELECT r.*, coalesce(c.n, 0) AS n FROM ring r LEFT JOIN (SELECT arc, count(*) AS n FROM found GROUP BY arc) c ON c.arc = r.arc
), goals AS (
  SELECT *, (sum(n) OVER ()) // {SHARDS} + CASE WHEN shard < (sum(n) OVER ()) % {SHARDS} THEN 1 ELSE 0 END AS goal, sum(n) OVER (PARTITION BY shard) AS load,
    sum(size) OVER (PARTITION BY shard ORDER BY arc) AS upto, sum(size) OVER (PARTITION BY shard) AS whole, sum(n) OVER (PARTITION BY shard ORDER BY arc) - n AS base
  FROM counted
), room AS (
  SELECT *, least(n, greatest(goal - base, 0)) AS kept, (greatest(goal - load, 0) * upto) // whole - (greatest(goal - load, 0) * (upto - size)) // whole AS free_ FROM goals
), levels AS (
  SELECT *, n - kept AS over_, load + sum(free_) OVER (PARTITION BY shard ORDER BY arc) - free_ AS taken, sum(n - kept - free_) OVER (ORDER BY arc) AS level FROM room
), turned AS (
  SELECT *, (arc - first_value(arc) OVER (ORDER BY level, arc) - 1 + {SHARDS * POINTS}) % {SHARDS * POINTS} AS turn FROM levels
), arcs AS (
  SELECT *, sum(over_) OVER (ORDER BY turn) - over_ AS beyond, sum(free_) OVER (ORDER BY turn) - free_ AS open_ FROM turned
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank FROM found
), walked AS (
  SELECT r.doc_id, r.size, r.text_crc32, r.rank, a.shard, a.base, CASE WHEN r.rank >= a.kept THEN a.beyond + r.rank - a.kept END AS q
  FROM ranked r JOIN arcs a ON a.arc = r.arc
), opens AS (
  SELECT open_ AS pos, shard, taken - open_ AS base FROM arcs WHERE free_ > 0
)
SELECT w.doc_id, w.size::BIGINT AS size, w.text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (CASE WHEN w.q IS NULL THEN w.shard ELSE o.shard END)::INTEGER AS shard,
  (CASE WHEN w.q IS NULL THEN w.base + w.rank ELSE o.base + w.q END)::BIGINT AS slot, NULL::INTEGER AS grown_shard, w.shard::INTEGER AS home_shard
FROM walked w ASOF LEFT JOIN opens o ON w.q >= o.pos
"""
