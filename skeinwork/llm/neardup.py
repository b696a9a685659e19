"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits of each other have a middle that lies within 2 bits of both. In its plain form each
fingerprint emits all 2081 variants within that radius and equal variants meet. Here the fingerprint is first cut
into three blocks: of 4 differing bits at least two lie in one block, so without that block at most two are left, and
variants within 1 bit of the other two blocks meet. That makes 131 rows of each distinct fingerprint.

Where few meet, the pairs among them are verified. Where more than CROWD meet, pairs would grow with the square, so all of
them emit the plain form's variants among themselves: whoever meets there is surely within 4 bits, and links to the
smallest are enough. No pair is lost either way, and nothing is capped.

Near copies with a few changed words often lie further apart than that. So near_duplicates also links texts whose sets of five
words have a Jaccard similarity of at least 0.8 (op3's query leaves that out: its contract is the 4 bits). Candidates
come from the prefixes of these sets: under one order of all shingles, two sets so similar share one of their first fifth.
The order puts shingles that are common in a sample last; any order is complete. Candidates are verified on their whole
sets. At each meeting place all are compared with the first, and only those that this leaves apart with each other.

Null, empty and wordless texts have fingerprint zero, linked like any other. Equal texts are one fingerprint from the
start, however many. Rows without a doc_id get a component like others, but name none. Rows of a repeated doc_id each have a
row in the result. Columns besides doc_id and text may have any names; an empty table gives no rows."""

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import components
from .common import added, in_arrow, map_texts, row_hash, slices, split_words, swept, written
from .substrings import Names

SHINGLE, BITS, RADIUS, BLOCKS = 4, 64, 4, 3
#: Where more meet than this, the plain form takes over: it is cheaper there.
CROWD = 32
#: Words of a shingle whose sets are compared, and the least Jaccard similarity of near copies, as a fraction.
WORDS, PART, WHOLE = 5, 4, 5
#: Distinct texts to learn common shingles from, about, and in how many of them a shingle is common.
SAMPLE_TEXTS, COMMON = 20_000, 5
#: Words of 64 bits in a mark.
MARK_WORDS = 8
#: Rows of two numbers at most that are broadcast, some tens of MB.
BROADCAST = 1_000_000


def simhash(text: bytes | None) -> int:
    """Majority of the bits of the XXH64 of all shingles, as a signed number."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    hashed = np.fromiter((xxhash.xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts[:n], last, strict=True)), np.uint64, n)
    count = np.unpackbits(hashed.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.int64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(blocks: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(bits to keep, bits to flip, lowest dropped bit, number of dropped bits) of each variant: one block is dropped (none if there is only one), and up to half of the
    differences that are left are flipped. A constant of the dropped block tells apart what different blocks leave."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for k in range(blocks):
        dropped = set(range(edges[k], edges[k + 1])) if blocks > 1 else set()
        kept = [i for i in range(BITS) if i not in dropped]
        left = radius - -(-radius // blocks) if blocks > 1 else radius
        salt = (0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64) if blocks > 1 else 0
        for n in range(-(-left // 2) + 1):
            for chosen in itertools.combinations(kept, n):
                out.append((signed(sum(1 << i for i in kept)), signed(sum(1 << i for i in chosen) ^ salt), edges[k], len(dropped)))
    return out


def emitted(prints: DataFrame, blocks: int, radius: int) -> DataFrame:
    """key, note: each fingerprint with all its variants. The note, a short number, is the variant and the dropped bits: with
    the key it gives the fingerprint back, which so needn't be sent along."""
    masks = variants(blocks, radius)
    each = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("code"))
    of = lambda k: one_of(masks, k, F.col("code"))
    each = each.withColumns({"keep": of(0), "flip": of(1), "low": of(2).cast("int"), "ones": F.lit((1 << max(m[3] for m in masks)) - 1)})
    dropped = F.expr(f"(shiftrightunsigned(fp & ~keep, low) & cast(ones as bigint)) * {1 << len(masks).bit_length()}")
    return each.select(F.col("fp").bitwiseAND(F.col("keep")).bitwiseXOR(F.col("flip")).alias("key"), (dropped + F.col("code")).cast("int").alias("note"))


def one_of(masks: list[tuple], k: int, code):
    """The k-th number of the variant with that code, from one literal array (written as SQL: it is parsed at once)."""
    numbers = ",".join(f"cast('{m[k]}' as bigint)" if m[k] == -(1 << 63) else f"{m[k]}L" for m in masks)
    return F.element_at(F.expr(f"array({numbers})"), (code + 1).cast("int"))


def given_back(met: DataFrame, blocks: int, radius: int) -> DataFrame:
    """met with the column fp in place of the note."""
    masks, wide = variants(blocks, radius), len(variants(blocks, radius)).bit_length()
    of = lambda k: one_of(masks, k, F.col("note") % (1 << wide))
    met = met.withColumns({"keep": of(0), "flip": of(1), "low": of(2).cast("int")})
    dropped = F.expr(f"shiftleft(cast(note div {1 << wide} as bigint), low)")
    return met.withColumn("fp", F.col("key").bitwiseXOR(F.col("flip")).bitwiseAND(F.col("keep")).bitwiseOR(dropped)).drop("note", "keep", "flip", "low")


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect just what differing in at most radius bits connects."""
    met = emitted(prints, blocks, radius).withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1")
    met = swept(written(given_back(met, blocks, radius), "met"))
    few = met.where(F.col("n") <= CROWD).groupBy("key").agg(F.collect_set("fp").alias("fps"))
    pairs = few.select(F.explode("fps").alias("a"), "fps")
    close = lambda b: (b > F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= radius)
    pairs = pairs.select("a", F.explode(F.filter("fps", close)).alias("b"))
    crowd = given_back(emitted(met.where(F.col("n") > CROWD).select("fp").distinct(), 1, radius), 1, radius)
    stars = crowd.select(F.min("fp").over(W.partitionBy("key")).alias("a"), F.col("fp").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of the whole text if it is shorter, none of a text without words."""
    import pyarrow.compute as pc

    _, counts, known = split_words(pc.ascii_lower(texts))
    names, out = Names(np.ascontiguousarray(known[:, 0]), 0), []
    start = np.arange(counts.sum())
    found = names(start, np.minimum(start + WORDS, len(start))).view(np.int64)
    for at, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
        out.append(np.unique(found[at : at + n - WORDS + 1]) if n >= WORDS else names(np.array([at] * (n > 0), np.int64), np.array([at + n] * (n > 0), np.int64)).view(np.int64))
    return out


def text_key(text: bytes | None) -> int:
    """What xxhash64 gives for a text, a signed number."""
    import xxhash

    return signed(xxhash.xxh64_intdigest(text, 42)) if text is not None else 42


def map_sets(texts: DataFrame, schema: str, columns) -> DataFrame:
    """texts: sid, text. columns(sids, sets) gives the columns of schema."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns(part.column(0).to_numpy(), sets)], names=names)

    return in_arrow(texts, run, schema)


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and numbers of the shingles that are common in a sample of texts."""
    share = int((1 << 20) * min(1.0, SAMPLE_TEXTS / max(1, texts.count())))
    sample = texts.where(F.pmod("sid", F.lit(1 << 20)) < share).dropDuplicates(["sid"])
    seen = map_sets(sample, "key long", lambda sids, sets: [np.concatenate([np.empty(0, np.int64), *sets])])
    found = seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy("key").toArrow()
    return found.column("key").to_numpy(), found.column("n").to_numpy()


def prefixes(texts: DataFrame) -> DataFrame:
    """key, sid, n, at: the shingles of each text's prefix, the size of its set and the place in it."""
    held = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def columns(sids, sets):
        common, seen = held.value
        keys, lengths = [np.empty(0, np.int64)], []
        for own in sets:
            size = len(own) - -(-len(own) * PART // WHOLE) + 1 if len(own) else 0
            if len(common) and size:
                i = np.minimum(np.searchsorted(common, own), len(common) - 1)
                own = own[np.argsort(np.where(common[i] == own, seen[i], 0), kind="stable")]
            keys.append(own[:size])
            lengths.append(size)
        lengths = np.array(lengths, np.int64)
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.concatenate(keys), np.repeat(sids, lengths), np.repeat(np.array([len(x) for x in sets], np.int32), lengths), at.astype(np.int32)

    return map_sets(texts, "key long, sid long, n int, at int", columns)


def sized(df: DataFrame) -> DataFrame:
    """df (a written table of few narrow columns), for broadcasting if it has at most BROADCAST rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def parity(own: np.ndarray) -> bytes:
    """The size of a set, in eight bytes, and a mark of at least as many bits (a power of two): those that an odd number of its
    shingles hashes to."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return len(own).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes) -> bool:
    """Whether two sets with these parities can be similar enough. Their marks, the longer one folded to the other's length, differ
    in at most as many bits as there are shingles that only one has: at most a ninth of their sizes' sum."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    size, x, y = int(x[0]) + int(y[0]), x[1:], y[1:]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (PART + WHOLE) <= (WHOLE - PART) * size


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sets, as sorted numbers, are similar enough."""
    x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
    c = len(np.intersect1d(x, y, assume_unique=True))
    return c * WHOLE >= PART * (len(x) + len(y) - c)


def passing(pairs: DataFrame, texts: DataFrame, note, test) -> DataFrame:
    """Those pairs (a, b, ra, rb) for which test says yes of the notes (bytes made of a set) of both."""
    names = pairs.columns
    notes = map_sets(texts, "sid long, note binary", lambda sids, sets: [sids, [note(x) for x in sets]])
    notes = notes.repartition("sid").dropDuplicates(["sid"])
    both = pairs.join(notes.toDF("a", "ga"), "a").join(notes.toDF("b", "gb"), "b").select(*names, "ga", "gb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both, run, pairs.schema)


def both_ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "candidates")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the roots of those pairs (a, b, ra, rb; a and b are texts' sids) whose sets are similar enough. Whole sets are sent
    for the pairs only that their parities, a 64th as long or twice that, leave: at meeting places most others aren't alike."""
    # one row of each text: the least of its row keys (equal rows have equal ones)
    least = texts.join(sized(both_ends(pairs)), "sid", "left_semi").groupBy("sid").agg(F.min("row").alias("row"))
    least = swept(written(least, "rows"))
    of = lambda rows: texts.join(sized(rows), ["sid", "row"], "left_semi").select("sid", "text")
    left = swept(written(passing(pairs, of(least), parity, may_be_similar), "left"))
    chosen = written(least.join(both_ends(left), "sid", "left_semi"), "rows")
    return passing(left, of(chosen), np.ndarray.tobytes, similar).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def marks(texts: DataFrame) -> DataFrame:
    """sid, p0 to p7: for each text, of 512 bits those that an odd number of its shingles hashes to. Two sets' marks differ in at
    most as many bits as there are shingles that only one of them has."""

    def columns(sids, sets):
        bits = np.zeros((len(sets), 64 * MARK_WORDS), np.uint8)
        for row, own in zip(bits, sets, strict=True):
            row[:] = np.bincount((own.view(np.uint64) >> np.uint64(32)).astype(np.int64) % len(row), minlength=len(row)) & 1
        words = np.packbits(bits, axis=1).view(np.int64).reshape(len(sets), MARK_WORDS)
        return [sids, *[np.ascontiguousarray(words[:, i]) for i in range(MARK_WORDS)]]

    found = map_sets(texts, "sid long, " + ", ".join(f"p{i} long" for i in range(MARK_WORDS)), columns)
    return found.dropDuplicates(["sid"])


def similar_roots(docs: DataFrame, rows: DataFrame, linked: DataFrame) -> DataFrame:
    """id, root: which roots of linked (fp, root) are one component by similar texts."""
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("sid"), text.alias("text"), row_hash(docs).alias("row"))
    met = prefixes(texts.select("sid", "text")).repartition("key").distinct()
    met = met.withColumns({"m": F.count("*").over(W.partitionBy("key")), "place": F.row_number().over(W.partitionBy("key").orderBy("sid"))}).where("m > 1").drop("m")
    roots = rows.select("sid", "fp").distinct().join(linked, "fp").select("sid", "root")
    met = swept(written(met.join(roots, "sid"), "near"))

    def pairs(rows: DataFrame, first: str, further: str = "true", more: tuple[str, ...] = ()) -> DataFrame:
        a = rows.where(first).select("key", *[F.col(c).alias(f"{c}_a") for c in ("sid", "n", "at", "root", *more)])
        both = a.join(rows, "key").where("sid_a < sid and root_a <> root").where(further)
        # as many as they may share from here on, and at least must
        both = both.where(f"least(n_a - at_a, n - at) * {PART + WHOLE} >= {PART} * (n_a + n)")
        return both.select(F.col("sid_a").alias("a"), F.col("sid").alias("b"), F.col("root_a").alias("ra"), F.col("root").alias("rb")).distinct()

    # all are compared with the first of each meeting place; then those that are not yet one with each other
    near = swept(written(verified(swept(written(pairs(met, "place = 1"), "pairs")), texts), "similar"))
    found = written(components(near, written), "found")
    rest = met.where("place > 1").join(found.toDF("root", "top"), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top", "place")
    whole = W.partitionBy("key")
    rest = written(rest.withColumn("_apart", F.min("root").over(whole) != F.max("root").over(whole)).where("_apart").drop("_apart"), "rest")
    ids = sized(written(rest.select("sid").distinct(), "apart"))
    marked = rest.join(written(marks(texts.join(ids, "sid", "left_semi").select("sid", "text")), "marks"), "sid")
    # two sets so similar have at most a ninth of their sizes' sum that isn't shared
    differ = " + ".join(f"bit_count(p{i}_a ^ p{i})" for i in range(MARK_WORDS))
    near_marks = f"({differ}) * {PART + WHOLE} <= {WHOLE - PART} * (n_a + n)"
    left = verified(swept(written(pairs(marked, "true", near_marks, tuple(f"p{i}" for i in range(MARK_WORDS))), "pairs")), texts)
    left = swept(written(left, "similar"))
    return components(near.unionByName(left).unionByName(found.toDF("a", "b")), written)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, similar: bool = True) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).
    similar: link near copies by their shingles too, not just fingerprints within the radius."""
    rows, linked = grouped(docs, radius, similar)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(linked, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, radius: int, similar: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp and (if similar) sid of each row; fp, root: the component of each fingerprint."""
    if similar:
        rows = written(map_texts(docs, "fp long, sid long", lambda: lambda texts: [[simhash(t) for t in texts], [text_key(t) for t in texts]]), "simhash")
    else:
        rows = written(map_texts(docs, "fp long", lambda: lambda texts: [[simhash(t) for t in texts]]), "simhash")
    prints = rows.select("fp").distinct()
    roots = components(links(prints, radius), written)
    linked = prints.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    if not similar:
        return rows, linked
    linked = written(linked, "linked")
    tops = similar_roots(docs, rows, linked).toDF("root", "top")
    return rows, linked.join(tops, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component: the one with the smallest doc_id (rows without one come last), then by a hash of
    the text, then by one of the whole row. Rows are judged one by one: of a repeated doc_id those rows stay that lead."""
    rows, linked = grouped(docs, radius, True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")
    sid, best_id, best_sid, place = (added(docs, c) for c in ("sid", "best", "best_sid", "place"))
    best = rows.join(linked, "fp").groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias(best_id), F.col("best.sid").alias(best_sid))
    mine, best = docs.withColumn(sid, F.xxhash64(F.col("text").cast("string"))), sized(written(best, "best"))
    found = mine.join(best, (mine[sid] == best[best_sid]) & mine["doc_id"].cast("long").eqNullSafe(best[best_id]), "left_semi")
    if rows.groupBy("doc_id", "sid").count().where("count > 1").isEmpty():  # else equal texts of one doc_id are told apart
        return found.select(*docs.columns)
    first = F.row_number().over(W.partitionBy("doc_id", sid).orderBy(row_hash(docs)))
    return found.withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)
