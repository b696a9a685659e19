"""Removal of repeated word windows, found and verified by recompression.

Recompression rewrites a row of words in rounds: symbols fall into two classes by a bit of their name, each pair of a
first-class symbol and a second-class one behind it becomes one symbol, and runs of equal symbols become one. Names are
hashes of content, so they are the same in all documents and naming needs no exchange. Equal stretches are rewritten equally
but for what lies at their ends: with every symbol goes the hull of words that decided it, and a symbol whose hull lies
within a window is in every equal window. The longest such symbol, with the words that follow up to eight from its hull's
first, is the window's anchor (of equally long ones the one with the largest name).

The consecutive windows of one anchor are a stretch: the anchor's symbol and the words around it as far as it is theirs.

1. First round: stretches meet at their anchors. Where all that meet are the same, no two windows of others can be equal:
   all but the first document lose the stretch, and nothing is left to compare. So long repeats are settled, but for their ends.
2. Second round: where different stretches share an anchor, windows of each one's first document meet one by one.
3. Words covered by a stretch or window that starts in an earlier document too are removed.

What is compared are names of 126 bits of all words (78 of the stretch beside 48 of its anchor, or 126 of the window), made
of 128-bit hashes of the words: equal names are taken for equal words.

A task settles what it can among the documents of one chunk first and sends one row for each name on, so a passage that a
third of all documents share meets as often as there are chunks, not documents. Chunks are cut from rows in order, so a task
that runs again sends the same. Results go back to documents by doc_id; the text is shuffled once, and that exchange is used
again. Memory: a chunk's arrays in a Python worker; all meeting and sorting is Spark's.

Null, empty and short texts (fewer words than a window) keep all their words, joined by spaces. Rows without a doc_id
neither remove nor lose words. Rows that share a doc_id are one document's: none is earlier than the other. Equal rows get
equal results. Columns besides doc_id and text may have any names; an empty table gives no rows."""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bare_words, in_arrow, slices, split_words

WINDOW, ROUNDS = 13, 5
#: Rounds that name runs too, beside pairs: a symbol's hull then takes in both neighbours.
RUN_ROUNDS = (1,)
#: Words that an anchor takes in at least, from its hull's first on: few unrelated texts share so many.
CONTEXT = 8
#: Bytes of text in a chunk, unless a single text is longer.
CHUNK = 2 << 20
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
FAR = 1 << 40
#: Rows that a task sends: the first document of a name in its chunk, the same where the chunk has another, a document settled.
ALONE, SHARED, SETTLED = 0, 1, 2
#: Two words of 64 bits for each name, the lowest two bits of the first for the kind of row.
SENT, KINDS = "x long, y long, doc long", 3


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * K2
    x = (x ^ (x >> np.uint64(32))) * K3
    return x ^ (x >> np.uint64(30))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = np.uint64(base), np.uint64(pow(base, -1, 1 << 64)), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            one, n = np.ones(1, np.uint64), n + (n >> 3)  # a worker keeps them
            self.up = np.cumprod(np.concatenate([one, np.full(n - 1, self.base)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n - 1, self.inverse)]))


POWERS = Powers(0x9E3779B97F4A7C13), Powers(0xD6E8FEB86659FD93)


class Names:
    """64-bit names of all stretches of a row of words, from sums of the words' hashes times powers of a number."""

    def __init__(self, hashes: np.ndarray, family: int):
        n = len(hashes)
        self.powers = POWERS[family]
        self.powers.reach(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(hashes + K1) * self.powers.up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.powers.down[start] + (end - start).astype(np.uint64) * K3)


def compressed(names, start, end, low, high, doc, level):
    """One round: symbols as arrays of names, extents, hulls and documents. Returns the same, and which are new."""
    n = len(names)
    side = mixed(names + np.uint64(level * int(K1) % (1 << 64))) >> np.uint64(63) == 1
    same = np.zeros(n, bool)  # with the one behind
    same[:-1] = doc[1:] == doc[:-1]
    pair = np.zeros(n, bool)
    pair[:-1] = same[:-1] & ~side[:-1] & side[1:]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    single = ~pair & ~second
    # that a symbol stays single hangs on the neighbour it could have joined, and where runs are named on both, and on the
    # one beyond an equal neighbour, which may take that away; at a document's ends on what isn't there
    around_low, around_high = np.full(n, -FAR), np.full(n, FAR)
    around_low[1:] = np.where(same[:-1], low[:-1], -FAR)
    around_high[:-1] = np.where(same[:-1], high[1:], FAR)
    if level not in RUN_ROUNDS:
        around_low, around_high = np.where(side, around_low, low), np.where(side, high, around_high)
    else:
        twin = same.copy()
        twin[:-1] &= names[1:] == names[:-1]
        beyond_low, beyond_high = np.append(-FAR, around_low[:-1]), np.append(around_high[1:], FAR)
        around_high = np.where(twin, beyond_high, around_high)
        around_low[1:] = np.where(twin[:-1], beyond_low[1:], around_low[1:])
    new_names, new_end = names.copy(), end.copy()
    new_low, new_high = np.where(single, np.minimum(low, around_low), low), np.where(single, np.maximum(high, around_high), high)
    at = np.nonzero(pair)[0]
    new_names[at] = mixed(mixed(names[at] + K1) + names[at + 1] * K3)
    new_end[at] = end[at + 1]
    new_low[at], new_high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
    stay = ~second
    names, start, end, low, high, doc, fresh = new_names[stay], start[stay], new_end[stay], new_low[stay], new_high[stay], doc[stay], pair[stay]
    if level not in RUN_ROUNDS:
        return names, start, end, low, high, doc, fresh
    n = len(names)
    equal = np.zeros(n, bool)  # to the one before
    equal[1:] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1]) & ~fresh[1:] & ~fresh[:-1]
    if equal.any():
        first = np.nonzero(~equal)[0]
        length = np.diff(np.append(first, n))
        last = first + length - 1
        run = length > 1
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        names, start, end, doc, fresh = names[first], start[first], end[last], doc[first], fresh[first] | run
        names = np.where(run, mixed(mixed(names ^ K2) + length.astype(np.uint64) * K1), names)
    return names, start, end, low, high, doc, fresh


def anchors(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the anchor of the window that starts there (whatever for windows that leave their document):
    the length of the symbol in the highest four bits, its name in the others."""
    n, spare = len(hashes), WINDOW - CONTEXT + 1
    around = np.zeros(n, np.uint64)
    if n >= CONTEXT:
        start = np.arange(n - CONTEXT + 1)
        around[: len(start)] = Names(hashes, 0)(start, start + CONTEXT)
    at = np.arange(n)
    symbols = hashes, at, at + 1, at, at + 1, doc
    # the best symbol by how many words its hull takes in beyond CONTEXT, and by where the hull starts
    held = np.zeros((spare, n), np.uint64)
    for level in range(1, ROUNDS + 1):
        *symbols, fresh = compressed(*symbols, level)
        names, start, end, low, high, _ = symbols
        fit = np.nonzero(fresh & (high - low <= WINDOW) & (low >= 0))[0]  # hulls that leave their document don't fit
        low, wide = low[fit], np.maximum((high - low)[fit] - CONTEXT, 0)
        keys = np.minimum(end[fit] - start[fit], 15).astype(np.uint64) << np.uint64(60) | mixed(names[fit] ^ around[low]) >> np.uint64(4)
        np.maximum.at(held.reshape(-1), wide * n + low, keys)
    np.maximum.accumulate(held, axis=0, out=held)
    best = held[spare - 1].copy()
    for back in range(1, spare):
        np.maximum(best[: n - back], held[spare - 1 - back, back:], out=best[: n - back])
    bare = np.nonzero(best == 0)[0]
    bare = bare[bare + WINDOW <= n]
    if len(bare):  # no symbol but single words
        most = np.zeros(len(bare), np.uint64)
        for k in range(spare):
            most = np.maximum(most, around[bare + k] >> np.uint64(4) | np.uint64(1 << 60))
        best[bare] = most
    return best


class Chunk:
    """The words of some documents in a row, as Arrow values, with two hashes each; whole: which words start a window."""

    def __init__(self, ids: list, texts):
        words, counts, known = split_words(texts)
        self.hashes, self.others = np.ascontiguousarray(known[:, 0]), np.ascontiguousarray(known[:, 1])
        self.words, self.counts, self.begin = words, counts, np.cumsum(counts) - counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(self.begin + counts, counts) - np.arange(len(self.doc))
        self.whole = (left >= WINDOW) & np.array([i is not None for i in ids], bool)[self.doc]
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)

    def names(self) -> tuple[Names, Names]:
        return Names(self.hashes, 0), Names(self.others, 1)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First windows, ends behind last windows, and names (48 bits of the anchor and 14 of the words; 64 of the words)."""
        best, at = anchors(self.hashes, self.doc), np.nonzero(self.whole)[0]
        new = np.ones(len(at), bool)
        new[1:] = (best[at[1:]] != best[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        first = at[new]
        until = at[np.append(np.nonzero(new)[0][1:], len(at)) - 1] + 1 if len(at) else first
        one, two = self.names()
        end = until + WINDOW - 1
        return first, until, mixed(best[first]) >> np.uint64(16) << np.uint64(16) | two(first, end) >> np.uint64(50) << np.uint64(2), one(first, end)

    def windows(self, first: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and names of the windows of these stretches."""
        length = until - first
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        one, two = self.names()
        return at, one(at, at + WINDOW) & ~np.uint64(KINDS), two(at, at + WINDOW)


def among(doc, x, y, told_doc, told_x, told_y) -> np.ndarray:
    """Places of (doc, x, y) among those that were told, or -1."""
    blend = lambda d, a, b: mixed(mixed(a ^ mixed(d.astype(np.uint64) + K1)) + b)
    if not len(told_x):
        return np.full(len(x), -1)
    told = blend(told_doc, told_x, told_y)
    order = np.argsort(told, kind="stable")
    mine = blend(doc, x, y)
    at = order[np.minimum(np.searchsorted(told[order], mine), len(told) - 1)]
    return np.where((told_x[at] == x) & (told_y[at] == y) & (told_doc[at] == doc), at, -1)


def settled(x: np.ndarray, y: np.ndarray, ids: np.ndarray):
    """A chunk's rows by name: its first document, for the others word that an earlier one has it."""
    import pyarrow as pa

    order = np.lexsort((ids, y, x))
    x, y, ids = x[order], y[order], ids[order]
    same = np.zeros(len(x), bool)
    same[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    once = ~same
    once[1:] |= ids[1:] != ids[:-1]
    x, y, ids, same = x[once], y[once], ids[once], same[once]
    kind = np.where(same, SETTLED, ALONE).astype(np.uint64)
    kind[:-1][~same[:-1] & same[1:]] = SHARED
    return pa.RecordBatch.from_arrays([pa.array((x | kind).view(np.int64)), pa.array(y.view(np.int64)), pa.array(ids)], names=["x", "y", "doc"])


def met(sent: DataFrame, key: str) -> DataFrame:
    """key, x, y, doc, kind, first (the first document of the name), in order: names with an equal key are in one partition.
    Settled rows meet nobody: they go by their documents."""
    key = F.expr(f"if(x & {KINDS} = {SETTLED}, xxhash64(doc) | ~9223372036854775807L, {key})")
    rows = sent.repartition(key).select(key.alias("key"), F.expr(f"x & ~{KINDS}L").alias("x"), "y", "doc", F.expr(f"x & {KINDS}").alias("kind"))
    return rows.sortWithinPartitions("key", "x", "y").withColumn("first", F.min("doc").over(W.partitionBy("key", "x", "y")))


def first_round(sent: DataFrame) -> DataFrame:
    """doc, x, y, gone: stretches that an earlier document has (gone), and those whose windows are to be compared."""
    rows, whole = met(sent, "shiftrightunsigned(x, 16)"), W.partitionBy("key")
    differ = lambda c: F.min(c).over(whole) != F.max(c).over(whole)
    rows = rows.withColumns({"documents": differ("doc") | (F.max("kind").over(whole) == SHARED), "stretches": differ("x") | differ("y")})
    gone = (F.col("kind") == SETTLED) | (F.col("doc") > F.col("first"))
    return rows.select("doc", "x", "y", gone.alias("gone"), (F.col("documents") & F.col("stretches")).alias("look")).where("gone or look").drop("look")


def second_round(sent: DataFrame) -> DataFrame:
    """doc, x, y, gone: windows that an earlier document has."""
    rows = met(sent, "shiftrightunsigned(x, 2)").where((F.col("kind") == SETTLED) | (F.col("doc") > F.col("first")))
    return rows.select("doc", "x", "y", F.lit(True).alias("gone"))


def by_document(found: DataFrame) -> DataFrame:
    """_key, told: all that a document is told. Of a document's size at most."""
    return found.groupBy(F.col("doc").alias("_key")).agg(F.collect_list(F.struct("x", "y", "gone")).alias("told")).hint("shuffle_hash")


def remove_repeats(docs: DataFrame, carry: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_removed, kept_sha256; with carry the columns of docs, the kept words as
    text and their number of characters as n_chars (if there is such a column). chunk_bytes: of text in a chunk; any gives the same result."""
    # other columns go along under names of our own, so theirs can be anything
    doc_id, others = F.col("doc_id").cast("long"), [c for c in docs.columns if carry and c not in ("doc_id", "text")]
    slim = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(others)])
    names = slim.columns
    # a key that is never null, so rows without a doc_id spread (what a row without one may be told it doesn't ask for); else
    # the inner join would filter its input, and the two exchanges of texts would differ
    dealt = slim.withColumn("_key", F.coalesce("doc_id", F.xxhash64("text"))).repartition("_key")

    def chunks(batches):
        for batch in batches:
            for part in slices(batch, 1, chunk_bytes):
                yield Chunk(part.column(0).to_pylist(), part.column(1)), part

    def told_of(chunk: Chunk, part):
        """What the chunk's documents were told: their places in it, names, and whether they are gone."""
        import pyarrow.compute as pc

        lists = part.column("told")
        lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        held = lists.flatten()
        x, y = (held.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        return np.repeat(np.arange(len(lengths)), lengths), x, y, held.field(2).to_numpy(zero_copy_only=False)

    def send_stretches(batches):
        for chunk, _ in chunks(batches):
            first, _, x, y = chunk.stretches()
            yield settled(x, y, chunk.ids[chunk.doc[first]])

    def send_windows(batches):
        for chunk, part in chunks(batches):
            doc, told_x, told_y, gone = told_of(chunk, part)
            first, until, x, y = chunk.stretches()
            look = among(chunk.doc[first], x, y, doc[~gone], told_x[~gone], told_y[~gone]) >= 0
            at, x, y = chunk.windows(first[look], until[look])
            yield settled(x, y, chunk.ids[chunk.doc[at]])

    def rows(part, words, counts, left):
        """Rows of the result: the words that are kept in a row, the number that each document had and has left."""
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
        kept = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")
        if carry:
            return pa.RecordBatch.from_arrays([part.column(0), kept, *part.columns[2 : len(names)]], names=names)
        digests = [hashlib.sha256(k).hexdigest() for k in kept.cast(pa.binary()).to_pylist()]
        columns = [part.column(0), pa.array(counts), pa.array(counts - left), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    def finish(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in (part for batch in batches for part in slices(batch, 1, chunk_bytes)):
            told = pc.greater(pc.fill_null(pc.list_value_length(part.column("told")), 0), 0)
            # a document that was told nothing keeps its words: where its stretches lie isn't asked
            quiet, part = part.filter(pc.invert(told)), part.filter(told)
            if quiet.num_rows:
                words, counts = bare_words(quiet.column(1))
                yield rows(quiet, words, counts, counts)
            if not part.num_rows:
                continue
            chunk = Chunk(part.column(0).to_pylist(), part.column(1))
            doc, told_x, told_y, _ = told_of(chunk, part)
            edge = np.zeros(len(chunk.doc) + 1, np.int64)
            if len(doc):
                first, until, x, y = chunk.stretches()
                hit = among(chunk.doc[first], x, y, doc, told_x, told_y) >= 0
                at, x, y = chunk.windows(first[~hit], until[~hit])
                alone = at[among(chunk.doc[at], x, y, doc, told_x, told_y) >= 0]
                np.add.at(edge, np.concatenate([first[hit], alone]), 1)
                np.add.at(edge, np.concatenate([until[hit], alone + 1]) + WINDOW - 1, -1)
            stay = np.cumsum(edge)[:-1] == 0
            counts = np.bincount(chunk.doc[stay], minlength=len(chunk.counts))
            yield rows(part, chunk.words.filter(pa.array(stay)), chunk.counts, counts)

    # all three take all columns of slim: so the exchange of texts is the same and runs once; in order, so that chunks are
    # the same whenever a task runs
    ordered = lambda df: df.sortWithinPartitions("_key", F.xxhash64("text")).drop("_key")
    stretches = first_round(in_arrow(ordered(dealt), send_stretches, SENT))
    looking = by_document(stretches.where("not gone"))
    windows = second_round(in_arrow(ordered(dealt.join(looking, "_key").select(*names, "told", "_key")), send_windows, SENT))
    gone = by_document(stretches.where("gone").unionByName(windows))
    out = dealt.join(gone, "_key", "left").select(*names, "told")
    if not carry:
        return in_arrow(out, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    kept = in_arrow(out, finish, slim.schema)
    back_again = {c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"_x{i}") for i, c in enumerate(others)}
    return kept.select(*[(back_again[c] if c in back_again else F.col(c)).alias(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM split)
), least AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT x.doc_id, x.p + k AS i FROM windows x JOIN least l ON l.w = x.w AND l.first < x.doc_id, (SELECT unnest(range({WINDOW})) AS k)
), marked AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, len(words) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS rest
  FROM split s LEFT JOIN marked m ON m.doc_id = s.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""
