"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches over paragraphs, in SQL functions alone.

A sketch has three rows of cells; each distinct paragraph's digest adds to one cell of each row: one to a count, itself to
an xor of digests, its check to an xor of checks. The difference of two sketches holds just what only one of them has.
A cell with count one whose check fits holds one digest; peeling it out of its other cells frees more. If cells are left
over, larger sketches are tried, in parts by digest so that each part stays small; a part that doesn't peel is tried again
with more cells and other places. Likeness: one less the differing digests' part of all digests of both (null if five
sketches of a part all fail, whose odds are below 1e-15).

Paragraphs are the non-empty lines; repeated ones count once. A null text is empty: no paragraphs, like any other text
without (likeness 1). The next document is the one behind in ascending order (doc_id, then the text's MD5; null first),
after the last the first; a lone document is its own next. Equal texts have equal fingerprints. Repeated doc_ids are ordered
by their texts; equal rows are interchangeable. Columns besides doc_id and text may have any names; an empty table gives no
rows.

Finding the next document: quantiles of doc_id cut the rows into ranges, and equal widths into parts of ranges; each row goes
to its part, and each part's first row also to the part before. One shuffle of texts; each text is split and sketched once
behind it, and goes along to the document before."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Cells in each of the three rows of a fingerprint; in those of the larger attempts.
BASE, ATTEMPTS = 8, (16, 32, 64, 128, 256)
#: Digests that a part of a larger attempt has on average, rounds of peeling, most ranges of doc_id and parts of each.
PART, ROUNDS, MOST_RANGES, SUBRANGES = 20, 12, 1024, 64
#: Recovered digests: of which side, and the digest.
FOUND = "array<struct<n: int, k: bigint>>"


def let(value: str, name: str, body: str) -> str:
    """body, with name for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def check_of(digest: str) -> str:
    return f"cast(conv(substring(md5(cast(cast({digest} as string) as binary)), 1, 8), 16, 10) as bigint)"


def digests(text: str) -> str:
    """Distinct paragraphs of a text as structs of digest and check."""
    lines = f"filter(split({text}, '\\n'), l -> l <> '')"
    found = f"array_distinct(transform({lines}, l -> cast(conv(substring(md5(cast(l as binary)), 1, 15), 16, 10) as bigint)))"
    return f"transform({found}, d -> named_struct('n', 1, 'k', d, 'c', {check_of('d')}))"


def placed(keys: str, wide: int, attempt: int) -> str:
    """Keys with their cells, one in each row of cells: each row takes other bits of the digest, or in later attempts of a
    hash of it that is the attempt's own."""
    bits = f"xxhash64(y.k, {attempt})" if attempt else "y.k"
    cell = lambda row: f"cast({row * wide} + pmod(shiftright({bits}, {20 * row}), {wide}) as int)"
    return f"transform({keys}, y -> named_struct('n', y.n, 'k', y.k, 'c', y.c, 'p', {cell(0)}, 'q', {cell(1)}, 'r', {cell(2)}))"


def sketch(keys: str, wide: int, attempt: int) -> str:
    """Cells of keys."""
    add = "named_struct('n', s.n + x.n, 'k', s.k ^ x.k, 'c', s.c ^ x.c)"
    none = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
    row = lambda k, at: f"transform(sequence({k * wide}, {(k + 1) * wide - 1}), i -> aggregate(ys, {none}, (s, x) -> if(x.{at} = i, {add}, s)))"
    return let(placed(keys, wide, attempt), "ys", f"concat({row(0, 'p')}, {row(1, 'q')}, {row(2, 'r')})")


def minus(keys: str) -> str:
    return f"transform({keys}, y -> named_struct('n', -y.n, 'k', y.k, 'c', y.c))"


def peeled(cells: str, wide: int, attempt: int) -> str:
    """The digests that come out of a difference of sketches, as structs of digest (k) and side (n: 1 for the first document's, -1 for
    the second's); null if some stay. Each step takes the digests of all cells that hold a single one out of all their cells;
    when there is none, the steps that are left do nothing."""
    single = f"filter(st.cells, x -> abs(x.n) = 1 and x.c = {check_of('x.k')})"
    take = "named_struct('n', u.n - o.n, 'k', u.k ^ o.k, 'c', u.c ^ o.c)"
    rest = f"transform(st.cells, (x, i) -> aggregate(pure, x, (u, o) -> if(o.p = i or o.q = i or o.r = i, {take}, u)))"
    state = lambda cells, found, ended: f"named_struct('cells', {cells}, 'found', {found}, 'ended', {ended})"
    out = f"if(size(pure) = 0, {state('st.cells', 'st.found', 'true')}, {state(rest, "concat(st.found, transform(pure, o -> named_struct('n', o.n, 'k', o.k)))", 'false')})"
    step = f"if(st.ended, st, {let(f'array_distinct({placed(single, wide, attempt)})', 'pure', out)})"
    end = f"if(exists(st.cells, x -> x.n <> 0 or x.k <> 0), cast(null as {FOUND}), st.found)"
    return f"aggregate(sequence(1, {ROUNDS}), {state(cells, f'cast(array() as {FOUND})', 'false')}, (st, t) -> {step}, st -> {end})"


def differing(keys_a: str, keys_b: str, cells_a: str, cells_b: str) -> str:
    """The digests that only one of two documents has, with their side, by ever larger sketches. Lazily: coalesce stops at the first that
    peels. Parts are found in two steps, so a text of many paragraphs isn't passed over once for each part."""
    subtract = f"zip_with({cells_a}, {cells_b}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'c', a.c ^ b.c))"
    both = f"concat({keys_a}, {minus(keys_b)})"
    side = f"cast(ceil(sqrt((1 + size(every)) / {PART}.0D)) as int)"
    tries = ", ".join(peeled(sketch("own", wide, k), wide, k) for k, wide in enumerate(ATTEMPTS, 1))
    part = let("filter(some, z -> pmod(shiftright(z.k, 30), side) = h)", "own", f"coalesce({tries})")
    inner = f"flatten(transform(sequence(0, side - 1), h -> {part}))"
    outer = let("filter(every, z -> pmod(z.k, side) = g)", "some", inner)
    parts = f"flatten(transform(sequence(0, side - 1), g -> {outer}))"  # null if one part is
    return f"coalesce({peeled(subtract, BASE, 0)}, {let(both, 'every', let(side, 'side', parts))})"


def likeness(keys_a: str, keys_b: str, found: str) -> str:
    total = f"(size({keys_a}) + size({keys_b}))"
    return f"if({total} = 0, 1.0D, round(1 - size({found}) / cast({total} as double), 6))"


def side(found: str, n: int) -> str:
    """Sorted digests of one side."""
    return f"array_sort(transform(filter({found}, x -> x.n = {n}), x -> x.k))"


def changes(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs: two texts and whatever. Its columns with removed and added: the digests of paragraphs that only the old or only the new text has,
    sorted, recovered from the difference of both texts' sketches; null if no sketch peels. digest_of() tells whose they are. removed and
    added take the place of columns of these names."""
    rows = pairs
    for name, c in (("_a", old), ("_b", new)):
        rows = rows.withColumn(name, F.expr(digests(f"coalesce(cast(`{c}` as string), '')"))).withColumn(f"{name}_cells", F.expr(sketch(name, BASE, 0)))
    rows = rows.withColumn("_found", F.expr(differing("_a", "_b", "_a_cells", "_b_cells")))
    keep = [c for c in pairs.columns if c.lower() not in ("removed", "added")]
    return rows.select(*keep, F.expr(side("_found", 1)).alias("removed"), F.expr(side("_found", -1)).alias("added"))


def digest_of(paragraph: str) -> int:
    """The digest of a paragraph, as sketches hold it."""
    import hashlib

    return int(hashlib.md5(paragraph.encode()).hexdigest()[:15], 16)


def shown(keys: str, cells: str) -> str:
    """A sketch as text: the number of paragraphs, then the cells."""
    return f"concat(size({keys}), ';', array_join(transform({cells}, x -> concat(x.n, ':', x.k, ':', x.c)), ','))"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, cells, next (the same of the next document, as a struct); texts are not null."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.md5(F.col("text").cast("binary")))
    ranges = min(MOST_RANGES, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(ranges + 1)], 10 * ranges)).first()[0]
    cuts = sorted(set(cuts or [0]))
    # the range of a doc_id among the cuts, and its part of the range, of equal widths
    tops = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.size(F.filter(tops, lambda c: c <= F.coalesce("doc_id", F.lit(cuts[0] - 1 if cuts[0] > -(1 << 63) else cuts[0]))))
    low, high = F.coalesce(F.get(tops, at - 1), F.lit(cuts[0])).cast("double"), F.coalesce(F.get(tops, at), F.lit(cuts[-1])).cast("double")
    span, doc_id = high - low, F.col("doc_id").cast("double")
    part = F.when(F.col("doc_id").isNull() | (span <= 0), 0).otherwise(F.least(F.lit(SUBRANGES - 1), F.greatest(F.lit(0), F.floor((doc_id - low) / span * SUBRANGES))))
    ranged = rows.withColumn("range", (at * SUBRANGES + part).cast("int"))
    # at most one row for each part of a range: bounded, however many documents there are
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    whole = W.orderBy("range")
    before = F.coalesce(F.lag("range").over(whole), F.max("range").over(W.partitionBy()))
    firsts = firsts.select("range", "first", before.alias("before"))
    joined = ranged.join(F.broadcast(firsts), "range")
    own, there = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    dealt = joined.select("doc_id", "text", "tie", F.explode(F.when(is_first, F.array(own, there)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", "tie", "to.range", "to.guest").repartition("range")
    dealt = dealt.withColumn("keys", F.expr(digests("text")))
    dealt = dealt.withColumn("cells", F.expr(sketch("keys", BASE, 0)))
    order = W.partitionBy("range").orderBy("guest", "doc_id", "tie")
    return dealt.withColumn("next", F.lead(F.struct("text", "keys", "cells")).over(order)).where("guest = 0").select("doc_id", "text", "keys", "cells", "next")


def compared(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, text, edited (its edited text) and next_text; keys, e_keys, n_keys: digests of the paragraphs of the three;
    cells, e_cells: sketches; edited_found, next_found: digests that only one of the text and the edited or next one has, with
    their side (n: 1 for the text's own)."""
    rows = with_next(docs).withColumn("n", F.length("text"))
    half = "int(n div 2)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, n - {half}), substring(next.text, 1, {half}))"))
    rows = rows.withColumn("e_keys", F.expr(digests("edited")))
    rows = rows.withColumn("e_cells", F.expr(sketch("e_keys", BASE, 0)))
    return rows.select(
        "doc_id", "text", "n", "edited", F.col("next.text").alias("next_text"), "keys", "e_keys", F.col("next.keys").alias("n_keys"), "cells", "e_cells",
        F.expr(differing("keys", "e_keys", "cells", "e_cells")).alias("edited_found"), F.expr(differing("keys", "next.keys", "cells", "next.cells")).alias("next_found"),
    )


def document_changes(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, and the paragraph digests that the edited and the next text remove and add (sorted; null if no
    sketch peels): edited_removed, edited_added, next_removed, next_added."""
    return compared(docs).select("doc_id", *[F.expr(side(f"{k}_found", n)).alias(f"{k}_{name}") for k in ("edited", "next") for n, name in ((1, "removed"), (-1, "added"))])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compared(docs).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(shown("keys", "cells")).alias("fingerprint"), F.expr(shown("e_keys", "e_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "e_keys", "edited_found")).alias("near_edited"), F.expr(likeness("keys", "n_keys", "next_found")).alias("near_next"),
    )


def _oracle_sketch(keys: str) -> str:
    cell = f"list_filter({keys}, lambda k: ((k >> (20 * (i // {BASE}))::BIGINT) % {BASE}) = i % {BASE})"
    check = "('0x' || substr(md5(k::VARCHAR), 1, 8))::BIGINT"
    xor_of = lambda x: f"list_reduce(list_prepend(0::BIGINT, {x}), lambda p, q: xor(p, q))"
    one = f"len({cell}) || ':' || {xor_of(cell)} || ':' || {xor_of(f'list_transform({cell}, lambda k: {check})')}"
    return f"len({keys}) || ';' || array_to_string(list_transform(range({3 * BASE}), lambda i: {one}), ',')"


def _oracle_keys(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({text}, chr(10)), lambda l: l <> ''), lambda l: ('0x' || substr(md5(l), 1, 15))::BIGINT))"


def _oracle_near(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE round(1 - (len({a}) + len({b}) - 2 * len(list_intersect({a}, {b})))::DOUBLE / (len({a}) + len({b})), 6) END"


ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), nexts AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM base WINDOW o AS (ORDER BY doc_id NULLS FIRST, md5(text))
), edits AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM nexts
), keyed AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_oracle_keys("text")} AS a, {_oracle_keys("edited")} AS e, {_oracle_keys("next_text")} AS b FROM edits
)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, {_oracle_sketch("a")} AS fingerprint, {_oracle_sketch("e")} AS edited_fingerprint,
  {_oracle_near("a", "e")} AS near_edited, {_oracle_near("a", "b")} AS near_next
FROM keyed
"""
