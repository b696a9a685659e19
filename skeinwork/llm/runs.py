"""Periodic runs in texts: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least max(6, 4 * q) words that no
neighbouring word extends. A run of length n overlaps itself shifted by its period in n - q words, which is 5 at least (q = 1) and
more for longer periods: so every word of a run lies inside a 5-gram that the document holds twice, and words outside such 5-grams
cannot join runs. Main-Lorentz looks at the stretches of words that stay: each is halved again and again, and the runs across a
middle are found for all periods at once, by comparing the middle with the places one period away.

Equality of stretches is exact: names of all stretches whose length is a power of two come from sorting pairs of names. The names
of the 5-grams are hashes; two that collide only let words through to the exact part.

Null and empty texts have no words and no runs. Rows are judged one by one: ties, repeated rows, repeated or null doc_ids, columns
of any other names and empty tables need no rule of their own. A very long text is a slice of its own, and takes memory
in proportion to its words times the logarithm of its longest surviving stretch."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare_words, in_arrow, slices

#: A run has at least this many words, and this many times its period.
LEAST, EXPONENT = 6, 4
#: Words that two places one period apart share at least: the least of max(6, 4 * q) - q over all periods.
OVERLAP = min(max(LEAST, EXPONENT * q) - q for q in range(1, LEAST + 1))
#: Documents whose decimal id's CRC-32 is divisible by this are edited by the query of the contract.
EVERY = 10


def repeated_cover(codes: np.ndarray, owner: np.ndarray, k: int = OVERLAP) -> np.ndarray:
    """Which words lie inside a k-gram that their document holds at least twice. owner: each word's document, ascending."""
    n = len(codes)
    if n < k:
        return np.zeros(n, bool)
    name = owner[: n - k + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(k):
            name = (name ^ codes[i : n - k + 1 + i].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            name ^= name >> np.uint64(29)
    whole = owner[: n - k + 1] == owner[k - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(name[at], kind="stable")]
    same = name[order[1:]] == name[order[:-1]]
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    ends = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + k, -1)
    return np.cumsum(ends[:-1]) > 0


class Stretches:
    """Names of all stretches of 1, 2, 4, ... words of a sequence: two of equal length are equal if their names are."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names = [codes]
        while 1 << len(self.names) <= longest:
            last, step = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            ahead = np.zeros(len(last), np.int64)
            ahead[:-step] = last[step:]
            self.names.append(np.unique(last * (int(last.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int32))

    def same(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths (1 or more) at x and y are equal: by two that overlap."""
        out, level = np.zeros(len(x), bool), np.frexp(length.astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            a, b, back, names = x[at], y[at], length[at] - (1 << k), self.names[k]
            out[at] = (names[a] == names[b]) & (names[a + back] == names[b + back])
        return out

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on."""
        far = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            far += (names[np.minimum(x + far, len(names) - 1)] == names[np.minimum(y + far, len(names) - 1)]).astype(np.int64) << k
        return far

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x equal those before y, backwards."""
        far = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, a, b = self.names[k], x - far - (1 << k), y - far - (1 << k)
            far += ((np.minimum(a, b) >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << k
        return far


def main_lorentz(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs inside the stretches [starts, ends) of codes. A word that stands once bounds each stretch
    on both sides, so that no comparison goes beyond it."""
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    found, known = [], Stretches(codes, int((ends - starts).max()))
    left, right = starts.astype(np.int64), ends.astype(np.int64)
    while len(left):
        middle, most = (left + right) // 2, (right - left) // EXPONENT
        at = np.repeat(np.arange(len(left)), most)
        period = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
        m = middle[at]
        # a run across the middle has two periods at least on one side of it
        for a, b in ((m, m + period), (m - 2 * period, m - period)):
            fits = np.flatnonzero(codes[a] == codes[b])
            fits = fits[known.same(a[fits], b[fits], period[fits])]
            a, b, p = a[fits], b[fits], period[fits]
            begin, end = a - known.behind(a, b), b + known.ahead(a, b)
            enough = end - begin >= np.maximum(LEAST, EXPONENT * p)
            found.append(np.stack((begin[enough], end[enough], p[enough])))
        left, right = np.concatenate((left, middle)), np.concatenate((middle, right))
        long = right - left >= LEAST
        left, right = left[long], right[long]
    begin, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, begin))  # multiples of a period give the same run: the smallest is kept
    begin, end, period = begin[order], end[order], period[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return begin[first], end[first], period[first]


def runs_of(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs in documents of so many words each that follow one another; starts are places in codes.
    In order of start, then period."""
    owner = np.repeat(np.arange(len(counts)), counts)
    cover = repeated_cover(codes, owner)
    # a border between documents ends a stretch as a masked word does
    edge = np.flatnonzero(cover[1:] & cover[:-1] & (owner[1:] != owner[:-1])) + 1
    step = np.diff(np.concatenate(([0], cover.astype(np.int8), [0])))
    starts, ends = np.sort(np.concatenate((np.flatnonzero(step == 1), edge))), np.sort(np.concatenate((np.flatnonzero(step == -1), edge)))
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    sizes = ends - starts
    # the stretches in a row, a word that stands once before each and behind the last
    to = np.cumsum(sizes + 1) - sizes
    place = np.repeat(starts - to, sizes) + np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes) + 1
    row = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    inside = np.ones(len(row), bool)
    inside[np.append(to - 1, len(row) - 1)] = False
    row[inside] = codes[place]
    row[~inside] = int(codes.max(initial=0)) + 1 + np.arange(int((~inside).sum()))
    row = np.unique(row, return_inverse=True)[1].astype(np.int32)
    begin, end, period = main_lorentz(row, to, to + sizes)
    start = begin + (starts - to)[np.searchsorted(to, begin, side="right") - 1] if len(begin) else begin
    order = np.lexsort((period, start))
    return start[order], (end - begin)[order], period[order]


def find_runs(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed:
    the words joined by one space, each run cut down to its first period."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                words, counts = bare_words(part.column(1))
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, length, period = runs_of(codes, counts)
                ends = np.cumsum(counts)
                drop = np.zeros(len(codes) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                stay = np.cumsum(drop[:-1]) == 0
                offsets = np.concatenate(([0], np.cumsum(stay)))[np.concatenate(([0], ends))]
                kept = words if stay.all() else words.filter(pa.array(stay))
                collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), kept), " ")
                owner = np.searchsorted(ends, start, side="right")
                local = start - (ends - counts)[owner]
                rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (local, length, period)], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(counts) + 1)), pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), listed.cast(run_type), collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(source, run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_tails(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, text; where the CRC-32 h of the decimal doc_id (a null one counts as the empty text) is divisible by every and the text
    has n > 0 words, the words from a on repeat p words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.col("text").cast("string")
    words = F.when(F.pmod(h, F.lit(every)) == 0, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.floor(h / 10).alias("g"), words.alias("words"))
    one = one.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    one = one.withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    turned = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a))")
    return one.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """found: of find_runs. doc_id, n_runs; start, length, period and exponent_milli of the longest run (the first of equals; null
    without runs), and digests of all runs and of the collapsed text."""
    best = F.expr("aggregate(runs, runs[0], (x, r) -> CASE WHEN r.length > x.length THEN r ELSE x END)")  # in order of start, then period
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


#: The same by joining each document's equal 5-grams: stretches of pairs that follow one another, so many words apart.
ORACLE_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), hashed AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM documents, crc_table
), drawn AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % {EVERY} = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), turned AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM drawn
), texts AS (
  SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM turned
), words AS (
  SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts
), grams AS (
  SELECT rid, n, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {OVERLAP - 1} FOLLOWING) AS gram FROM words
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON y.rid = x.rid AND y.gram = x.gram AND y.i > x.i AND (y.i - x.i) * {EXPONENT} <= x.n WHERE x.i + {OVERLAP} <= x.n AND y.i + {OVERLAP} <= y.n
), islands AS (
  SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT rid, q, min(i) AS start, count(*) + {OVERLAP - 1} + q AS length FROM islands GROUP BY rid, q, island
), runs AS (
  SELECT rid, start, length, min(q) AS period FROM stretches WHERE length >= greatest({LEAST}, {EXPONENT} * q) GROUP BY rid, start, length
), listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best FROM runs GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.rid, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.rid = w.rid AND g.i = w.i GROUP BY w.rid
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM texts t LEFT JOIN listed l ON l.rid = t.rid LEFT JOIN kept k ON k.rid = t.rid
"""
