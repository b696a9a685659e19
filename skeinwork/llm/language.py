"""Language identification with n-gram filters that hold a bitmask of languages.

Each slot of the filter is one machine word whose bit l belongs to language l: a bit-sliced stack of one Bloom filter
per language. An n-gram's slots, combined with and, give all languages that contain it at once. A text's language is
the one with most of its n-grams, after each count is corrected for the filter's false positives.

A null text, or one without a letter, is und with score 0; so is every text if there is nothing to learn from. Ties go
to the language first in the alphabet. Equal texts get equal rows; rows are judged one by one, so repeated or null doc_ids
need no rule of their own. Columns besides those named may have any names; an empty table gives no rows."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import added, fold, give_back, map_texts

#: Rows that language models may learn from: those whose remainder is not this one.
FOLDS, HELD_OUT = 4, 2
#: Texts of a language to learn from, and their length: the bound of the sample.
SAMPLE_TEXTS, SAMPLE_CHARS = 1200, 20_000
#: Texts of all languages together, and languages, at most: with more languages each has fewer texts (SHORTEST at least), and
#: beyond that many a column is no language column.
ALL_TEXTS, MOST_LANGUAGES = 10_000, 2000
#: Of a language without a text in that sample, the beginnings of so many of its shortest texts are taken.
SHORTEST = 20
#: Lengths of n-grams; bits of a slot's number; slots of an n-gram.
ORDERS, SLOT_BITS, PROBES = (3, 5), 20, 2
#: An n-gram is a language's if it was seen so often there, and at this part of the rate where it is most usual.
LEAST_SEEN, LEAST_RATE = 3, 0.2

MIX = np.uint64(0x9E3779B97F4A7C15)
PROBE_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def letter_table() -> np.ndarray:
    """For each character of the basic plane its lower case if it is a letter, else a space."""
    table = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-case letters with one space for each run of other characters, as code points."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    beyond = codes >= len(table)
    out = table[np.where(beyond, 32, codes)]
    if beyond.any():
        far = np.unique(codes[beyond])
        far = far[[chr(c).isalpha() for c in far]]
        out = np.where(np.isin(codes, far), codes, out)
    gap = out == 32
    out = out[~(gap & np.roll(gap, 1))] if len(out) > 1 else out
    return np.concatenate(([np.uint32(32)], out, [np.uint32(32)]))


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of all orders."""
    wide = codes.astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(wide) >= n:
            h = np.full(len(wide) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ wide[i : len(wide) - n + 1 + i]) * MIX
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in PROBE_MIX[:PROBES]]


def learn(samples: dict[str, list[str]]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Languages, filters of up to 64 languages each, and the rate of false positives of each language."""
    languages, table = sorted(samples), letter_table()
    keys, rates, counts = [], [], []
    for x in languages:
        grams = [ngrams(letters(t, table)) for t in samples[x]]
        key, n = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
        keys.append(key)
        counts.append(n)
        rates.append(n / max(1, n.sum()))
    every = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    best = np.zeros(len(every))
    for key, rate in zip(keys, rates, strict=True):
        at = np.searchsorted(every, key)
        best[at] = np.maximum(best[at], rate)
    sieves, false = [], []
    for begin in range(0, len(languages), 64):
        end = min(begin + 64, len(languages))
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= end - begin)
        sieve = np.zeros(1 << SLOT_BITS, dtype=kind)
        for i in range(begin, end):
            own = keys[i][(counts[i] >= LEAST_SEEN) & (rates[i] >= LEAST_RATE * best[np.searchsorted(every, keys[i])])]
            for at in slots(own):
                sieve[at] |= kind(1 << (i - begin))
        sieves.append(sieve)
        false += [float(((sieve >> kind(i)) & kind(1)).mean()) ** PROBES for i in range(end - begin)]
    return languages, sieves, np.array(false)


def decide(codes: np.ndarray, languages: list[str], sieves: list[np.ndarray], false: np.ndarray) -> tuple[str, float]:
    """The language whose corrected count of n-grams is the largest, and its part of all corrected counts."""
    if not languages or not (codes != 32).any():
        return "und", 0.0
    h, hits = ngrams(codes), []
    places = slots(h)
    for k, sieve in enumerate(sieves):
        found, n = sieve[places[0]], min(64, len(languages) - 64 * k)
        for at in places[1:]:
            found = found & sieve[at]
        if found.dtype == np.uint8:
            masks = np.bincount(found, minlength=1 << n)
            hits += (masks @ ((np.arange(len(masks))[:, None] >> np.arange(n)) & 1)).tolist()
        else:
            hits += [int(((found >> found.dtype.type(i)) & found.dtype.type(1)).sum()) for i in range(n)]
    right = np.clip((np.array(hits) - len(h) * false) / (1 - false + 1e-9), 0, None)
    i = int(right.argmax())
    return languages[i], float(right[i] / right.sum()) if right.sum() > 0 else 1 / len(languages)


def training_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Up to about SAMPLE_TEXTS texts of each language, by a hash of doc_id and text, from the rows to learn from. Equal texts of
    one doc_id (or none) count once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(FOLDS) != HELD_OUT))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(SHORTEST, min(SAMPLE_TEXTS, ALL_TEXTS // len(counts)))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text")
    most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 20) * min(1.0, each / n)))])
    short = rows.where(F.length("text") <= SAMPLE_CHARS).withColumn("key", key)
    taken = short.where(F.pmod("key", F.lit(1 << 20)) < most[F.col("lang")]).dropDuplicates(["lang", "key"])
    taken = taken.select("lang", "text")
    out: dict[str, list[str]] = {k: [] for k in counts}
    for lang, text in sorted(zip(*[c.to_pylist() for c in taken.toArrow().columns], strict=True)):
        out[lang].append(text)
    if none := [k for k, v in out.items() if not v]:
        place = F.row_number().over(W.partitionBy("lang").orderBy("n", "key"))
        keys = rows.where(F.col("lang").isin(none)).select("lang", F.length("text").alias("n"), key.alias("key"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        for r in keys.withColumn("place", place).where(F.col("place") <= SHORTEST).collect():
            out[r.lang].append(r.text)
    return {k: sorted(v) for k, v in out.items() if v}


def predicted(docs: DataFrame, carry: bool = False) -> DataFrame:
    """lang_pred and score beside doc_id, or with carry (under added() names) beside all columns of docs."""
    held = docs.sparkSession.sparkContext.broadcast((*learn(training_sample(docs)), letter_table()))
    give_back()

    def make():
        languages, sieves, false, table = held.value

        def run(texts):
            found = [decide(letters(t.decode(), table), languages, sieves, false) if t else ("und", 0.0) for t in texts]
            return [[x for x, _ in found], [s for _, s in found]]

        return run

    return map_texts(docs, "lang_pred string, score double", make, carry)


def identify_language(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang. Returns doc_id, held_out, lang_pred, score."""
    return predicted(docs).select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a language, with all their columns."""
    return predicted(docs, carry=True).where(F.col(added(docs, "lang_pred")) != "und").select(*docs.columns)
