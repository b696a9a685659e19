"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's distinct words and five-byte beginnings of words, as 64-bit hashes. The machine has a weight for each
term and a short vector for each; the product of two vectors is the weight of the pair, so an insult beside the
mention of a group can count for more than the two add up to.

Null and empty texts have no terms: their score is that of the bias. Without rows of both classes to learn from, every
score is the share of toxic rows among those there are (0 if none). Equal texts get equal scores, ties and repeated rows
included; rows are scored one by one, so repeated or null doc_ids need no rule of their own (in learning, a doc_id's rows
all take its label, and rows without one are left out). A label counts as toxic if it is above zero, a null label as none.
Columns besides those named may have any names; an empty table gives no rows."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, fold, give_back, map_texts, words_of

#: Labelled rows that the machine may learn from: those whose remainder is not this one.
FOLDS, HELD_OUT = 5, 0
#: Rows of each class to learn from: the bound of the sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Bytes of a text to learn from at most, and of all texts of a class: with the rows above, the bound of what the driver holds.
SAMPLE_BYTES, CLASS_BYTES = 40_000, 48 << 20
#: Terms kept at most (those that tell the classes apart best), and the least chi-square of one.
MOST_TERMS, LEAST_CHI = 8192, 12.0
#: Length of a term's vector, passes over the sample, size of a step, decay of weights.
RANK, PASSES, STEP, DECAY = 4, 30, 0.1, 1e-4
BEGINNING = 5


def terms(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct terms of a text."""
    import xxhash

    words = set(words_of(text))
    words |= {b"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))


class Machine:
    """Sorted term hashes, a weight and a vector for each, and a bias."""

    def __init__(self, keys: np.ndarray, bias: float):
        self.keys, self.bias = keys, bias
        self.weights = np.zeros(len(keys))
        self.vectors = np.random.default_rng(7).normal(0, 0.01, (len(keys), RANK))

    def active(self, found: np.ndarray) -> np.ndarray:
        """Places of those terms among keys."""
        if not len(self.keys):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return at[self.keys[at] == found]

    def margin(self, at: np.ndarray) -> float:
        v = self.vectors[at]
        return float(self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum())

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.active(terms(text))), -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Keep the terms that tell the classes apart, then descend the logistic loss with per-weight step sizes."""
    n, positive = len(bags), float(labels.sum())
    if not n or positive in (0.0, float(n)):
        share = positive / n if n else 0.0
        return Machine(np.empty(0, np.uint64), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    keys, column = np.unique(np.concatenate(bags), return_inverse=True)
    row = np.repeat(np.arange(n), [len(b) for b in bags])
    seen = np.bincount(column, minlength=len(keys)).astype(float)
    toxic = np.bincount(column, weights=labels[row], minlength=len(keys))
    expected = seen * positive / n
    spread = expected * (1 - positive / n) * (1 - seen / (n + 1)) + 1e-9
    chi = (toxic - expected) ** 2 / spread
    order = np.argsort(-chi, kind="stable")[:MOST_TERMS]
    machine = Machine(np.sort(keys[order[(chi[order] >= LEAST_CHI) & (seen[order] >= 2)]]), float(np.log(positive / (n - positive))))
    active = [machine.active(b) for b in bags]
    squares_w, squares_v, square_b = np.full(len(machine.keys), 1e-8), np.full(machine.vectors.shape, 1e-8), 1e-8
    rng = np.random.default_rng(11)
    for _ in range(PASSES):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            counts = np.array([len(active[i]) for i in part])
            at = np.concatenate([active[i] for i in part]) if len(part) else np.empty(0, np.int64)
            of = np.repeat(np.arange(len(part)), counts)
            v = machine.vectors[at]
            total, power = np.zeros((len(part), RANK)), np.zeros((len(part), RANK))
            np.add.at(total, of, v)
            np.add.at(power, of, v**2)
            margin = machine.bias + np.bincount(of, weights=machine.weights[at], minlength=len(part)) + 0.5 * (total**2 - power).sum(1)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]
            grad_w = np.bincount(at, weights=error[of], minlength=len(machine.keys)) / len(part)
            grad_v = np.zeros_like(machine.vectors)
            np.add.at(grad_v, at, error[of, None] * (total[of] - v) / len(part))
            touched = np.unique(at)
            grad_w[touched] += DECAY * machine.weights[touched]
            grad_v[touched] += DECAY * machine.vectors[touched]
            squares_w[touched] += grad_w[touched] ** 2
            squares_v[touched] += grad_v[touched] ** 2
            machine.weights[touched] -= STEP * grad_w[touched] / np.sqrt(squares_w[touched])
            machine.vectors[touched] -= STEP / 4 * grad_v[touched] / np.sqrt(squares_v[touched])
            square_b += error.mean() ** 2
            machine.bias -= STEP * float(error.mean()) / np.sqrt(square_b)
    return machine


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Term hashes and labels of up to about SAMPLE_TOXIC and SAMPLE_CLEAN texts of at most SAMPLE_BYTES, by a hash of doc_id; where
    these ids have more rows or bytes than a class may have, by a hash of doc_id and text. Equal texts of one doc_id count once.
    A doc_id with several labels counts as toxic if one says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, bound = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}, {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    by_class = lambda x: F.when(F.col("toxic") == 1, F.lit(x[1])).otherwise(F.lit(x[0]))
    chosen = known.where(part < by_class({k: int((1 << 20) * min(1.0, b / max(1, n.get(k, 0)))) for k, b in bound.items()}))
    # bounded by the two sample sizes, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    labelled = texts.where(size <= SAMPLE_BYTES).withColumn("key", F.xxhash64("doc_id", "text"))
    there = {r.toxic: r for r in labelled.select("toxic", "key", size.alias("size")).distinct().groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    # chance alone gives a class a few rows more than its bound
    share = {k: min(1.0, b / r.n if r.n > 1.2 * b else 1.0, CLASS_BYTES / max(1, r["size"])) for k, b in bound.items() if (r := there.get(k))}
    labelled = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < by_class({k: int((1 << 20) * share.get(k, 1.0)) for k in bound})).dropDuplicates(["key", "toxic"])
    labelled = labelled.select(F.col("toxic").alias("doc_id"), "text")
    found = map_texts(labelled, "terms binary", lambda: lambda ts: [[terms(t).tobytes() for t in ts]]).toArrow()
    rows = sorted(zip(found.column("terms").to_pylist(), found.column("doc_id").to_pylist(), strict=True))
    return [np.frombuffer(t, np.uint64) for t, _ in rows], np.array([float(y) for _, y in rows])


def scorer(docs: DataFrame, labels: DataFrame):
    """Fits a machine; returns what map_texts needs to score with it."""
    held = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels)).__dict__)
    give_back()

    def make():
        machine = Machine.__new__(Machine)
        machine.__dict__.update(held.value)
        return lambda texts: [[machine.score(t) for t in texts]]

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. Returns doc_id, held_out, score, predicted."""
    scored = map_texts(docs, "score double", scorer(docs, labels))
    return scored.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with all their columns."""
    return map_texts(docs, "score double", scorer(docs, labels), carry=True).where(F.col(added(docs, "score")) < 0.5).select(*docs.columns)
