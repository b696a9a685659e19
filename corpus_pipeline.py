"""A corpus from raw documents to packed sequences: each stage is an operator of its own, its decisions take effect.

Stages judge rows one by one but for near duplicates and substrings, and carry every column of documents, whatever else it is called.
Null and empty texts, and texts without a letter, have no language and go. A null doc_id is a document of its own; of rows that
repeat, or are alike, one stays: that with the smallest doc_id, those without one last, ties by hashes of text and row. A passage
that an earlier document has goes. Very long texts are processed whole, as slices of their own. Empty tables give no rows."""

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import language, neardup, packing, substrings, toxicity
from skeinwork.llm.common import documents, written
from skeinwork.llm.queries import tokenizer_path

#: Bytes of words that a packing worker keeps.
WORD_BYTES = 24 << 20
#: Bytes of text whose repeats a worker looks for at once: half of what the operator takes alone, as earlier stages have left their heaps.
REPEAT_BYTES = 1 << 20


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language.keep_identified(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return neardup.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go."""
    return substrings.remove_repeats(docs, carry=True, chunk_bytes=REPEAT_BYTES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. The workers of the stages before are still there: words take less of their memory."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), WORD_BYTES)


STAGES = [
    ("language", identified),
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("substrings", without_repeats),
    ("packing", packed),
]
# No SQL can say what the fitted models and the tokenizer do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir; all but the last are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
