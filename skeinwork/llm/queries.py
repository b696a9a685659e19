"""One query for each operator, over its whole tables with production parameters, and SQL where SQL can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction, fingerprints, language, licences, media, neardup, packing, pieces, runs, search, sharding, substrings, toxicity
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), similar=False)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_media(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(documents(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(runs.with_planted_tails(documents(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licences, op2_sharding, op3_neardup, op4_substrings, op5_pieces, op6_packing, op7_media, op8_toxicity, op9_fingerprints, op10_language, op11_search, op12_extraction, op13_runs)
}
ORACLE_SQL: dict[str, str] = {"op2_sharding": sharding.ORACLE_SQL, "op4_substrings": substrings.ORACLE_SQL, "op9_fingerprints": fingerprints.ORACLE_SQL, "op11_search": search.ORACLE_SQL, "op13_runs": runs.ORACLE_SQL}
