"""What the training-data operators share: reading documents, running over whole texts in Arrow batches, tables in the shared folder."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import swept as swept
from ..sources.shared import written as written

#: Bytes of text that one call of a text function gets at most, unless a single text is longer; bytes of an Arrow batch between
#: Spark and Python, of which each task holds some on both sides.
CHUNK_BYTES, BATCH_BYTES = 2 << 20, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's bound on the bytes of an Arrow batch is lowered to BATCH_BYTES, so a Python worker's memory doesn't
    follow the length of texts."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system: the driver after it has fitted a model, a worker as it waits for
    its next task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def released(rows: Iterator) -> Iterator:
    """rows; when they end, the worker gives memory back."""
    try:
        yield from rows
    finally:
        give_back()


def in_arrow(df: DataFrame, run: Callable, schema, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow, in small batches and with memory released at the end of each task. keeps: the name of what run has kept();
    all else that the worker's earlier tasks kept goes before it starts, so workers of a later stage don't hold it."""

    def task(batches):
        forget(keeps)
        return released(run(batches))

    return small_batches(df).mapInArrow(task, schema)


def forget(but: str | None = None) -> None:
    """Drop all that was kept() in this worker under other names."""
    import gc
    import sys

    store = sys.modules["_worker_store"].__dict__ if "_worker_store" in sys.modules else {}
    gone = [k for k in store if not k.startswith("__") and k != but]
    for k in gone:
        del store[k]
    if gone:
        gc.collect()  # caches may refer to themselves


def kept(name: str, make: Callable):
    """What make() gives, made once in each Python worker and kept for its later tasks; name must say all that it depends on."""
    import gc
    import sys
    import types

    gc.set_threshold(500_000, 50, 100)  # such caches hold no cycles; collections would walk them again and again
    store = sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold at most that many bytes; a longer text makes a slice of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def added(docs: DataFrame, name: str) -> str:
    """A name for a column beside those of docs: with as many underscores before it as make it new."""
    there = {c.lower() for c in docs.columns}
    name = f"_{name}"
    while name.lower() in there:
        name = f"_{name}"
    return name


def row_hash(docs: DataFrame):
    """A hash of all columns; those with maps in them, which have no hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])


def map_texts(docs: DataFrame, schema: str, make: Callable[[], Callable[[list], list]], carry: bool = False, keeps: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id and the columns of schema; or with carry all columns of docs and those of schema,
    these under their added() names. make() runs once in each task and returns the function from a list of UTF-8 texts
    (bytes, None for null) to the list of columns; keeps is as for in_arrow."""
    spark = docs.sparkSession
    source = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made, stay = spark.createDataFrame([], schema).schema, [f for f in source.schema.fields if carry or f.name == "doc_id"]
    out = T.StructType(stay + [T.StructField(added(docs, f.name) if carry else f.name, f.dataType) for f in made.fields])
    kinds, at, places = to_arrow_schema(made).types, source.columns.index("text"), [source.columns.index(f.name) for f in stay]

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, at):
                columns = f(part.column(at).cast(pa.binary()).to_pylist())
                arrays = [part.column(i) for i in places] + [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return in_arrow(source, run, out, keeps)


def fold(folds: int):
    """The remainder of CRC-32 of doc_id as text (a null doc_id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: ASCII letters to lower case, other ASCII than letters and digits to spaces, the bytes of other characters unchanged.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return (text or b"").translate(WORD_BYTES).split()


def bare_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row (what lies between ASCII whitespace), and their number in each text. A null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    counts, words = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not filled.all():  # what lies before leading and behind trailing spaces
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[filled], minlength=len(counts))
        words = words.filter(pa.array(filled))
    return words, counts


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """bare_words, and two 64-bit hashes of each word."""
    import xxhash

    words, counts = bare_words(texts)
    coded = words.dictionary_encode()
    known = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.binary()).to_pylist()))
    return words, counts, np.frombuffer(known, ">u8").astype(np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]
