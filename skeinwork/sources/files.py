"""Files with declared schemas, checksums, count reconciliation, and sinks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVISIONS = (
    "rev_id string, page_key string, wiki string, name string, seq long, label string, ip16 string, time timestamp, time_grade string, uncertainty_seconds double, body_len long, body_sha256 string, lines long, change_summary string, body string, hunks string, write_date timestamp, archived_at timestamp"
)
PAGES = ("wiki string, name string, page_key string, page_family string, first_write timestamp, last_write timestamp")
LABELS = ("label string, first_write timestamp, last_write timestamp")
EVENTS = ("event_type string, time timestamp, request_time timestamp, success_time timestamp, recent_changes_time timestamp, page_key string, page string, wiki string, relation_type string")
MANIFEST = (
    "generated_at string, counts map<string, struct<value: long>>, per_wiki map<string, struct<revisions: struct<value: long>, pages: struct<value: long>>>, population_counts map<string, struct<kind: string, value: long>>, checks array<struct<name: string, ok: boolean>>"
)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (the text), row (a struct of schema) and broken of each line that isn't blank: broken where it is no JSON object. A
    value of another kind than declared is null, and breaks no line."""
    fields = spark.createDataFrame([], schema).schema.add("_corrupt", "string")
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    rows = lines.withColumn("row", F.from_json("line", fields, {"columnNameOfCorruptRecord": "_corrupt"}))
    unread = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    # what couldn't be read in full is looked at again, to tell a value from a line
    broken = F.when(unread, ~F.ltrim("line").startswith("{") | F.try_parse_json("line").isNull()).otherwise(False)
    return rows.select("file", "line", F.struct(*[F.col(f"row.{f.name}").alias(f.name) for f in fields if f.name != "_corrupt"]).alias("row"), broken.alias("broken"))


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line of what jsonl raises on or, if told to, leaves out: for a table of its own."""
    return json_lines(spark, path, schema).where("broken").select("file", "line")


def jsonl(spark: SparkSession, path: str, schema: str, broken: str = "raise") -> DataFrame:
    """One JSON object a line under a declared schema; blank lines are skipped, NaN becomes null. A line that is no JSON object
    raises an error with its text as soon as it is read, or is left out if broken is "leave"."""
    if broken not in ("raise", "leave"):
        raise ValueError(broken)
    lines = json_lines(spark, path, schema)
    whole = F.assert_true(~F.col("broken"), F.concat(F.lit("no JSON object in "), "file", F.lit(": "), "line")).isNull() if broken == "raise" else ~F.col("broken")
    rows = lines.where(whole).select("row.*")
    doubles = {f.name for f in rows.schema if isinstance(f.dataType, T.DoubleType)}
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in rows.columns])


def revisions(spark: SparkSession, path: str, with_body: bool = False) -> DataFrame:
    """Saves, without their bodies and hunks unless asked for."""
    rows = jsonl(spark, path, REVISIONS)
    return rows if with_body else rows.drop("body", "hunks")


def pages(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PAGES)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, LABELS)


def events(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, EVENTS)


def parse_time(text):
    """An ISO 8601 time, with Z or an offset, as a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; it is built and written first if it isn't there (whole)."""
    if not there(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """What write_json left at path; None if there is nothing."""
    return spark.read.json(path) if there(spark, path) else None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, sha256 of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_checksums(found: DataFrame, declared: DataFrame) -> DataFrame:
    """declared: name, sha256. name, ok for each declared file: false too where it is missing."""
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return declared.join(named, "name", "left").select("name", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def reconcile(rows: DataFrame, by: str, declared: DataFrame) -> DataFrame:
    """declared: key, value. key, declared, loaded, ok; counts without a declaration aren't ok."""
    loaded = rows.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("loaded"))
    both = declared.join(loaded, "key", "full_outer")
    return both.select("key", F.col("value").alias("declared"), F.coalesce("loaded", F.lit(0)).alias("loaded"), F.coalesce(F.col("value") == F.coalesce("loaded", F.lit(0)), F.lit(False)).alias("ok"))


class VerificationError(Exception):
    """Files or counts aren't what was declared; report has the rows that say so."""

    def __init__(self, what: str, report: DataFrame):
        super().__init__(f"{what}: {', '.join(str(r[0]) for r in report.limit(20).collect())}")
        self.report = report


def verify(found: DataFrame, declared: DataFrame, counts: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> DataFrame:
    """First the checksums (raises on a bad one, before anything is counted), then counts(), of reconcile: its report is written,
    then a bad count raises. Returns the report."""
    bad = verify_checksums(found, declared).where("not ok")
    if not bad.isEmpty():
        raise VerificationError("checksums differ", bad)
    report = counts()
    write(report)
    if not (off := report.where("not ok")).isEmpty():
        raise VerificationError("counts differ", off)
    return report


def failed_checks(doc: DataFrame) -> DataFrame:
    """The exporter's own checks that didn't hold."""
    return doc.select(F.explode("checks").alias("c")).where(~F.col("c.ok")).select("c.*")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become sorted values joined by |."""
    flat = [F.array_join(F.array_sort(f.name), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def plain(c, kind: T.DataType):
    """A value as JSON has it: numbers that aren't finite become null, timestamps ISO 8601 in UTC, arrays and structs the same of
    what they hold (arrays that stand for sets should be sorted before)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: plain(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[plain(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, of plain values; nulls are kept."""
    df.select(*[plain(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def scalars(df: DataFrame) -> DataFrame:
    """Values as graph files hold them: null is the empty text, arrays are sorted and joined by |; numbers stay."""

    def flat(f):
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.array_sort(c), "|")
        elif not isinstance(f.dataType, (T.NumericType, T.StringType)):
            c = c.cast("string")
        return (F.coalesce(c, F.lit("")) if not isinstance(f.dataType, T.NumericType) else c).alias(f.name)

    return df.select(*[flat(f) for f in df.schema])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph is two tables, nodes and edges, of scalars: as parquet, and as CSV for other tools."""
    for name, df in (("nodes", scalars(nodes)), ("edges", scalars(edges))):
        write_parquet(df, f"{path}/{name}")
        write_csv(df, f"{path}/{name}_csv")


def write_payload(sections: dict[str, DataFrame], path: str) -> None:
    """The sections of a page's data, each a folder of JSON lines."""
    for name, df in sections.items():
        write_json(df, f"{path}/{name}")


def inlined(template: str, sections: dict[str, DataFrame], token: str, most: int = 100_000) -> str:
    """The template with its token replaced by the sections as one JSON object of lists of rows. Raises where the token is missing, or a section
    has more than most rows: a page isn't the place for a table without a bound."""
    import json

    if token not in template:
        raise ValueError(f"the template has no {token}")
    found = {}
    for name, df in sections.items():
        rows = df.select(F.to_json(F.struct(*[plain(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]), {"ignoreNullFields": "false"}).alias("row")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {name} has more than {most} rows")
        found[name] = [json.loads(r.row) for r in rows]
    # an end tag inside a text must not end the script that holds it
    return template.replace(token, json.dumps(found, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").withColumn("weight", F.col("weight").cast("double"))
