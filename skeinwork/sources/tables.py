"""Test tables in the roles that the operators know: an event log of actors, places and times, texts, pages, vocabularies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which event types stand for removals and for probes; all others are saves.
DELETE, PROBE = "error", "signup"
#: Where the log is cut into eras.
BOUNDARY = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, actor, place, kind (save, delete or probe), value."""
    kind = F.when(F.col("event_type") == DELETE, "delete").when(F.col("event_type") == PROBE, "probe").otherwise("save")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("actor"),
        F.get_json_object("props", "$.k").alias("place"), kind.alias("kind"), "value",
    )


EVENT_LOG_SQL = f"""
ev AS (
  SELECT event_id AS id, ts, user_id AS actor, regexp_extract(props, '"k": *([0-9]+)', 1) AS place,
    CASE event_type WHEN '{DELETE}' THEN 'delete' WHEN '{PROBE}' THEN 'probe' ELSE 'save' END AS kind, value
  FROM events
)"""

