"""Tables in the folder that driver and executors share."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder of our own beside the warehouse. On a cluster
    it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there. options: of the writer. The table is deleted
    as the driver ends: Hadoop's file systems do so for paths that they are told when they are closed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def swept(df: DataFrame) -> DataFrame:
    """df, a written table. Spark deletes the files of exchanges that nothing refers to any more when the driver's garbage is
    collected, which is no more frequent the larger they are: that is done here."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df
