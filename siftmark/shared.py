"""The folder that driver and executors share, tables in it, and joins with tables whose size is checked."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, as in tests, one in the warehouse,
    which they share as well."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_shared_path() named, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, so that a lost executor takes nothing with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, computed and kept as a table in the shared folder, and the table's path: to be read by column, or removed."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def join_small(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """df joined with a table that is broadcast only if it has been counted to have at most most_rows rows."""
    small = cut(small)
    return df.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)
