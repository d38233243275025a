"""Working folders: under the shared folder that the session names in spark.checkpoint.dir, so that all machines see them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, whole with its file system, so that Spark and pyarrow mean the same place.

    A cluster must name one. Where it is unset and Spark runs in this process alone (local mode, as in tests), a new local folder is set for the session."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="planeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/planeframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is evaluated once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._planeframe_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table behind ``written(...)``."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._planeframe_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
