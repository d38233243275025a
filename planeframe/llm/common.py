"""Shared helpers: the shared folder of the cluster, written intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
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
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().replace("file:/", "file:///", 1).replace("file:////", "file:///", 1).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/planeframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._planeframe_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table behind ``written(...)``; for intermediate tables that nothing reads any more."""
    path = getattr(df, "_planeframe_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def done(out: DataFrame, name: str, tables: list[DataFrame]) -> DataFrame:
    """``out`` written, the intermediate tables behind it deleted."""
    out = written(out, name)
    for t in tables:
        forget(t)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch of long texts takes: at most ``rows`` rows and 16 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``fn`` to every batch that has rows."""

    def run(it):
        for batch in it:
            if batch.num_rows:
                yield fn(batch)

    return run


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, lone surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


_held: dict = {}


def held(key: tuple, build: Callable):
    """What ``build`` makes, kept in this Python worker until another key is asked for: workers are reused, so one operator's
    model, automaton or memory must not stay while the next one fills its own."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def one_thread() -> None:
    """Keeps native libraries in Python workers from starting threads of their own."""
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "false" if name.startswith("TOK") else "1")
