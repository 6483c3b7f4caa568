"""A folder that driver and executors share, for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-books-")
    if "://" not in base:
        path, store = file_system(spark, base)
        base = store.makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Spark itself finds them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a manifest."""
    p, store = file_system(spark, path)
    stream = store.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place, then renamed over what was there."""
    p, store = file_system(spark, path)
    store.mkdirs(p.getParent())
    beside, _ = file_system(spark, f"{p.getParent()}/.{uuid.uuid4().hex}")
    stream = store.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    store.delete(p, False)
    if not store.rename(beside, p):
        raise OSError(f"cannot write {path}")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written once to a new folder and read back, so that what follows starts from files."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
