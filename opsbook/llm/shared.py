"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []  # folders and files that this session has made
_own: list[str] = []  # the folder of a local session that names none


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Spark itself finds them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, with its scheme; only a local session without one gets a folder of its own.

    A folder named without a scheme is in the default file system, for Spark and for tasks that write files alike.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        folder = _own[0]
    if "://" not in folder:
        path, store = _hadoop_path(spark, folder)
        folder = store.makeQualified(path).toString()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove(spark: SparkSession, path: str) -> None:
    p, store = _hadoop_path(spark, path)
    store.delete(p, True)


def mark() -> int:
    """Where sweep() may begin: what this session has written so far."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Remove what was written since the mark. Call it once results have been written elsewhere: they are read from there."""
    for path in _written[since:]:
        remove(spark, path)
    del _written[since:]


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once and read it back: later stages and retries start from the files."""
    return cut_at(df, new_path(df.sparkSession, name), **options)


def cut_at(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SAME_STORE = {"s3a": "s3", "s3n": "s3"}  # Hadoop's names of a store to those of pyarrow


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for tasks that write or range-read binary files."""
    scheme, _, rest = uri.partition(":")
    if not rest:
        return fs.FileSystem.from_uri(uri)
    scheme = SAME_STORE.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}")


def file_folder(spark: SparkSession, name: str) -> str:
    """A new path for binary files; a shared folder in a store that tasks cannot open is refused before any work."""
    at = new_path(spark, name)
    try:
        open_store(at)
    except (OSError, ValueError, NotImplementedError) as e:
        raise ValueError(f"files cannot be written to {at}: {e}") from e
    return at


def write_file(uri: str, parts: list[bytes]) -> None:
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def whole_groups(batches: Iterator[pd.DataFrame], key: str, rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Regroup batches sorted by key so that no key is divided between two frames.

    A frame holds about `rows` rows; only a key with more rows than that makes a larger one.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows or held[0][key].iloc[0] == batch[key].iloc[-1]:
            continue
        whole = pd.concat(held, ignore_index=True)
        first = int(whole[key].searchsorted(whole[key].iloc[-1]))
        if first:
            yield whole.iloc[:first]
            whole = whole.iloc[first:]
        held, n = [whole], len(whole)
    if held:
        yield pd.concat(held, ignore_index=True)
