"""Archives of signed-off books, written in two phases.

Tables are first staged beside the archive's place, each whole or not at all. When all are there the staging folder takes the
archive's name in one rename, and a record says that the archive is complete. A sign-off that fails on the way leaves no
archive and no book cleared; called again, it goes on with the tables that are not staged yet.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import file_system, read_text, write_text

PLAN, RECORD = "PLAN", "ARCHIVE"


def _exists(spark: SparkSession, path: str) -> bool:
    p, store = file_system(spark, path)
    return store.exists(p)


def _read(spark: SparkSession, path: str) -> dict | None:
    return json.loads(read_text(spark, path)) if _exists(spark, path) else None


def plan_of(tables: dict[str, DataFrame], books: DataFrame) -> dict:
    """What a sign-off is to archive: the tables' names, how many books, and a checksum of which."""
    n, mark = books.agg(F.count("*"), F.bit_xor(F.xxhash64(F.col("book_id").cast("string")))).first()
    return {"tables": sorted(tables), "books": n, "mark": mark}


def stage_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("book_id").parquet(path)


def archived(spark: SparkSession, path: str) -> dict | None:
    """The record of a complete archive: its plan, and the rows of each table; None if there is none."""
    return _read(spark, f"{path.rstrip('/')}/{RECORD}")


def archive(tables: dict[str, DataFrame], book_ids: DataFrame, path: str) -> dict:
    """Archive the books' rows of each table under path and return the record; an archive of the same plan is left as it is."""
    spark, path = book_ids.sparkSession, path.rstrip("/")
    books = book_ids.select("book_id").distinct()
    plan, staging = plan_of(tables, books), f"{path}.staging"
    record = archived(spark, path)
    if record is None:
        if _exists(spark, path):
            if _read(spark, f"{path}/{PLAN}") != plan:
                raise ValueError(f"{path} holds something else")
        else:
            if _read(spark, f"{staging}/{PLAN}") != plan:
                p, store = file_system(spark, staging)
                store.delete(p, True)
                write_text(spark, f"{staging}/{PLAN}", json.dumps(plan))
            for name, df in tables.items():
                if not _exists(spark, f"{staging}/{name}/_SUCCESS"):
                    stage_table(df.join(books, "book_id", "left_semi"), f"{staging}/{name}")
            (p, store), (to, _) = file_system(spark, staging), file_system(spark, path)
            if not store.rename(p, to):
                raise OSError(f"cannot rename {staging}")
        rows = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}").count() for name, df in tables.items()}
        record = {"plan": plan, "rows": rows}
        write_text(spark, f"{path}/{RECORD}", json.dumps(record))
    if record["plan"] != plan:
        raise ValueError(f"{path} is the archive of other books or tables")
    return record
