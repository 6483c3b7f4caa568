"""Stored payloads and the rows that point at them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USERS = ("jobs", "extras", "notes", "instruments", "archives", "forms")


def orphan_media(media: DataFrame, references: dict[str, list[DataFrame]], now: dt.date, grace_days: int = 7) -> DataFrame:
    """Refs of stored payloads that nothing points at and that are older than the undo period.

    references: for each kind of user, DataFrames with one column `ref`. All kinds must be named, with an
    empty list if there are none: a kind left out would delete what it uses. Payloads take no part in the join.
    """
    if set(references) != set(USERS):
        raise ValueError(f"references must name exactly {', '.join(USERS)}")
    own = media.where(F.col("stored") < F.lit(now - dt.timedelta(days=grace_days))).select("ref")
    used = None
    for df in (d for group in references.values() for d in group):
        used = df.select("ref") if used is None else used.unionByName(df.select("ref"))
    return own if used is None else own.join(used.distinct(), "ref", "left_anti")


def externalise_media(df: DataFrame, key: list[str], col: str) -> tuple[DataFrame, DataFrame]:
    """Inline image values of an array column become refs; returns the rows and the (ref, payload) table."""
    inline = F.col("v").startswith("data:image")
    parts = df.select(*key, F.posexplode_outer(col).alias("pos", "v"))
    ref = F.when(inline, F.concat(F.lit("p:"), F.sha2("v", 256))).otherwise(F.col("v"))
    back = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", ref.alias("ref"))))).alias("s"))
    rows = df.drop(col).join(back.select(*key, F.col("s.ref").alias(col)), key)
    return rows, parts.where(inline).select(ref.alias("ref"), F.col("v").alias("payload")).dropDuplicates(["ref"])
