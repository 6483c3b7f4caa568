"""Cargo readings and instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("top", "mid", "bot", "sump", "sound")


def explode_tanks(cargo: DataFrame) -> DataFrame:
    """Entries with a map tank -> {field -> value} to rows (…, tank, side, level, value); only sided fields have a side."""
    rows = cargo.select("book_id", "date", "time", F.explode("tanks").alias("tank", "fields")).select("book_id", "date", "time", "tank", F.explode("fields").alias("field", "value"))
    side = F.regexp_extract("field", "^(port|stbd)(?=[A-Z])", 1)
    level = F.when(side != "", F.lower(F.regexp_replace("field", "^(port|stbd)", ""))).otherwise(F.col("field"))
    return rows.select("book_id", "date", "time", "tank", F.nullif(side, F.lit("")).alias("side"), level.alias("level"), "value")


def latest_reading(readings: DataFrame) -> DataFrame:
    """The last value written of each (book, date, hour, tank, field)."""
    return readings.groupBy("book_id", "date", "hour", "tank", "field").agg(F.max_by("value", "seq").alias("value"))


def upsert_cargo(current: DataFrame, incoming: DataFrame, overwrite: bool | Column = True) -> DataFrame:
    """One entry per (book, date, time): an accepted incoming entry replaces the old one whole, a declined one does not."""
    accept = F.lit(overwrite) if isinstance(overwrite, bool) else overwrite
    cols = current.columns
    rows = current.withColumn("_rank", F.lit(1)).unionByName(incoming.withColumn("_rank", F.when(accept, 2).otherwise(0)))
    return rows.groupBy("book_id", "date", "time").agg(F.max_by(F.struct(*cols), "_rank").alias("r")).select("r.*")


def instrument_counts(instruments: DataFrame) -> DataFrame:
    steps = F.aggregate("procedures", F.lit(0), lambda n, p: n + F.coalesce(F.size(p["steps"]), F.lit(0)))
    return instruments.select("model", "serial", F.size("procedures").alias("procedures"), steps.alias("steps"), F.size("parts").alias("spares"))


def explode_instruments(instruments: DataFrame) -> DataFrame:
    """A row per step, numbered from 1 in its procedure."""
    p = instruments.select("model", "serial", F.posexplode("procedures").alias("procedure_no", "p"))
    return p.select("model", "serial", (F.col("procedure_no") + 1).alias("procedure_no"), F.col("p.title").alias("title"), F.posexplode("p.steps").alias("step_no", "s")).select(
        "model", "serial", "procedure_no", "title", (F.col("step_no") + 1).alias("step_no"), F.col("s.text").alias("text")
    )


def duplicate_instrument(instruments: DataFrame, ids: DataFrame) -> DataFrame:
    """instruments and a copy of each of ids: same content and photos, no serial, `(copy)` after the model."""
    copies = instruments.join(ids, "id", "left_semi").withColumns({"id": F.concat("id", F.lit("-copy")), "model": F.concat("model", F.lit(" (copy)")), "serial": F.lit("")})
    return instruments.unionByName(copies)
