"""Checks on reference data; each refuses empty input, so that nothing passes for lack of rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filled(**tables: DataFrame) -> None:
    for name, df in tables.items():
        if df.isEmpty():
            raise ValueError(f"{name} is empty: nothing was checked")


def check_factors(have: DataFrame, want: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Units that one side lacks, or whose factor differs relatively by more than the tolerance."""
    _filled(have=have, want=want)
    j = have.select("category", "unit", F.col("factor").alias("have")).join(want.select("category", "unit", F.col("factor").alias("want")), ["category", "unit"], "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.abs(F.col("have") / F.col("want") - 1) > tolerance, "differs")
    return j.withColumn("problem", problem).where("problem is not null")


def check_notes_complete(entries: DataFrame, notes: DataFrame, intros: DataFrame) -> DataFrame:
    """Entries without note, notes without entry, categories without introduction."""
    _filled(entries=entries, notes=notes)
    a = entries.select("name").join(notes.select("name"), "name", "left_anti").select(F.lit("no note").alias("problem"), "name")
    b = notes.select("name").join(entries.select("name"), "name", "left_anti").select(F.lit("no entry").alias("problem"), "name")
    c = entries.select("category").distinct().join(intros.select("category"), "category", "left_anti").select(F.lit("no intro").alias("problem"), F.col("category").alias("name"))
    return a.unionByName(b).unionByName(c)


def check_instruments(instruments: DataFrame, required: DataFrame | None = None, cites: str = r"\[[^\]]+\]") -> DataFrame:
    """(model, problem): no procedures or spares, a title or step that cites no document, a required text that is absent."""
    _filled(instruments=instruments)
    texts = F.expr("concat(transform(procedures, p -> p.title), flatten(transform(procedures, p -> transform(p.steps, s -> s.text))))")
    rows = instruments.select("model", F.coalesce(F.size("procedures"), F.lit(0)).alias("np"), F.coalesce(F.size("parts"), F.lit(0)).alias("ns"), texts.alias("texts"))
    short = rows.select("model", F.explode(F.array_compact(F.array(F.when(F.col("np") <= 0, "no procedures"), F.when(F.col("ns") <= 0, "no spares")))).alias("problem"))
    bare = rows.select("model", F.explode("texts").alias("t")).where(~F.col("t").rlike(cites)).select("model", F.concat(F.lit("cites nothing: "), "t").alias("problem"))
    out = short.unionByName(bare)
    if required is not None:
        whole = rows.select("model", F.array_join("texts", "\n").alias("all"))
        lacks = required.join(whole, "model", "left").where(~F.coalesce(F.contains("all", "text"), F.lit(False))).select("model", F.concat(F.lit("lacks: "), "text").alias("problem"))
        out = out.unionByName(lacks)
    return out


def check_marks(notes: DataFrame) -> DataFrame:
    """(id, page, marks, outside) of notes with a map page -> marks (x, y as fractions of the page)."""
    _filled(notes=notes)
    pages = notes.select("id", F.explode("marks").alias("page", "list")).select("id", "page", F.explode("list").alias("m"))
    stray = ~(F.col("m.x").between(-0.01, 1.01) & F.col("m.y").between(-0.01, 1.01))
    return pages.groupBy("id", "page").agg(F.count("*").alias("marks"), F.count_if(stray).alias("outside"))


def check_categories(category_group: DataFrame) -> DataFrame:
    """Categories that stand in two groups or twice in one."""
    _filled(category_group=category_group)
    return category_group.groupBy("cat").agg(F.count("*").alias("n")).where("n > 1")


def backup_due(lists: DataFrame, backups: DataFrame, today: dt.date, days: int = 14, snooze: int = 7) -> DataFrame:
    """Books with records and no backup in the last `days` days, unless snoozed in the last `snooze` days.

    lists: (book_id, list, n). backups: (book_id, last_backup, snoozed).
    """
    filled = lists.groupBy("book_id").agg(F.sum("n").alias("n")).where("n > 0")
    b = filled.join(backups, "book_id", "left")
    late = F.col("last_backup").isNull() | (F.date_diff(F.lit(today), "last_backup") > days)
    quiet = F.coalesce(F.date_diff(F.lit(today), "snoozed") < snooze, F.lit(False))
    return b.where(late & ~quiet).select("book_id", "n", "last_backup")


def list_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """(book_id, list, n)."""
    out = None
    for name, df in lists.items():
        own = df.groupBy("book_id").agg(F.count("*").alias("n")).select("book_id", F.lit(name).alias("list"), "n")
        out = own if out is None else out.unionByName(own)
    return out
