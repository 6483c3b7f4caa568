"""Jobs: the planner, import, repeats and ticks. Every key starts with book_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def planner_day() -> Column:
    """Open jobs are planned for their due date; closed ones stand on the day they were done."""
    return F.when(F.col("done"), F.coalesce("date_completed", "due")).otherwise(F.col("due"))


def planner_rows(jobs: DataFrame, extras: DataFrame) -> DataFrame:
    """Closed jobs, ticked open jobs and extras, each with its day."""
    own = jobs.where(F.col("done") | F.col("planner")).select(
        "book_id", "id", "job", planner_day().alias("day"), "ra", "ptw_type", "remarks", F.lit(False).alias("extra")
    )
    more = extras.select("book_id", "id", "job", F.col("date").alias("day"), "ra", "ptw_type", "remarks", F.lit(True).alias("extra"))
    return own.unionByName(more).where("day is not null")


def number_rows(df: DataFrame, keys: list[str], order: list, start: int = 1, name: str = "no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))


def planner_export(rows: DataFrame, standing: DataFrame) -> DataFrame:
    """Numbered planner rows from 4; standing values on all rows, the daily one on a day's first row only.

    standing: (book_id, ship, watch, level), one row a book.
    """
    numbered = number_rows(rows, ["book_id", "day"], ["id"], start=4)
    return numbered.join(standing, "book_id", "left").withColumn("level", F.when(F.col("no") == 4, F.col("level")))


def filter_jobs(jobs: DataFrame, status: str = "all", priority: str = "all", text: str = "") -> DataFrame:
    """Status and priority filters and case-insensitive text in title or remarks; daily jobs are elsewhere."""
    out = jobs.where(F.coalesce("repeat", F.lit("")) != "daily")
    if status != "all":
        out = out.where(F.col("done") if status == "done" else ~F.col("done"))
    if priority != "all":
        out = out.where(F.col("priority") == priority)
    if text:
        low = F.lit(text.lower())
        out = out.where(F.lower("job").contains(low) | F.lower(F.coalesce("remarks", F.lit(""))).contains(low))
    return out


def order_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("done", F.col("due").asc_nulls_last(), "serial", "id")


def jobs_from_work_done(entries: DataFrame) -> DataFrame:
    """Work typed into the weekly report: a job already closed on its date."""
    return entries.select(
        "book_id", "id", "job", F.col("date").alias("due"), F.lit("normal").alias("priority"), "remarks", F.lit(True).alias("weekly_report"),
        "ra", "ptw_type", F.lit(True).alias("done"), F.col("date").alias("date_completed"),
    )


def edit_status(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (book_id, id, done, ptw) edits, null meaning unchanged; re-opening drops the date, clearing the permit its type."""
    e = edits.select("book_id", "id", F.col("done").alias("_done"), F.col("ptw").alias("_ptw"))
    out = jobs.join(e, ["book_id", "id"], "left").withColumns({"done": F.coalesce("_done", "done"), "ptw": F.coalesce("_ptw", "ptw")})
    return out.withColumns({
        "date_completed": F.when(F.col("done"), F.col("date_completed")), "ptw_type": F.when(F.col("ptw"), F.col("ptw_type")).otherwise(""),
    }).drop("_done", "_ptw")


def import_jobs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose (book, job, due) is new, once each; an empty due matches an empty due."""
    have = current.select(F.col("book_id").alias("_b"), F.col("job").alias("_j"), F.col("due").alias("_d"))
    same = F.col("book_id").eqNullSafe(F.col("_b")) & F.col("job").eqNullSafe(F.col("_j")) & F.col("due").eqNullSafe(F.col("_d"))
    return incoming.dropDuplicates(["book_id", "job", "due"]).join(have, same, "left_anti")


def import_counts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(book_id, imported, duplicates)."""
    new = import_jobs(current, incoming).groupBy("book_id").agg(F.count("*").alias("imported"))
    total = incoming.groupBy("book_id").agg(F.count("*").alias("n"))
    n = F.coalesce("imported", F.lit(0))
    return total.join(new, "book_id", "left").select("book_id", n.alias("imported"), (F.col("n") - n).alias("duplicates"))


def raise_next(jobs: DataFrame, repeat_days: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """The next occurrence of each closed repeating job, due so many days after it was done.

    children: (book_id, parent_id) of occurrences raised before; a job that has one raises no second.
    """
    closed = jobs.where("done and date_completed is not null").join(repeat_days, jobs["repeat"] == repeat_days["code"])
    new = closed.select(
        "book_id", F.concat(F.col("id"), F.lit("+")).alias("id"), F.col("id").alias("parent_id"), "job", F.expr("date_add(date_completed, days)").alias("due"),
        "priority", "remarks", "weekly_report", "planner", "ra", "ptw", "ptw_type", "repeat", F.lit(False).alias("done"),
    )
    return new if children is None else new.join(children, ["book_id", "parent_id"], "left_anti")


def apply_ticks(jobs: DataFrame, ticks: DataFrame) -> DataFrame:
    """Queued (book_id, id, done, seq) changes, the last of each job; ids that no job has are dropped."""
    last = ticks.groupBy("book_id", "id").agg(F.max_by("done", "seq").alias("_tick"))
    return jobs.join(last, ["book_id", "id"], "left").withColumn("done", F.coalesce("_tick", "done")).drop("_tick")


def search_notes(entries: DataFrame, text: str) -> DataFrame:
    """Entries of all categories with the text in their title or body."""
    return entries.where(F.lower(F.concat_ws(" ", "title", "body")).contains(text.lower()))


def order_notes(notes: DataFrame) -> DataFrame:
    return notes.orderBy(F.desc("pinned"), F.lower("title"), "doc_id")
