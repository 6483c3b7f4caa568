"""Weekly report: statements, numbering and photo pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import week_label, week_start
from .jobs import number_rows, planner_day


def weekly_work_done(jobs: DataFrame) -> DataFrame:
    """Weekly-flagged jobs by Monday-to-Sunday week, numbered from 1 in each book and week."""
    rows = jobs.where("weekly_report").withColumn("day", planner_day()).where("day is not null").withColumn("week", week_start(F.col("day")))
    status = F.when(F.col("done"), "COMPLETED").otherwise("NOT YET COMPLETED")
    numbered = number_rows(rows, ["book_id", "week"], ["day", "serial", "id"])
    return numbered.select("book_id", "week", "no", "id", "day", "job", status.alias("status"), F.when(F.col("ra"), "YES").otherwise("NO").alias("ra"), "ptw_type", "remarks")


def week_labels(jobs: DataFrame) -> DataFrame:
    rows = jobs.where("weekly_report").select("book_id", planner_day().alias("day")).where("day is not null")
    return rows.groupBy("book_id", week_start(F.col("day")).alias("week")).agg(F.count("*").alias("n")).withColumn("label", week_label(F.col("week")))


def report_layout(jobs: DataFrame, photos: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Pages of each week's report: the statements of all its jobs on page 1, then two photo pairs a page.

    A row of page 1 has `no`, the statement's number, and no pair; a job's caption stands on each of its pairs.
    photos: (book_id, job_id, pos, ref). override: (book_id, week, id, place), the saved order of a week, which
    statements and photos follow.
    """
    rows = jobs.where("weekly_report").withColumn("day", planner_day()).where("day is not null").withColumn("week", week_start(F.col("day")))
    if override is not None:
        rows = rows.join(override, ["book_id", "week", "id"], "left")
    else:
        rows = rows.withColumn("place", F.lit(None).cast("int"))
    order = [F.col("place").asc_nulls_last(), "day", "serial", "id"]
    said = number_rows(rows, ["book_id", "week"], order).select("book_id", "week", F.lit(1).alias("page"), "no", "id", F.col("job").alias("caption"))
    pics = photos.select("book_id", F.col("job_id").alias("id"), F.floor(F.col("pos") / 2).cast("int").alias("pair"), "pos", "ref")
    pairs = pics.groupBy("book_id", "id", "pair").agg(F.sort_array(F.collect_list(F.struct("pos", "ref"))).alias("p"))
    pairs = pairs.select("book_id", "id", "pair", F.col("p")[0]["ref"].alias("left_ref"), F.expr("try_element_at(p, 2).ref").alias("right_ref"))
    rank = F.row_number().over(Window.partitionBy("book_id", "week").orderBy(*order, "pair"))
    laid = rows.join(pairs, ["book_id", "id"]).withColumn("page", F.ceil(rank / 2).cast("int") + 1)
    laid = laid.select("book_id", "week", "page", "id", F.col("job").alias("caption"), "pair", "left_ref", "right_ref")
    pages = F.max("page").over(Window.partitionBy("book_id", "week"))
    whole = said.unionByName(laid, allowMissingColumns=True).withColumn("pages", pages)
    return whole.select("book_id", "week", "page", "pages", "no", "id", "pair", "left_ref", "right_ref", "caption")
