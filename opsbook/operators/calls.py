"""Port calls and the checklist jobs they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = {"arrival": "Arrival", "departure": "Departure", "lastmin": "Last minute", "takingover": "Taking over"}


def call_day() -> Column:
    """A last-minute call is one day before its arrival; others stand on their date."""
    return F.when((F.col("kind") == "lastmin") & F.col("arrival").isNotNull(), F.date_sub("arrival", 1)).otherwise(F.col("date"))


def _remarks() -> Column:
    name = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in NAMES.items()), F.col("kind"))
    return F.concat(name, F.when(F.col("arrival").isNotNull(), F.concat(F.lit(", arrival "), F.date_format("arrival", "dd-MMM-yyyy"))).otherwise(""))


def expand_calls(calls: DataFrame, checklist: DataFrame) -> DataFrame:
    """A job for each call and item of its kind's checklist."""
    rows = calls.join(checklist.select("kind", "seq", "item", "ra", "ptw"), "kind")
    title = F.when(F.coalesce("port", F.lit("")) != "", F.concat(F.col("item"), F.lit(" — "), F.col("port"))).otherwise(F.col("item"))
    return rows.select(
        "book_id", F.concat(F.col("id"), F.lit("/"), F.col("seq").cast("string")).alias("id"), F.col("id").alias("call_id"), title.alias("job"), call_day().alias("due"),
        _remarks().alias("remarks"), "ra", "ptw", F.lit(False).alias("done"), F.lit(None).cast("date").alias("date_completed"),
    )


def accept_calls(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming calls whose (book, port in any case, date, kind) is new; of equal ones, the smallest id. Nulls are equal."""
    key = ["book_id", "_port", "date", "kind"]
    have = current.select(F.col("book_id").alias("_b"), F.lower("port").alias("_p"), F.col("date").alias("_d"), F.col("kind").alias("_k")).distinct()
    once = incoming.withColumn("_port", F.lower("port")).groupBy(key).agg(F.min_by(F.struct(*incoming.columns), "id").alias("_r"))
    same = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(key, have.columns)]
    return once.join(have, same[0] & same[1] & same[2] & same[3], "left_anti").select("_r.*")


def redate_calls(jobs: DataFrame, calls: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (book_id, call_id, date, arrival) changes: open jobs move and say so, completed ones stay."""
    new = changes.select("book_id", F.col("call_id"), F.col("date").alias("_date"), F.col("arrival").alias("_arrival"))
    kinds = calls.select("book_id", F.col("id").alias("call_id"), "kind").join(new, ["book_id", "call_id"])
    moved = kinds.select("book_id", "call_id", "kind", F.col("_date").alias("date"), F.col("_arrival").alias("arrival"))
    moved = moved.select("book_id", "call_id", call_day().alias("_due"), _remarks().alias("_remarks"))
    open_ = F.col("_due").isNotNull() & ~F.col("done")
    out = jobs.join(moved, ["book_id", "call_id"], "left")
    return out.withColumns({"due": F.when(open_, F.col("_due")).otherwise(F.col("due")), "remarks": F.when(open_, F.col("_remarks")).otherwise(F.col("remarks"))}).drop("_due", "_remarks")


def remove_calls(jobs: DataFrame, calls: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, calls) without the calls of ids (book_id, call_id) and without their open jobs."""
    gone = ids.select("book_id", "call_id", F.lit(False).alias("done"))
    return jobs.join(gone, ["book_id", "call_id", "done"], "left_anti"), calls.join(ids.select("book_id", F.col("call_id").alias("id")), ["book_id", "id"], "left_anti")


def call_progress(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    n = jobs.groupBy("book_id", "call_id").agg(F.count_if("done").alias("k"), F.count("*").alias("n"))
    rows = calls.select("book_id", F.col("id").alias("call_id")).join(n, ["book_id", "call_id"], "left")
    k, n_ = F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0))
    return rows.select("book_id", "call_id", F.concat(k.cast("string"), F.lit(" of "), n_.cast("string"), F.lit(" done")).alias("progress"))
