"""CSV, JSON and calendar files of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ics_escape, ics_fold
from .archive import archive
from .documents import read_documents
from .records import read_named

CRLF = "\r\n"
DAY = "dd-MMM-yyyy"
SHEET = ("Due Date", "Job", "Priority", "Status", "Date Completed", "Remarks", "Weekly Report", "RA", "PTW", "Permit Type", "Interval")
QUOTED = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # quotes doubled, spaces kept
PART_ROWS = 20_000  # records of a book in one backup document, about


# --- jobs ---------------------------------------------------------------------------------------------------


def _yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "yes", F.lit(False))


def parse_jobs_csv(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Text columns of a job sheet to jobs; columns that are missing take defaults.

    A byte-order mark before the first name is dropped. Any column named `... Planner` is the planner flag.
    """
    names = {c.lstrip("﻿").strip(): F.col(f"`{c}`") for c in raw.columns}
    planner = next((c for n, c in names.items() if n.endswith("Planner")), F.lit(None).cast("string"))

    def get(name: str) -> Column:
        return names.get(name, F.lit(None).cast("string"))

    def day(name: str) -> Column:
        return F.try_to_date(F.nullif(F.trim(get(name)), F.lit("")), DAY)

    code = F.regexp_extract(F.coalesce(get("Interval"), F.lit("")), r"^(\S*)", 1)
    out = raw.select(
        *(keep or []),
        F.trim(get("Job")).alias("job"), day("Due Date").alias("due"), F.coalesce(F.nullif(F.lower(F.trim(get("Priority"))), F.lit("")), F.lit("normal")).alias("priority"),
        F.coalesce(F.trim(get("Status")) == "Completed", F.lit(False)).alias("done"), day("Date Completed").alias("date_completed"), F.coalesce(get("Remarks"), F.lit("")).alias("remarks"),
        _yes(get("Weekly Report")).alias("weekly_report"), _yes(planner).alias("planner"), _yes(get("RA")).alias("ra"), _yes(get("PTW")).alias("ptw"),
        F.coalesce(get("Permit Type"), F.lit("")).alias("ptw_type"), code.alias("repeat"),
    )
    return out.where("job <> ''")


def read_jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Job sheets with `source`, the file each row is from.

    Files may differ in their columns, of which they may have any number: a file's first record names them, and its
    rows are read by those names. Of columns with one name the first counts; short rows have no value in the columns
    that they lack.
    """
    rows = read_named(spark, path)
    planner = F.try_element_at(F.filter("names", lambda x: x.endswith("Planner")), F.lit(1))

    def cell(name: Column) -> Column:
        return F.try_element_at("cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int"))

    named = rows.select("source", *(cell(F.lit(c)).alias(c) for c in SHEET), cell(planner).alias("Planner"))
    return parse_jobs_csv(named, keep=["source"])


def jobs_csv_rows(jobs: DataFrame, repeat_days: DataFrame) -> DataFrame:
    def yes(c: str) -> Column:
        return F.when(F.col(c), "Yes").otherwise("No")

    def day(c: str) -> Column:
        return F.coalesce(F.date_format(c, DAY), F.lit(""))

    j = jobs.join(repeat_days, jobs["repeat"] == repeat_days["code"], "left")
    label = F.coalesce(F.concat(F.col("repeat"), F.lit(" ("), F.col("days").cast("string"), F.lit(" days)")), F.lit(""))
    return j.select(
        "book_id", "id", day("due").alias("Due Date"), F.col("job").alias("Job"), F.col("priority").alias("Priority"), F.when(F.col("done"), "Completed").otherwise("Pending").alias("Status"),
        day("date_completed").alias("Date Completed"), F.col("remarks").alias("Remarks"), yes("weekly_report").alias("Weekly Report"), yes("planner").alias("Planner"), yes("ra").alias("RA"), yes("ptw").alias("PTW"),
        F.col("ptw_type").alias("Permit Type"), label.alias("Interval"),
    )


def write_jobs_csv(jobs: DataFrame, repeat_days: DataFrame, path: str) -> None:
    jobs_csv_rows(jobs, repeat_days).drop("id").write.partitionBy("book_id").csv(path, **QUOTED)


# --- calendar -----------------------------------------------------------------------------------------------


def calendar_events(jobs: DataFrame) -> DataFrame:
    """(book_id, id, event): an all-day event for each pending, dated job, lines folded."""
    what = F.concat(F.lit("Priority: "), F.initcap("priority"), F.when(F.col("remarks") != "", F.concat(F.lit("\nRemarks: "), "remarks")).otherwise(""))
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id", F.lit("@"), F.col("book_id").cast("string"), F.lit(".opsbook")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("due", "yyyyMMdd")),
        F.concat(F.lit("SUMMARY:"), ics_escape(F.col("job"))), F.concat(F.lit("DESCRIPTION:"), ics_escape(what)), F.lit("END:VEVENT"),
    ]
    return jobs.where("not done and due is not null").select("book_id", "id", F.array_join(F.array(*(ics_fold(x) for x in lines)), CRLF).alias("event"))


def write_ics(jobs: DataFrame, path: str, stamp: str = "20240101T000000Z") -> None:
    """A calendar file per book; its events are rows that one task writes one after another, never one value."""
    events = calendar_events(jobs).withColumn("event", F.replace("event", F.lit(CRLF + "DTSTART"), F.lit(f"{CRLF}DTSTAMP:{stamp}{CRLF}DTSTART")))
    head = CRLF.join(["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//opsbook//jobs//EN"])
    ends = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("place"), F.lit("END:VCALENDAR").alias("value")))).alias("e")
    frame = events.select("book_id").distinct().select("book_id", ends).select("book_id", "e.*")
    rows = events.select("book_id", F.lit(1).alias("place"), F.col("event").alias("value")).unionByName(frame)
    rows.repartition("book_id").sortWithinPartitions("book_id", "place", "value").drop("place").write.partitionBy("book_id").option("lineSep", CRLF).text(path)


# --- ledgers ------------------------------------------------------------------------------------------------


def ledger_flat_rows(lists: dict[str, DataFrame]) -> DataFrame:
    """One table of all lists: book_id, list, id, name, then every other column by name as text."""
    out = None
    for name, df in lists.items():
        own = df.select("book_id", F.lit(name).alias("list"), *(F.col(c).cast("string").alias(c) for c in df.columns if c != "book_id"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    first = ["book_id", "list", "id", "name"]
    if "name" not in out.columns:
        out = out.withColumn("name", F.lit(None).cast("string"))
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def write_ledger_csv(lists: dict[str, DataFrame], path: str) -> None:
    ledger_flat_rows(lists).write.partitionBy("book_id").csv(path, **QUOTED)


def backup_documents(lists: dict[str, DataFrame], app: str = "opsbook", version: int = 1, settings: DataFrame | None = None) -> DataFrame:
    """(book_id, part, document): each book's lists, and its settings (book_id, …; one row) in part 0, as JSON documents.

    A book of more than PART_ROWS records is dealt in parts by a hash of its records, so no value holds a large
    book; reading explodes them all.
    """
    rows = None
    for name, df in lists.items():
        row = F.to_json(F.struct(*(c for c in df.columns if c != "book_id")))
        own = df.select("book_id", F.lit(name).alias("list"), row.alias("row"))
        rows = own if rows is None else rows.unionByName(own)
    parts = rows.groupBy("book_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    rows = rows.join(parts, "book_id").withColumn("part", F.pmod(F.xxhash64("list", "row"), "parts").cast("int"))
    per_list = rows.groupBy("book_id", "part", "list").agg(F.array_join(F.sort_array(F.collect_list("row")), ",").alias("rows"))
    part = F.concat(F.lit('"'), "list", F.lit('":['), "rows", F.lit("]"))
    whole = per_list.groupBy("book_id", "part").agg(F.array_join(F.sort_array(F.collect_list(part)), ",").alias("data"))
    head = F.concat(F.lit(f'{{"app":"{app}","version":{version},"book_id":'), F.col("book_id").cast("string"))
    if settings is not None:
        own = settings.select("book_id", F.lit(0).alias("part"), F.to_json(F.struct(*(c for c in settings.columns if c != "book_id"))).alias("s"))
        whole = whole.join(own, ["book_id", "part"], "full_outer").withColumn("data", F.coalesce("data", F.lit("")))
        head = F.concat(head, F.when(F.col("s").isNull(), "").otherwise(F.concat(F.lit(',"settings":'), "s")))
    return whole.select("book_id", "part", F.concat(head, F.lit(',"data":{'), "data", F.lit("}}")).alias("document"))


def write_backup_json(lists: dict[str, DataFrame], path: str, settings: DataFrame | None = None) -> None:
    backup_documents(lists, settings=settings).select(F.col("document").alias("value")).write.text(path)


def parse_backups(documents: DataFrame, schemas: dict[str, str], settings: str | None = None) -> dict[str, DataFrame]:
    """Documents back to one DataFrame per list, and `settings` if their fields are given; a list that a document lacks
    gives no rows."""
    data = ", ".join(f"{name}: array<struct<{schema}>>" for name, schema in schemas.items())
    own = f"settings: struct<{settings}>, " if settings else ""
    read = documents.select(F.from_json("document", f"struct<app: string, version: int, book_id: bigint, {own}data: struct<{data}>>").alias("d"))
    out = {n: read.select(F.col("d.book_id").alias("book_id"), F.explode(f"d.data.{n}").alias("r")).select("book_id", "r.*") for n in schemas}
    if settings:
        out["settings"] = read.where("d.settings is not null").select(F.col("d.book_id").alias("book_id"), "d.settings.*")
    return out


def read_backup_json(spark: SparkSession, path: str, schemas: dict[str, str], settings: str | None = None) -> dict[str, DataFrame]:
    """Backups of files with any number of documents, each on a line or over several; large files are read by splits."""
    return parse_backups(read_documents(spark, path), schemas, settings)


# --- instruments --------------------------------------------------------------------------------------------

INSTRUMENT_FORMAT = "opsbook-instruments"
INSTRUMENT = (
    "model: string, serial: string, location: string, sensors: string, notes: string, parts: array<struct<name: string, partNo: string, qty: string>>, "
    "procedures: array<struct<title: string, steps: array<struct<text: string>>>>"
)


def parse_instruments(documents: DataFrame, accept: str = INSTRUMENT_FORMAT) -> DataFrame:
    """Instruments of the documents of the accepted format; others and rubbish add no rows."""
    doc = F.from_json("value", f"struct<format: string, version: string, source: string, instruments: array<struct<{INSTRUMENT}>>>")
    rows = documents.select(doc.alias("d")).where(F.col("d.format") == accept)
    return rows.select(F.col("d.source").alias("source"), F.explode("d.instruments").alias("i")).select("source", "i.*")


def read_instruments_json(spark: SparkSession, path: str, accept: str = INSTRUMENT_FORMAT) -> DataFrame:
    return parse_instruments(spark.read.text(path, wholetext=True), accept)


# --- sign-off -----------------------------------------------------------------------------------------------


def sign_off(tables: dict[str, DataFrame], book_ids: DataFrame, path: str, keep: tuple[str, ...] = ("birthdays",)) -> dict[str, DataFrame]:
    """Archive these books, a folder per table, and return what stays: other books, and the kept tables whole.

    Nothing is returned before the archive is complete, so rows go only once they are recorded. After a failure the
    same call goes on where it stopped; a call for other books or tables needs another path.
    """
    archive(tables, book_ids, path)
    return {n: df if n in keep else df.join(book_ids, "book_id", "left_anti") for n, df in tables.items()}
