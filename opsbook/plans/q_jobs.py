"""Queries over jobs: planner, weekly report, agenda."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import agenda, jobs, reports
from ..sources import files, search, store
from .registry import query
from .views import view, with_views

TODAY = dt.date(1998, 6, 15)
DAY = "CASE WHEN done THEN coalesce(date_completed, due) ELSE due END"
WEEK = "CAST(date_trunc('week', day) AS DATE)"


@query(with_views(f"SELECT book_id, id, {DAY} AS day FROM jobs", "jobs"))
def q10_planner_day(spark, sf):
    return view(spark, sf, "jobs").select("book_id", "id", jobs.planner_day().alias("day"))


PLANNER = f"""SELECT book_id, id, job, {DAY} AS day, ra, ptw_type, remarks, false AS extra FROM jobs WHERE (done OR planner) AND ({DAY}) IS NOT NULL
UNION ALL SELECT book_id, id, job, date, ra, ptw_type, remarks, true FROM extras WHERE date IS NOT NULL"""


@query(with_views(PLANNER, "jobs", "extras"))
def q11_planner_rows(spark, sf):
    return jobs.planner_rows(view(spark, sf, "jobs"), view(spark, sf, "extras"))


@query(with_views("SELECT book_id, id, job, due FROM jobs WHERE repeat <> 'daily' AND NOT done AND priority = 'urgent' AND (lower(job) LIKE '%task 1%' OR lower(remarks) LIKE '%task 1%')", "jobs"))
def q12_filter_jobs(spark, sf):
    return jobs.filter_jobs(view(spark, sf, "jobs"), "pending", "urgent", "Task 1").select("book_id", "id", "job", "due")


@query(with_views("SELECT doc_id, category, title FROM search_docs WHERE lower(concat_ws(' ', title, body)) LIKE '%license%'", "search_docs"))
def q13_search_notes(spark, sf):
    return jobs.search_notes(view(spark, sf, "search_docs"), "License").select("doc_id", "category", "title")


RAW = "'x' || CAST(o_orderkey % 7 - 3 AS STRING) || '.' || CAST(o_orderkey % 1000 AS STRING) || '.' || CAST(o_orderkey % 3 AS STRING) || 'y'"


@query(f"""WITH r AS (SELECT o_orderkey, {RAW} AS raw FROM orders),
k AS (SELECT *, regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS kept FROM r), p AS (SELECT *, replace(kept, '-', '') AS plain FROM k)
SELECT o_orderkey, raw, TRY_CAST(CASE WHEN kept LIKE '-%' THEN '-' ELSE '' END || split_part(plain, '.', 1) || '.' || replace(substr(plain, length(split_part(plain, '.', 1)) + 2), '.', '') AS DOUBLE) AS number FROM p""")
def q14_clean_number(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr(RAW).alias("raw"))
    return orders.withColumn("number", text.clean_number(F.col("raw")))


WORK = "SELECT book_id, id, job, date AS due, 'normal' AS priority, remarks, true AS weekly_report, ra, ptw_type, true AS done, date AS date_completed FROM extras"


@query(with_views(WORK, "extras"))
def q19_jobs_from_work_done(spark, sf):
    return jobs.jobs_from_work_done(view(spark, sf, "extras"))


def _edits(spark, sf):
    return view(spark, sf, "jobs").where("serial % 4 = 1").select(
        "book_id", "id", F.when(F.col("serial") % 8 == 1, F.lit(False)).alias("done"), F.when(F.col("serial") % 3 == 0, F.lit(False)).alias("ptw")
    )


@query(with_views("""SELECT book_id, id, CASE WHEN serial % 8 = 1 THEN false ELSE done END AS done,
CASE WHEN (CASE WHEN serial % 8 = 1 THEN false ELSE done END) THEN date_completed END AS date_completed,
CASE WHEN serial % 4 = 1 AND serial % 3 = 0 THEN false ELSE ptw END AS ptw,
CASE WHEN (CASE WHEN serial % 4 = 1 AND serial % 3 = 0 THEN false ELSE ptw END) THEN ptw_type ELSE '' END AS ptw_type FROM jobs""", "jobs"))
def q20_edit_status(spark, sf):
    return jobs.edit_status(view(spark, sf, "jobs"), _edits(spark, sf)).select("book_id", "id", "done", "date_completed", "ptw", "ptw_type")


NEW = "SELECT DISTINCT book_id, job, due FROM jobs i WHERE serial % 2 = 1 AND NOT EXISTS (SELECT 1 FROM jobs c WHERE c.serial % 2 = 0 AND c.book_id = i.book_id AND c.job = i.job AND c.due IS NOT DISTINCT FROM i.due)"


@query(with_views(NEW, "jobs"))
def q21_import_jobs(spark, sf):
    own = view(spark, sf, "jobs")
    return jobs.import_jobs(own.where("serial % 2 = 0"), own.where("serial % 2 = 1")).select("book_id", "job", "due")


@query(with_views(f"""SELECT t.book_id, coalesce(n.imported, 0) AS imported, t.n - coalesce(n.imported, 0) AS duplicates
FROM (SELECT book_id, count(*) AS n FROM jobs WHERE serial % 2 = 1 GROUP BY 1) t LEFT JOIN (SELECT book_id, count(*) AS imported FROM ({NEW}) GROUP BY 1) n USING (book_id)""", "jobs"))
def q21_import_counts(spark, sf):
    own = view(spark, sf, "jobs")
    return jobs.import_counts(own.where("serial % 2 = 0"), own.where("serial % 2 = 1"))


@query(with_views("""SELECT j.book_id, j.id AS parent_id, j.job, j.date_completed + CAST(r.days AS INT) AS due, j.repeat FROM jobs j JOIN repeat_days r ON r.code = j.repeat
WHERE j.done AND j.date_completed IS NOT NULL AND j.serial % 10 <> 0""", "jobs", "repeat_days"))
def q22_raise_next(spark, sf):
    own = view(spark, sf, "jobs")
    children = own.where("serial % 10 = 0").select("book_id", F.col("id").alias("parent_id"))
    return jobs.raise_next(own, view(spark, sf, "repeat_days"), children).select("book_id", "parent_id", "job", "due", "repeat")


@query(with_views("""SELECT book_id, id, CASE WHEN serial % 6 = 0 THEN serial % 12 = 0 ELSE done END AS done FROM jobs""", "jobs"))
def q27_apply_ticks(spark, sf):
    own = view(spark, sf, "jobs")
    ticked = own.where("serial % 6 = 0")
    ticks = ticked.select("book_id", "id", F.lit(True).alias("done"), F.lit(1).alias("seq")).unionByName(
        ticked.select("book_id", "id", (F.col("serial") % 12 == 0).alias("done"), F.lit(2).alias("seq"))
    ).unionByName(ticked.select("book_id", F.concat(F.lit("gone"), "id").alias("id"), F.lit(True).alias("done"), F.lit(3).alias("seq")))
    return jobs.apply_ticks(own, ticks).select("book_id", "id", "done")


WEEKLY = f"""SELECT book_id, {WEEK} AS week, row_number() OVER (PARTITION BY book_id, {WEEK} ORDER BY day, serial, id) AS no, id, day, job,
CASE WHEN done THEN 'COMPLETED' ELSE 'NOT YET COMPLETED' END AS status, CASE WHEN ra THEN 'YES' ELSE 'NO' END AS ra, ptw_type, remarks
FROM (SELECT *, {DAY} AS day FROM jobs WHERE weekly_report) WHERE day IS NOT NULL"""


@query(with_views(WEEKLY, "jobs"))
def q38_weekly_work_done(spark, sf):
    return reports.weekly_work_done(view(spark, sf, "jobs"))


@query(with_views(f"SELECT *, 3 + row_number() OVER (PARTITION BY book_id, day ORDER BY id) AS no FROM ({PLANNER})", "jobs", "extras"))
def q50_number_rows(spark, sf):
    rows = jobs.planner_rows(view(spark, sf, "jobs"), view(spark, sf, "extras"))
    return jobs.number_rows(rows, ["book_id", "day"], ["id"], start=4)


@query(with_views(f"""SELECT p.*, 'Vessel ' || CAST(book_id AS STRING) AS ship, 'day' AS watch, CASE WHEN no = 4 THEN 'L' || CAST(book_id % 3 AS STRING) END AS level
FROM (SELECT *, 3 + row_number() OVER (PARTITION BY book_id, day ORDER BY id) AS no FROM ({PLANNER})) p""", "jobs", "extras"))
def q51_planner_export(spark, sf):
    own = view(spark, sf, "jobs")
    standing = own.select("book_id").distinct().select("book_id", F.concat(F.lit("Vessel "), "book_id").alias("ship"), F.lit("day").alias("watch"), F.concat(F.lit("L"), F.col("book_id") % 3).alias("level"))
    return jobs.planner_export(jobs.planner_rows(own, view(spark, sf, "extras")), standing)


LAID = f"""SELECT *, row_number() OVER (PARTITION BY book_id, week ORDER BY CASE WHEN serial % 5 = 0 THEN -serial END NULLS LAST, day, serial, id) AS no
FROM (SELECT *, {WEEK} AS week FROM (SELECT *, {DAY} AS day FROM jobs WHERE weekly_report) WHERE day IS NOT NULL)"""


@query(with_views(f"""SELECT *, max(page) OVER (PARTITION BY book_id, week) AS pages FROM (
  SELECT book_id, week, 1 AS page, no, id, NULL AS pair, NULL AS left_ref, NULL AS right_ref, job AS caption FROM ({LAID})
  UNION ALL SELECT j.book_id, week, CAST(ceil(row_number() OVER (PARTITION BY j.book_id, week ORDER BY no, pair) / 2.0) AS INT) + 1, NULL, id, p.pair, p.left_ref, p.right_ref, job
  FROM ({LAID}) j JOIN (SELECT book_id, job_id, CAST(floor(pos / 2) AS INT) AS pair, min_by(ref, pos) AS left_ref, CASE WHEN count(*) = 2 THEN max_by(ref, pos) END AS right_ref FROM photo_refs GROUP BY 1, 2, 3) p
  ON p.book_id = j.book_id AND p.job_id = j.id)""", "jobs", "photo_refs"))
def q52_report_layout(spark, sf):
    own = view(spark, sf, "jobs")
    saved = own.where("serial % 5 = 0").select("book_id", dates.week_start(jobs.planner_day()).alias("week"), "id", (-F.col("serial")).alias("place"))
    return reports.report_layout(own, view(spark, sf, "photo_refs"), saved)


LABEL = "CAST(day(x) AS STRING) || CASE WHEN day(x) BETWEEN 11 AND 13 THEN 'th' WHEN day(x) % 10 = 1 THEN 'st' WHEN day(x) % 10 = 2 THEN 'nd' WHEN day(x) % 10 = 3 THEN 'rd' ELSE 'th' END || ' ' || upper(strftime(x, '%b %Y'))"


@query(with_views(f"""SELECT book_id, week, count(*) AS n, {LABEL.replace('(x', '(week')} || ' to ' || {LABEL.replace('(x', '(week + 6')} AS label
FROM (SELECT book_id, {WEEK} AS week FROM (SELECT book_id, {DAY} AS day FROM jobs WHERE weekly_report) WHERE day IS NOT NULL) GROUP BY book_id, week""", "jobs"))
def q53_week_label(spark, sf):
    return reports.week_labels(view(spark, sf, "jobs"))


@query(with_views("SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY done, due NULLS LAST, serial, id) AS place FROM jobs", "jobs"))
def q54_order_jobs(spark, sf):
    return jobs.number_rows(view(spark, sf, "jobs"), ["book_id"], ["done", F.col("due").asc_nulls_last(), "serial", "id"], name="place").select("book_id", "id", "place")


@query(with_views("SELECT doc_id, category, pinned, row_number() OVER (PARTITION BY category ORDER BY pinned DESC, lower(title), doc_id) AS place FROM search_docs", "search_docs"))
def q54_order_notes(spark, sf):
    rows = view(spark, sf, "search_docs")
    return jobs.number_rows(rows, ["category"], [F.desc("pinned"), F.lower("title"), "doc_id"], name="place").select("doc_id", "category", "pinned", "place")


AHEAD = f"""SELECT book_id, id, job, priority, CAST(due + CAST(k * days AS INT) AS DATE) AS day FROM (
  SELECT j.book_id, j.id, j.job, j.priority, j.due, r.days, unnest(range(1, 3000)) AS k FROM jobs j JOIN repeat_days r ON r.code = j.repeat
  WHERE NOT j.done AND j.due IS NOT NULL AND j.repeat <> 'daily') WHERE due + CAST(k * days AS INT) BETWEEN DATE '1998-03-15' AND DATE '1998-09-15'"""


@query(with_views(AHEAD, "jobs", "repeat_days"))
def q60d_project_occurrences(spark, sf):
    return agenda.project_occurrences(view(spark, sf, "jobs"), view(spark, sf, "repeat_days"), dt.date(1998, 3, 15), dt.date(1998, 9, 15))


@query("""SELECT o_orderkey, CAST(d + INTERVAL 3 MONTH AS DATE) AS later, (1998 - year(d)) * 12 + 6 - month(d) AS months,
CAST(CASE WHEN day(last_day(d)) < 31 THEN last_day(d) ELSE date_trunc('month', d) + INTERVAL 30 DAY END AS DATE) AS day31, CAST(date_trunc('week', d) AS DATE) AS week
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q60a_month_functions(spark, sf):
    d = F.to_date("o_orderdate")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", dates.month_add(d, 3).alias("later"), dates.month_diff(d, F.lit(TODAY)).alias("months"), dates.day_of_month(d, 31).alias("day31"), dates.week_start(d).alias("week")
    )


@query(with_views("SELECT book_id, id, CASE WHEN repeat = 'daily' AND NOT done AND due < DATE '1998-06-15' THEN DATE '1998-06-15' ELSE due END AS due FROM jobs", "jobs"))
def q60e_roll_daily(spark, sf):
    return agenda.roll_daily(view(spark, sf, "jobs"), TODAY).select("book_id", "id", "due")


ROLLED = "SELECT * REPLACE (CASE WHEN repeat = 'daily' AND NOT done AND due < DATE '1998-06-15' THEN DATE '1998-06-15' ELSE due END AS due) FROM jobs"
AGENDA = f"""SELECT book_id, id, job, priority, done, due AS day, '' AS note, false AS forecast, repeat = 'daily' AS daily, false AS birthday FROM ({ROLLED}) WHERE due BETWEEN DATE '1998-03-15' AND DATE '1998-09-15'
UNION ALL SELECT book_id, id, job, priority, done, DATE '1998-06-15', 'overdue', false, repeat = 'daily', false FROM ({ROLLED}) WHERE NOT done AND due < DATE '1998-06-15'
UNION ALL SELECT book_id, id, job, priority, done, DATE '1998-06-15', 'no date', false, repeat = 'daily', false FROM ({ROLLED}) WHERE NOT done AND due IS NULL
UNION ALL SELECT book_id, id, job, priority, false, day, '', true, false, false FROM ({AHEAD})
UNION ALL SELECT book_id, id, job, priority, false, CAST(d AS DATE), '', true, true, false FROM ({ROLLED}) r, range(DATE '1998-03-15', DATE '1998-09-16', INTERVAL 1 DAY) t(d) WHERE repeat = 'daily' AND NOT done AND CAST(d AS DATE) > due
UNION ALL SELECT book_id, id, name, 'normal', false, CAST(d AS DATE), '', false, false, true FROM crew, range(DATE '1998-03-15', DATE '1998-09-16', INTERVAL 1 DAY) t(d) WHERE month(d) = month(dob) AND day(d) = day(dob)"""


def _agenda(spark, sf):
    crew = view(spark, sf, "crew").withColumnRenamed("name", "label")
    return agenda.build_agenda(view(spark, sf, "jobs"), view(spark, sf, "repeat_days"), TODAY, birthdays=crew)


@query(with_views(AGENDA, "jobs", "repeat_days", "crew"))
def q60f_build_agenda(spark, sf):
    return _agenda(spark, sf)


@query(with_views(f"""SELECT book_id, day, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN job END, '; ' ORDER BY rn) AS shown, greatest(count(*) - 3, 0) AS more,
CASE WHEN bool_or(NOT birthday AND NOT done AND (note = 'overdue' OR priority = 'urgent')) THEN 'urgent' WHEN bool_or(NOT birthday AND NOT done AND priority = 'important') THEN 'important'
WHEN bool_and(birthday) THEN 'birthday' WHEN bool_and(birthday OR done) THEN 'done' ELSE 'plain' END AS severity
FROM (SELECT *, row_number() OVER (PARTITION BY book_id, day ORDER BY birthday DESC, note <> 'overdue', done, job, id, note, forecast) AS rn FROM ({AGENDA}) WHERE NOT daily) GROUP BY book_id, day""", "jobs", "repeat_days", "crew"))
def q55_month_cells(spark, sf):
    return agenda.month_cells(_agenda(spark, sf))


@query(with_views(f"""SELECT book_id, outstanding, overdue, CAST(outstanding AS STRING) || CASE WHEN outstanding = 1 THEN ' job today' ELSE ' jobs today' END
|| CASE WHEN overdue > 0 THEN ', ' || CAST(overdue AS STRING) || ' overdue' ELSE '' END AS title, array_to_string(t[1:3], '; ') || CASE WHEN outstanding > 3 THEN '…' ELSE '' END AS body
FROM (SELECT book_id, count(*) AS outstanding, count(*) FILTER (WHERE note = 'overdue') AS overdue, list(job ORDER BY job, id) AS t FROM ({AGENDA})
WHERE day = DATE '1998-06-15' AND NOT done AND NOT forecast AND NOT birthday AND book_id % 5 NOT IN (1, 2) GROUP BY book_id)""", "jobs", "repeat_days", "crew"))
def q40_reminder_summary(spark, sf):
    books = view(spark, sf, "jobs").select("book_id").distinct()
    settings = books.select("book_id", (F.col("book_id") % 5 != 1).alias("enabled"), F.lit(480).alias("at_minute"), F.when(F.col("book_id") % 5 == 2, F.lit(TODAY)).alias("last_sent"))
    return agenda.reminder_summary(_agenda(spark, sf), TODAY, settings, 500)


@query(with_views(f"""SELECT book_id, day, CASE WHEN NOT birthday THEN id END AS id, job, CASE WHEN NOT birthday THEN priority END AS priority, CASE WHEN NOT birthday THEN done END AS done, CASE WHEN NOT birthday THEN forecast END AS forecast,
CASE WHEN NOT birthday THEN note END AS note, CASE WHEN NOT birthday THEN daily END AS daily, birthday FROM ({AGENDA}) WHERE day IS NOT NULL""", "jobs", "repeat_days", "crew"))
def q8_agenda_round_trip(spark, sf):
    return agenda.read_agenda(agenda.agenda_payload(_agenda(spark, sf)))


ICS = """SELECT book_id, id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || id || '@' || CAST(book_id AS STRING) || '.opsbook' || chr(13) || chr(10)
|| 'DTSTART;VALUE=DATE:' || strftime(due, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || job || chr(13) || chr(10)
|| 'DESCRIPTION:Priority: ' || upper(substr(priority, 1, 1)) || substr(priority, 2) || CASE WHEN remarks <> '' THEN '\\nRemarks: ' || remarks ELSE '' END || chr(13) || chr(10) || 'END:VEVENT' AS event
FROM jobs WHERE NOT done AND due IS NOT NULL"""


@query(with_views(ICS, "jobs"))
def q7_calendar_events(spark, sf):
    return files.calendar_events(view(spark, sf, "jobs"))


@query(with_views("""SELECT j.book_id, j.id, coalesce(strftime(due, '%d-%b-%Y'), '') AS "Due Date", job AS "Job", priority AS "Priority", CASE WHEN done THEN 'Completed' ELSE 'Pending' END AS "Status",
coalesce(strftime(date_completed, '%d-%b-%Y'), '') AS "Date Completed", remarks AS "Remarks", CASE WHEN weekly_report THEN 'Yes' ELSE 'No' END AS "Weekly Report", CASE WHEN planner THEN 'Yes' ELSE 'No' END AS "Planner",
CASE WHEN ra THEN 'Yes' ELSE 'No' END AS "RA", CASE WHEN ptw THEN 'Yes' ELSE 'No' END AS "PTW", ptw_type AS "Permit Type", CASE WHEN days IS NULL THEN '' ELSE j.repeat || ' (' || CAST(days AS STRING) || ' days)' END AS "Interval"
FROM jobs j LEFT JOIN repeat_days r ON r.code = j.repeat""", "jobs", "repeat_days"))
def q4_jobs_csv_rows(spark, sf):
    return files.jobs_csv_rows(view(spark, sf, "jobs"), view(spark, sf, "repeat_days"))


@query(with_views("SELECT book_id, id, job, due, priority, done, date_completed, weekly_report, ra, ptw, repeat FROM jobs", "jobs"))
def q1_jobs_csv_round_trip(spark, sf):
    """Export rows parsed back as an import would parse them."""
    out = files.jobs_csv_rows(view(spark, sf, "jobs"), view(spark, sf, "repeat_days"))
    back = files.parse_jobs_csv(out, keep=["book_id", "id"])
    return back.select("book_id", "id", "job", "due", "priority", "done", "date_completed", "weekly_report", "ra", "ptw", "repeat")


NOTED = """SELECT book_id, id, 'Task "' || id || '", ' || priority AS job, due, priority, remarks || chr(10) || '"see ' || id || '", twice' AS remarks, weekly_report, planner, ra, ptw, ptw_type, repeat, done, date_completed FROM jobs"""


@query(with_views(f"SELECT book_id, job, due, priority, done, date_completed, remarks, weekly_report, planner, ra, ptw, ptw_type, repeat FROM ({NOTED})", "jobs"))
def q1_job_sheets(spark, sf):
    """Jobs whose texts have quotes, commas and line breaks, written as a sheet of each book and read again."""
    view(spark, sf, "jobs").createOrReplaceTempView("jobs")
    at = store.new_folder(spark, "sheets")
    files.write_jobs_csv(spark.sql(NOTED), view(spark, sf, "repeat_days"), at)
    back = files.read_jobs_csv(spark, f"{at}/*/*.csv")
    book = F.regexp_extract("source", "book_id=([0-9]+)", 1).cast("int")
    return back.select(book.alias("book_id"), "job", "due", "priority", "done", "date_completed", "remarks", "weekly_report", "planner", "ra", "ptw", "ptw_type", "repeat")


@query(with_views("SELECT doc_id, category, title FROM search_docs WHERE lower(concat_ws(' ', title, body)) LIKE '%license%'", "search_docs"))
def q13_search_index(spark, sf):
    """The search of q13 by way of an index of all entries."""
    at = store.new_folder(spark, "notes")
    search.write_note_index(view(spark, sf, "search_docs"), at)
    return search.search_index(spark, at, "License").select("doc_id", "category", "title")
