"""Agenda rows of a period, forecasts of repeats, and what widgets show of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ENTRIES = 2_000  # entries of a day in one payload, about


def project_occurrences(jobs: DataFrame, repeat_days: DataFrame, start: dt.date, end: dt.date, daily: bool = False) -> DataFrame:
    """Forecast days due + k * interval (k >= 1) of open repeating jobs, inside the period; of daily jobs only if asked.

    The first occurrence in the period is found by division, so old due dates make no extra rows.
    """
    own = jobs.where("not done and due is not null" + ("" if daily else " and repeat <> 'daily'")).join(repeat_days, F.col("repeat") == F.col("code"))
    k = F.greatest(F.lit(1), F.ceil(F.date_diff(F.lit(start), "due") / F.col("days"))).cast("int")
    first = own.withColumn("first", F.date_add("due", (k * F.col("days")).cast("int"))).where(F.col("first") <= F.lit(end))
    steps = F.sequence(F.lit(0), F.floor(F.date_diff(F.lit(end), "first") / F.col("days")).cast("int"))
    return first.withColumn("k", F.explode(steps)).select("book_id", "id", "job", "priority", *(["repeat"] if daily else []), F.expr("date_add(first, k * days)").alias("day"))


def roll_daily(jobs: DataFrame, today: dt.date) -> DataFrame:
    """An open daily job that is overdue is due today."""
    late = (F.col("repeat") == "daily") & ~F.col("done") & (F.col("due") < F.lit(today))
    return jobs.withColumn("due", F.when(late, F.lit(today)).otherwise(F.col("due")))


def month_day_matches(birthdays: DataFrame, days: DataFrame, feb29: str | None = None) -> DataFrame:
    """Birthdays on the given days by month and day; feb29='28' also places 29 February in common years."""
    keyed = birthdays.withColumn("_md", F.date_format("dob", "MM-dd"))
    on = days.withColumn("_md", F.date_format("day", "MM-dd"))
    if feb29:
        common = F.date_format(F.last_day("day"), "dd") == "28"
        also = days.where((F.date_format("day", "MM-dd") == "02-28") & common).withColumn("_md", F.lit("02-29"))
        on = on.unionByName(also)
    return keyed.join(on, "_md").drop("_md")


def birthdays_on(birthdays: DataFrame, days: DataFrame, kind: str | None = None, feb29: str | None = None) -> DataFrame:
    own = birthdays.where(F.col("kind") == kind) if kind else birthdays
    return month_day_matches(own, days, feb29)


def build_agenda(jobs: DataFrame, repeat_days: DataFrame, today: dt.date, months: int = 3, birthdays: DataFrame | None = None) -> DataFrame:
    """Rows (book_id, day, id, job, priority, done, note, forecast, daily, birthday) of so many months each side of today.

    Dated jobs stand on their day; open overdue ones also on today, undated open ones on today. Daily jobs are rolled to
    today and projected onto the days ahead like others, and flagged. birthdays: (book_id, id, label, dob), on each day
    of the period that is theirs.
    """
    first, last = _shift(today, -months), _shift(today, months)
    jobs = roll_daily(jobs, today)
    base = ["book_id", "id", "job", "priority", "done"]
    daily = (F.coalesce("repeat", F.lit("")) == "daily").alias("daily")

    def rows(df: DataFrame, day, note: str) -> DataFrame:
        return df.select(*base, day.alias("day"), F.lit(note).alias("note"), F.lit(False).alias("forecast"), daily, F.lit(False).alias("birthday"))

    dated = rows(jobs.where(F.col("due").between(F.lit(first), F.lit(last))), F.col("due"), "")
    late = rows(jobs.where(~F.col("done") & (F.col("due") < F.lit(today))), F.lit(today), "overdue")
    undated = rows(jobs.where("not done and due is null"), F.lit(today), "no date")
    ahead = project_occurrences(jobs, repeat_days, first, last, daily=True).withColumn("done", F.lit(False))
    ahead = ahead.select(*base, "day", F.lit("").alias("note"), F.lit(True).alias("forecast"), daily, F.lit(False).alias("birthday"))
    out = dated.unionByName(late).unionByName(undated).unionByName(ahead)
    if birthdays is None:
        return out
    days = jobs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    theirs = month_day_matches(birthdays.select("book_id", "id", "label", "dob"), days)
    return out.unionByName(theirs.select(
        "book_id", "id", F.col("label").alias("job"), F.lit("normal").alias("priority"), F.lit(False).alias("done"), "day", F.lit("").alias("note"),
        F.lit(False).alias("forecast"), F.lit(False).alias("daily"), F.lit(True).alias("birthday"),
    ))


def _shift(d: dt.date, months: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(y, m + 1, min(d.day, last))


def month_cells(agenda: DataFrame, cap: int = 3) -> DataFrame:
    """Per book and day: how many entries, the first `cap`, how many more, and the cell's severity.

    Daily jobs are left out; birthdays come first, then overdue jobs. Severity: overdue or urgent, important, only
    birthdays, all done, plain.
    """
    own = agenda.where(~F.col("daily"))
    order = Window.partitionBy("book_id", "day").orderBy(F.desc("birthday"), F.col("note") != "overdue", "done", "job", "id", "note", "forecast")
    ranked = own.withColumn("rn", F.row_number().over(order))
    job = ~F.col("birthday")
    hot = F.max(F.when(job & ~F.col("done") & ((F.col("note") == "overdue") | (F.col("priority") == "urgent")), 1).otherwise(0))
    warm = F.max(F.when(job & ~F.col("done") & (F.col("priority") == "important"), 1).otherwise(0))
    severity = (
        F.when(hot == 1, "urgent").when(warm == 1, "important").when(F.bool_and("birthday"), "birthday")
        .when(F.bool_and(F.col("birthday") | F.col("done")), "done").otherwise("plain")
    )
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= cap, F.struct("rn", "job")))), lambda x: x["job"]), "; ")
    return ranked.groupBy("book_id", "day").agg(F.count("*").alias("n"), shown.alias("shown"), F.greatest(F.count("*") - cap, F.lit(0)).alias("more"), severity.alias("severity"))


def reminder_summary(agenda: DataFrame, today: dt.date, settings: DataFrame, minute: int) -> DataFrame:
    """One reminder per book with outstanding entries today: counts, wording and the first three texts.

    settings: (book_id, enabled, at_minute, last_sent). A book gets none when disabled, before its minute, or
    when sent today already. Birthdays are no outstanding entries.
    """
    due = agenda.where((F.col("day") == F.lit(today)) & ~F.col("done") & ~F.col("forecast") & ~F.col("birthday"))
    ranked = due.withColumn("rn", F.row_number().over(Window.partitionBy("book_id").orderBy("job", "id")))
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "job")))), lambda x: x["job"])
    per = ranked.groupBy("book_id").agg(F.count("*").alias("outstanding"), F.count_if(F.col("note") == "overdue").alias("overdue"), texts.alias("t"))
    allowed = settings.where(F.col("enabled") & (F.col("at_minute") <= minute) & (F.col("last_sent").isNull() | (F.col("last_sent") < F.lit(today))))
    words = F.concat(F.col("outstanding").cast("string"), F.when(F.col("outstanding") == 1, " job today").otherwise(" jobs today"))
    title = F.when(F.col("overdue") > 0, F.concat(words, F.lit(", "), F.col("overdue").cast("string"), F.lit(" overdue"))).otherwise(words)
    body = F.concat(F.array_join("t", "; "), F.when(F.col("outstanding") > 3, "…").otherwise(""))
    return per.join(allowed.select("book_id"), "book_id", "left_semi").select("book_id", "outstanding", "overdue", title.alias("title"), body.alias("body"))


def agenda_payload(agenda: DataFrame) -> DataFrame:
    """(book_id, day, part, payload): the day's `jobs` and `bdays` (labels) as JSON; a day without entries has no row.

    A day of more than PART_ENTRIES entries is dealt in parts by a hash of its entries.
    """
    entry = F.struct(
        F.col("id").alias("i"), F.col("job").alias("t"), F.col("priority").alias("p"), F.col("done").alias("d"), F.col("forecast").alias("r"), F.col("note").alias("w"), F.col("daily").alias("dy")
    )
    parts = agenda.groupBy("book_id", "day").agg(F.ceil(F.count("*") / PART_ENTRIES).cast("int").alias("parts"))
    rows = agenda.join(parts, ["book_id", "day"]).withColumn("part", F.pmod(F.xxhash64("id", "job", "note", "forecast"), "parts").cast("int"))
    jobs, bdays = F.collect_list(F.when(~F.col("birthday"), entry)), F.collect_list(F.when(F.col("birthday"), F.col("job")))
    return rows.groupBy("book_id", "day", "part").agg(F.to_json(F.struct(F.sort_array(jobs).alias("jobs"), F.sort_array(bdays).alias("bdays"))).alias("payload"))


def read_agenda(payloads: DataFrame) -> DataFrame:
    """Jobs and birthdays of the payloads; a birthday has its label and day only."""
    kind = "struct<jobs: array<struct<i: string, t: string, p: string, d: boolean, r: boolean, w: string, dy: boolean>>, bdays: array<string>>"
    days = payloads.select("book_id", "day", F.from_json("payload", kind).alias("a"))
    rows = days.select("book_id", "day", F.explode("a.jobs").alias("e"))
    jobs = rows.select("book_id", "day", *(F.col(f"e.{a}").alias(b) for a, b in (("i", "id"), ("t", "job"), ("p", "priority"), ("d", "done"), ("r", "forecast"), ("w", "note"), ("dy", "daily"))), F.lit(False).alias("birthday"))
    bdays = days.select("book_id", "day", F.explode("a.bdays").alias("job"), F.lit(True).alias("birthday"))
    return jobs.unionByName(bdays, allowMissingColumns=True)
