"""Loans: closed forms, and month-by-month schedules with prepayments.

Between two prepayments what is owed follows from one formula, so a schedule is a list of segments: only the months with
a prepayment are walked through, by a fold over a loan's own, and the rows of a segment are made from its formula.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_diff

SPAN = 1024  # months of a segment that one row stands for until rows are made
CLEAR = 0.005  # less than this is nothing owed


def emi(principal: Column, rate: Column, months: Column) -> Column:
    """Equal instalment at `rate` percent a year; without interest an equal share."""
    i = rate / 1200
    grown = F.pow(1 + i, months)
    return F.when(rate == 0, principal / months).otherwise(principal * i * grown / (grown - 1))


def loan_balance(principal: Column, rate: Column, months: Column, k: Column) -> Column:
    """What is owed after k instalments and no prepayment."""
    i, e = rate / 1200, emi(principal, rate, months)
    grown = F.pow(1 + i, k)
    return F.when(rate == 0, principal - e * k).otherwise(principal * grown - e * (grown - 1) / i)


def _owed(b: str, t: str) -> str:
    """SQL: what is owed of `b` after `t` instalments; written so that nothing large cancels."""
    return f"CASE WHEN {t} = 0 THEN {b} WHEN i = 0 THEN {b} - e * ({t}) ELSE {b} - (e - {b} * i) * expm1(({t}) * log1p(i)) / i END"


def _term(b: str) -> str:
    """SQL: how many instalments clear `b`: the first after which less than CLEAR is owed."""
    n = f"greatest(1, floor(CASE WHEN i = 0 THEN ({b} - {CLEAR}) / e ELSE log1p(({b} - {CLEAR}) * i / (e - {b} * i)) / log1p(i) END) + 1)"
    sure = f"CASE WHEN n > 1 AND {_owed('b', 'n - 1')} < {CLEAR} THEN n - 1 WHEN {_owed('b', 'n')} >= {CLEAR} THEN n + 1 ELSE n END"
    return f"aggregate(array(CAST({n} AS BIGINT)), 0L, (u, n) -> aggregate(array({b}), 0L, (w, b) -> CAST({sure} AS BIGINT)))"


def _segments(never: str) -> str:
    """SQL: (first, last, opening, extra) of each segment; `pre` has the months with prepayments in order."""
    kind = "array<struct<first: bigint, last: bigint, opening: double, extra: double>>"
    left = f"aggregate(array({_owed('s.b', 'p.m - s.first + 1')}), 0D, (r, x) -> IF(x < {CLEAR}, 0D, x))"
    step = f"""IF(s.b <= 0 OR s.first + {_term('s.b')} - 1 < p.m, s, aggregate(array({left}), s, (r, x) -> named_struct(
      'first', p.m + 1, 'b', IF(x - least(p.a, x) < {CLEAR}, 0D, x - least(p.a, x)),
      'out', concat(r.out, array(named_struct('first', r.first, 'last', p.m, 'opening', r.b, 'extra', least(p.a, x)))))))"""
    rest = f"IF(s.b > 0, concat(s.out, array(named_struct('first', s.first, 'last', s.first + {_term('s.b')} - 1, 'opening', s.b, 'extra', 0D))), s.out)"
    walked = f"aggregate(pre, named_struct('first', 1L, 'b', principal, 'out', CAST(array() AS {kind})), (s, p) -> {step}, s -> {rest})"
    return f"CASE WHEN principal <= 0 THEN CAST(array() AS {kind}) WHEN {never} THEN array(named_struct('first', 1L, 'last', 1L, 'opening', principal, 'extra', 0D)) ELSE {walked} END"


def amortise(loans: DataFrame, prepayments: DataFrame | None = None, between: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Schedule rows of every loan until nothing is owed; row k is the start month plus k - 1.

    Prepayments (book_id, loan_id, month_no, amount) are made after the month's instalment and trimmed to what is left;
    those before the first month count in it, and months whose sum is below zero have none. An instalment that does not
    cover the first month's interest, or pays off less than a float can show, gives one row with `never` set. With
    `between`, only rows of months from the first day's to the last day's are made.

    A loan whose principal, rate or instalment is missing or not a number, or whose rate is -1200 or less, has one row in
    which all but its ids are null. A loan of nothing has no row.
    """
    c = F.col
    base = loans.select(
        "book_id", F.col("id").alias("loan_id"), c("principal").cast("double").alias("principal"), (c("rate") / 1200).alias("i"), F.coalesce("emi", emi(c("principal"), c("rate"), c("months"))).cast("double").alias("e"),
        *(month_diff(F.col("start"), F.lit(day)).alias(name) for day, name in zip(between or (), ("lo", "hi"))),
    )
    none = F.expr("CAST(array() AS array<struct<m: bigint, a: double>>)")
    if prepayments is None:
        base = base.withColumn("pre", none)
    else:
        per = prepayments.groupBy("book_id", "loan_id", F.greatest("month_no", F.lit(1)).cast("long").alias("m")).agg(F.sum("amount").alias("a")).where("a > 0")
        per = per.groupBy("book_id", "loan_id").agg(F.sort_array(F.collect_list(F.struct("m", F.col("a").cast("double").alias("a")))).alias("pre"))
        base = base.join(per, ["book_id", "loan_id"], "left").withColumn("pre", F.coalesce("pre", none))
    sound = F.coalesce(*(F.nullif(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(True)) for x in map(c, ("principal", "i", "e"))), F.lit(True))
    known = F.col("principal").isNotNull() & F.col("i").isNotNull() & F.col("e").isNotNull() & (F.col("i") > -1) & sound
    base = base.withColumn("known", F.coalesce(known, F.lit(False)))
    never = "(e <= principal * i OR principal - (e - principal * i) = principal)"
    base = base.withColumns({"never": F.expr(f"known AND {never}"), "segments": F.expr(f"CASE WHEN known THEN {_segments(never)} END")})
    parts = base.select("book_id", "loan_id", "i", "e", "never", "known", *(x for x in ("lo", "hi") if between), F.expr("inline_outer(segments)")).where("NOT known OR first IS NOT NULL")
    shown = parts.withColumns({"begin": F.greatest("first", c("lo") + 1), "end": F.least("last", c("hi") + 1)}) if between else parts.withColumns({"begin": c("first"), "end": c("last")})
    shown = shown.where("NOT known OR begin <= end").withColumn("begin", F.explode_outer(F.when(c("known"), F.sequence("begin", "end", F.lit(SPAN)))))
    spread = int(loans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shown = shown.repartition(spread, "book_id", "loan_id", "begin").withColumn("end", F.least("end", c("begin") + (SPAN - 1)))
    rows = shown.withColumn("month_no", F.explode_outer(F.when(c("known"), F.sequence("begin", "end"))))
    rows = rows.withColumns({"owed": F.expr(_owed("opening", "(month_no - first)")), "after": F.expr(_owed("opening", "(month_no - first + 1)")), "interest": F.lit(None).cast("double")})
    rows = rows.withColumns({"after": F.when(c("never") | (c("after") >= CLEAR), c("after")).otherwise(0.0), "extra": F.when(c("known"), F.when(c("month_no") == c("last"), c("extra")).otherwise(0.0)), "interest": c("owed") * c("i")})
    part, closing = F.when(c("after") == 0, c("owed")).otherwise(c("e") - c("interest")), c("after") - c("extra")
    return rows.select(
        "book_id", "loan_id", c("month_no").cast("int").alias("month_no"), c("owed").alias("opening"), "interest", F.when(c("known"), part).alias("principal_paid"), "extra",
        F.when(c("known"), F.when(c("never") | (closing >= CLEAR), closing).otherwise(0.0)).alias("closing"), F.when(c("known"), c("never")).alias("never"),
    )


def _day(month_no: Column) -> Column:
    """The day of an instalment; null after the year 9999."""
    return F.when(F.year("start") * 12 + F.month("start") + month_no - 2 < 120_000, F.add_months("start", (month_no - 1).cast("int")))


def schedule_summary(schedule: DataFrame, loans: DataFrame) -> DataFrame:
    """(book_id, loan_id, months, total_interest, payoff): payoff is null for a loan that never ends or ends after the year
    9999. A loan with missing values has 0 months."""
    s = schedule.groupBy("book_id", "loan_id").agg(F.count("month_no").alias("months"), F.sum("interest").alias("total_interest"), F.bool_or("never").alias("never"))
    j = s.join(loans.select("book_id", F.col("id").alias("loan_id"), "start"), ["book_id", "loan_id"])
    return j.select("book_id", "loan_id", "months", "total_interest", _day(F.when(~F.col("never"), F.col("months"))).alias("payoff"))


def loan_status(schedule: DataFrame, plain: DataFrame, loans: DataFrame, today: dt.date) -> DataFrame:
    """Interest to date, balance now, months left, the month it clears (null: never), and what prepayments save against
    the schedule without them."""
    past = F.coalesce(_day(F.col("month_no")), F.lit(dt.date(9999, 12, 31))) <= F.lit(today)
    rows = schedule.join(loans.select("book_id", F.col("id").alias("loan_id"), "start", "principal"), ["book_id", "loan_id"])
    now = rows.groupBy("book_id", "loan_id").agg(
        F.coalesce(F.sum(F.when(past, F.col("interest"))), F.lit(0.0)).alias("interest_to_date"),
        F.coalesce(F.max_by("closing", F.when(past, F.col("month_no"))), F.first("principal")).alias("balance"),
        F.count("month_no").alias("months"), F.sum("interest").alias("interest"),
        F.max(F.when(~F.col("never") & (F.col("closing") == 0), F.trunc(_day(F.col("month_no")), "month"))).alias("clears"),
    )
    was = plain.groupBy("book_id", "loan_id").agg(F.count("month_no").alias("m0"), F.sum("interest").alias("i0"))
    return now.join(was, ["book_id", "loan_id"]).select(
        "book_id", "loan_id", "interest_to_date", "balance", "months", "clears", (F.col("m0") - F.col("months")).alias("months_saved"), (F.col("i0") - F.col("interest")).alias("interest_saved")
    )
