"""Known values: dates, loans, deposits, returns, arrival times, units, reports and merges."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsbook.functions import dates, text
from opsbook.operators import agenda, budget, calls, jobs, ledger, loans, media, quality, reports, savings, units
from opsbook.plans.views import VIEWS
from opsbook.sources import archive, files
from opsbook.streaming import merge

D = dt.date


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_months_and_weeks(spark):
    r = one(
        spark, dates.month_add(F.lit(D(2026, 11, 1)), 3), dates.month_add(F.lit(D(2026, 2, 1)), -3), dates.month_diff(F.lit(D(2025, 11, 1)), F.lit(D(2027, 2, 1))),
        dates.day_of_month(F.lit(D(2027, 2, 1)), 31), dates.week_start(F.lit(D(2026, 8, 30))), dates.week_label(F.lit(D(2026, 8, 23))),
    )
    assert tuple(r) == (D(2027, 2, 1), D(2025, 11, 1), 15, D(2027, 2, 28), D(2026, 8, 24), "17th AUG 2026 to 23rd AUG 2026")


LOAN = "book_id long, id string, principal double, rate double, months int, start date, emi double"


PREPAID = "book_id long, loan_id string, month_no int, amount double"


def test_loans(spark):
    rows = [
        (1, "plain", 3.5e6, 8.6, 240, D(2026, 1, 1), None), (1, "prepaid", 3.5e6, 8.6, 240, D(2026, 1, 1), None), (1, "big", 3.5e6, 8.6, 240, D(2026, 1, 1), None),
        (1, "never", 1e6, 12.0, 240, D(2026, 1, 1), 5000.0), (1, "free", 120000.0, 0.0, 12, D(2026, 1, 1), None), (1, "none", 0.0, 5.0, 12, D(2026, 1, 1), None),
    ]
    df = spark.createDataFrame(rows, LOAN)
    extra = spark.createDataFrame([(1, "prepaid", 25, 500000.0), (1, "big", 3, 99999999.0), (1, "big", 0, 0.0), (2, "plain", 2, 9e9)], PREPAID)
    schedule = loans.amortise(df, extra)
    s = {r["loan_id"]: r for r in loans.schedule_summary(schedule, df).collect()}
    assert s["plain"]["months"] == 240 and abs(s["plain"]["total_interest"] - 3842967.14) < 1 and s["plain"]["payoff"] == D(2045, 12, 1)
    assert s["prepaid"]["months"] == 180 and abs(s["prepaid"]["total_interest"] - 2482557.83) < 1
    assert s["big"]["months"] == 3 and s["never"]["months"] == 1 and s["never"]["payoff"] is None
    assert s["free"]["months"] == 12 and s["free"]["total_interest"] == 0 and "none" not in s
    last = schedule.where("loan_id = 'big' and month_no = 3").first()
    assert last["closing"] == 0 and abs(last["extra"] - 3483344.11) < 1
    e = one(spark, loans.emi(F.lit(3.5e6), F.lit(8.6), F.lit(240)), loans.emi(F.lit(120000.0), F.lit(0.0), F.lit(12)), loans.loan_balance(F.lit(3.5e6), F.lit(8.6), F.lit(240), F.lit(240)))
    assert abs(e[0] - 30595.6964) < 1e-3 and e[1] == 10000 and abs(e[2]) < 1e-3
    assert loans.amortise(df.limit(0), extra).count() == 0


def test_loans_of_two_books_and_long_ones(spark):
    """Equal ids in two books, a loan of 2,400 months that clears, and the rows of a span of months alone."""
    rows = [(1, "l1", 120000.0, 0.0, 12, D(2026, 1, 1), None), (2, "l1", 120000.0, 0.0, 12, D(2026, 1, 1), None), (1, "long", 1e6, 6.0, 2400, D(2026, 1, 1), None)]
    rows += [(2, "barely", 1e6, 12.0, 12, D(2026, 1, 1), 10000.000001), (2, "unseen", 1e6, 12.0, 12, D(2026, 1, 1), 10000.000000000002)]
    df = spark.createDataFrame(rows, LOAN)
    extra = spark.createDataFrame([(1, "l1", 1, 60000.0)], PREPAID)
    schedule = loans.amortise(df, extra)
    s = {(r["book_id"], r["loan_id"]): r for r in loans.schedule_summary(schedule, df).collect()}
    assert s[1, "l1"]["months"] == 6 and s[2, "l1"]["months"] == 12
    assert s[1, "long"]["months"] in (2400, 2401) and s[1, "long"]["payoff"] in (D(2225, 12, 1), D(2226, 1, 1))
    assert s[2, "barely"]["months"] > 2000 and s[2, "unseen"]["months"] == 1 and s[2, "unseen"]["payoff"] is None
    assert schedule.groupBy("book_id", "loan_id").agg(F.min_by("closing", -F.col("month_no")).alias("c")).where("c > 0").count() == 1
    span = loans.amortise(df, extra, (D(2026, 5, 1), D(2026, 8, 1)))
    assert sorted(map(tuple, span.collect())) == sorted(map(tuple, schedule.where("month_no between 5 and 8").collect()))
    status = {(r["book_id"], r["loan_id"]): r["clears"] for r in loans.loan_status(schedule, loans.amortise(df), df, D(2026, 3, 1)).collect()}
    assert status[1, "l1"] == D(2026, 6, 1) and status[2, "l1"] == D(2026, 12, 1) and status[2, "unseen"] is None


def test_loans_with_missing_values(spark):
    """One row of nulls for a loan that cannot be computed, and none for a loan of nothing."""
    nan = float("nan")
    rows = [(1, "principal", None, 5.0, 12, D(2026, 1, 1), None), (1, "rate", 1e5, None, 12, D(2026, 1, 1), None), (1, "months", 1e5, 5.0, None, D(2026, 1, 1), None), (1, "nan", nan, 5.0, 12, D(2026, 1, 1), None)]
    rows += [(1, "given", 1e5, 5.0, None, D(2026, 1, 1), 9000.0), (1, "zero", 0.0, 5.0, 12, D(2026, 1, 1), None), (1, "below", 1e5, -1200.0, 12, D(2026, 1, 1), 9000.0), (1, "paid back", 1e5, -3.0, 12, D(2026, 1, 1), None)]
    df = spark.createDataFrame(rows, LOAN)
    extra = spark.createDataFrame([(1, "given", 2, None), (1, "given", 3, -50.0), (1, "rate", 1, 10.0), (9, "nobody", 1, 1.0)], PREPAID)
    schedule = loans.amortise(df, extra)
    found = {}
    for r in schedule.collect():
        found.setdefault(r["loan_id"], []).append(r)
    assert set(found) == {"principal", "rate", "months", "nan", "given", "below", "paid back"}
    for name in ("principal", "rate", "months", "nan", "below"):
        assert len(found[name]) == 1 and all(v is None for v in found[name][0][2:])
    assert len(found["given"]) == 12 and all(r["extra"] == 0 for r in found["given"]) and len(found["paid back"]) == 12
    summary = {r["loan_id"]: r for r in loans.schedule_summary(schedule, df).collect()}
    assert summary["rate"]["months"] == 0 and summary["rate"]["payoff"] is None and summary["rate"]["total_interest"] is None and summary["given"]["months"] == 12
    status = {r["loan_id"]: r for r in loans.loan_status(schedule, loans.amortise(df), df, D(2026, 6, 1)).collect()}
    assert status["nan"]["clears"] is None and status["given"]["months_saved"] == 0


def test_schedule_equals_a_loop_over_months(spark):
    """Random loans and prepayments beside the rule stated month by month; rows lie in several tasks."""
    rng = random.Random(5)
    rows = [(k % 3, f"l{k}", rng.uniform(1e3, 1e6), rng.choice([0.0, 0.5, 8.6, 30.0, -2.0]), rng.randint(1, 90), D(2026, 1, 1), rng.choice([None, None, 900.0])) for k in range(60)]
    paid = [(k % 3, f"l{k}", rng.randint(-1, 60), rng.choice([10.0, 5e3, 2e5])) for k in range(60) for _ in range(rng.randint(0, 5))]
    schedule = loans.amortise(spark.createDataFrame(rows, LOAN), spark.createDataFrame(paid, PREPAID))
    got = {(r["loan_id"], r["month_no"]): tuple(r[3:]) for r in schedule.collect()}
    want = {}
    for book, name, owed, rate, months, _, emi in rows:
        i = rate / 1200
        due = emi or (owed / months if not i else owed * i * (1 + i) ** months / ((1 + i) ** months - 1))
        never, k = due <= owed * i, 0
        while owed > 0 and not (never and k):
            k += 1
            interest = owed * i
            part = due - interest if never else min(due - interest, owed)
            part = owed if owed - part < 0.005 else part
            extra = 0.0 if never else min(sum(a for b, n, m, a in paid if (b, n) == (book, name) and max(m, 1) == k), owed - part)
            left = owed - part - extra
            want[name, k] = (owed, interest, part, extra, left if left >= 0.005 else 0.0, never)
            owed = want[name, k][4]
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-5 for key in want for a, b in zip(got[key][:5], want[key][:5])) and all(got[k][5] == want[k][5] for k in want)
    assert schedule.select(F.spark_partition_id()).distinct().count() > 1
    assert "Python" not in schedule._jdf.queryExecution().executedPlan().toString() and "InPandas" not in schedule._jdf.queryExecution().executedPlan().toString()


def test_loan_of_very_many_months(spark):
    df = spark.createDataFrame([(1, "long", 1e6, 0.0, 350_000, D(2026, 1, 1), None), (1, "slow", 1e6, 12.0, 12, D(2026, 1, 1), 10000.0001)], LOAN)
    schedule = loans.amortise(df)
    s = {r["loan_id"]: r for r in loans.schedule_summary(schedule, df).collect()}
    assert s["long"]["months"] == 350_000 and s["long"]["payoff"] is None and s["slow"]["months"] > 1000
    assert schedule.where("loan_id = 'long'").select(F.spark_partition_id()).distinct().count() > 1


def test_plans_of_two_books(spark):
    plan = spark.createDataFrame([(1, 1, 100.0, 0.0, 5.0, 1, 0.0, 12, 1e4), (2, 1, 900.0, 0.0, 5.0, 1, 0.0, 12, 1e4)], PLAN)
    rows = savings.project_savings(plan)
    end = {r["book_id"]: r["value"] for r in rows.where("month_no = 12").collect()}
    assert abs(9 * end[1] - end[2]) < 1e-6
    need = {r["book_id"]: r["needed"] for r in savings.solve_monthly(plan).collect()}
    assert len(need) == 2 and abs(need[1] - need[2]) < 1e-9
    assert savings.period_returns(rows, plan, 3).count() == 8 and savings.irr(savings.plan_flows(rows, plan), savings.KEY).count() == 2


def test_deposits(spark):
    def fd(day, *more):
        return savings.fd_value(F.lit(500000.0), F.lit(7.1), F.lit(4), F.lit(60), F.lit(D(2024, 1, 1)), F.lit(day), *more)

    def rd(day):
        return savings.rd_value(F.lit(15000.0), F.lit(6.8), F.lit(4), F.lit(60), F.lit(D(2024, 1, 1)), F.lit(day))

    r = one(spark, fd(D(2029, 1, 1)), fd(D(2035, 1, 1)), fd(D(2023, 1, 1)), fd(D(2030, 1, 1), F.lit("periodic")), savings.fd_payout(F.lit(500000.0), F.lit(7.1), F.lit(4)), rd(D(2029, 1, 1)), rd(D(2025, 1, 1)), savings.rd_done(F.lit(60), F.lit(D(2024, 1, 1)), F.lit(D(2025, 1, 1))))
    for got, want in zip(r, (710873.34, 710873.34, 500000, 500000, 8875, 1073313.32, 201730.93, 13)):
        assert abs(got - want) < 0.5


PLAN = "book_id long, id int, monthly double, lump double, rate double, years int, step double, comp int, target double"


def test_savings_and_returns(spark):
    plan = spark.createDataFrame([(7, 1, 10000.0, 0.0, 12.0, 10, 10.0, 12, 1e6), (7, 2, 1000.0, 9e9, 5.0, 1, 0.0, 12, 5.0)], PLAN)
    rows = savings.project_savings(plan)
    last = rows.where("id = 1 and month_no = 120").first()
    assert abs(last["value"] - 3374326.26) < 1 and abs(last["paid"] - 1912490.95) < 1 and abs(last["instalment"] - 23579.48) < 0.01
    r = savings.irr(savings.plan_flows(rows, plan).where("id = 1"), savings.KEY).first()
    assert abs(r["annual"] - 0.126825) < 1e-6
    assert {x["id"]: x["needed"] for x in savings.solve_monthly(plan).collect()}[2] == 0
    need = savings.solve_monthly(plan).where("id = 1").first()["needed"]
    again = savings.project_savings(plan.where("id = 1").withColumn("monthly", F.lit(need))).where("month_no = 120").first()["value"]
    assert abs(again - 1e6) < 1
    flat = spark.createDataFrame([("a", k, -100.0) for k in range(3)] + [("b", k, 100.0) for k in range(2)], "k string, month int, amount double")
    assert all(x["monthly_rate"] is None for x in savings.irr(flat, ["k"]).collect())
    quarters, years = (savings.period_returns(rows, plan, m).where("id = 1").orderBy("period").collect() for m in (3, 12))
    assert quarters[-1]["value"] == years[-1]["value"] and len(quarters) == 40


def test_fold(spark):
    parts = spark.createDataFrame([(1, f"C{k:02d}", 1000.0 - k * 10) for k in range(11)], "book_id int, label string, value double")
    out = budget.fold_other(parts, ["book_id"]).orderBy("place").collect()
    assert len(out) == 7 and out[-1]["label"] == "Other (5)" and abs(sum(r["share"] for r in out) - 1) < 1e-12
    assert budget.fold_other(parts.limit(0), ["book_id"]).count() == 0


def test_prices(spark):
    points = [(1, "h", D(2026, 1, 1), 120.0, 1), (1, "h", D(2026, 1, 1), 130.0, 2), (1, "h", D(2026, 2, 1), 140.0, 3), (2, "h", D(2025, 1, 1), 7.0, 1)]
    p, key = spark.createDataFrame(points, "book_id int, holding_id string, d date, p double, upd long"), ["book_id", "holding_id"]
    assert [r["p"] for r in budget.one_per_day(p, key).orderBy("book_id", "d").collect()] == [130, 140, 7]
    days = [D(2025, 1, 1), D(2026, 1, 31), D(2026, 2, 1)]
    asked = budget.price_asof(spark.createDataFrame([(1, "h")], "book_id int, id string"), budget.one_per_day(p, key), days)
    assert [r["price"] for r in asked.orderBy("day").collect()] == [None, 130, 140]


def test_voyages(spark):
    rows = [(1, dt.datetime(2026, 9, 1, 20, 30), 1450.0, 15.0), (2, dt.datetime(2026, 9, 1), None, 15.0), (3, dt.datetime(2026, 9, 1), 10.0, 0.0), (4, dt.datetime(2026, 9, 1), 10.0, 0.5)]
    out = units.eta_band(spark.createDataFrame(rows, "id int, departure timestamp, distance_nm double, speed_kn double")).collect()
    own = {r["speed"]: r for r in out if r["id"] == 1}
    assert len(own) == 20 and own[15.0]["under_way"] == "4d 0h 40m" and own[15.0]["entered"] and own[15.0]["arrival"] == dt.datetime(2026, 9, 5, 21, 10)
    assert own[16.0]["under_way"] == "3d 18h 38m" and own[14.1]["under_way"] == "4d 6h 50m"
    assert {r["id"] for r in out} == {1, 4} and min(r["speed"] for r in out if r["id"] == 4) > 0


def test_numbers_and_lines(spark):
    r = one(spark, text.clean_number(F.lit("ab-1.2.3x")), text.clean_number(F.lit("")), text.format_sig(F.lit(14.503773773)), text.format_sig(F.lit(1000.0)), text.format_sig(F.lit(0.0)), text.format_sig(F.lit(264.17205)), text.tile_key(F.lit(1.0), F.lit(51.0)), text.format_offset(F.lit(60)))
    assert tuple(r) == (-1.23, None, "14.50377", "1 000", "0", "264.1721", "45_35", "UTC+01:00")
    for n in (1, 74, 75, 148, 149):
        assert one(spark, text.ics_fold(F.lit("y" * n)))[0].replace("\r\n ", "") == "y" * n
    long = "x" * 200
    folded = one(spark, text.ics_fold(F.lit(long)), text.ics_escape(F.lit("a,b;c\nd\\")))
    assert folded[0].replace("\r\n ", "") == long and max(map(len, folded[0].split("\r\n"))) <= 75 and folded[1] == "a\\,b\\;c\\nd\\\\"


JOB = "book_id int, id string, serial int, job string, due date, priority string, remarks string, weekly_report boolean, planner boolean, ra boolean, ptw boolean, ptw_type string, repeat string, done boolean, date_completed date"


def job(i, due=None, done=False, completed=None, repeat="", **k):
    return (1, f"j{i}", i, k.get("job", f"job {i}"), due, "normal", "", k.get("weekly", True), k.get("planner", False), False, True, "P", repeat, done, completed)


def test_folding_counts_octets(spark):
    long = ["é" * 200, "a" * 200, "日本" * 60, "", "x" * 74 + "é", "😀" * 40]
    out = spark.createDataFrame([(t,) for t in long], "t string").select(text.ics_fold(F.col("t"))).collect()
    for t, (folded,) in zip(long, out):
        lines = folded.split("\r\n")
        assert max(len(x.encode()) for x in lines) <= 75 and lines[0] + "".join(x[1:] for x in lines[1:]) == t


def test_restored_lists(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "book_id int, id string")
    file = spark.createDataFrame([(1, "x"), (9, "y")], "book_id int, id string")
    got = ledger.restore_lists({"spend": own, "goals": own}, {"spend": file}, own.where("book_id < 3"))
    assert sorted(map(tuple, got["spend"].collect())) == [(1, "x"), (3, "c")] and [tuple(r) for r in got["goals"].collect()] == [(3, "c")]


def test_jobs(spark):
    days = spark.sql(VIEWS["repeat_days"])
    df = spark.createDataFrame([job(1, D(2026, 7, 6), True, D(2026, 7, 9), "weekly"), job(2, D(2026, 7, 6), True, D(2026, 7, 9), "quarterly"), job(3, D(2026, 7, 6), True, D(2026, 7, 9))], JOB)
    assert {r["parent_id"]: r["due"] for r in jobs.raise_next(df, days).collect()} == {"j1": D(2026, 7, 16), "j2": D(2026, 10, 7)}
    assert jobs.raise_next(df, days, spark.createDataFrame([(1, "j1"), (1, "j2")], "book_id int, parent_id string")).count() == 0
    sheet = spark.createDataFrame([job(1, None), job(2, D(2026, 1, 1)), job(3, D(2026, 1, 2))], JOB)
    none = sheet.limit(0)
    assert jobs.import_jobs(none, sheet).count() == 3 and jobs.import_jobs(sheet, sheet).count() == 0
    more = spark.createDataFrame([job(9, None, job="job 1"), job(8, D(2026, 5, 5))], JOB)
    assert tuple(jobs.import_counts(sheet, more).first()) == (1, 1, 1)
    week = reports.weekly_work_done(spark.createDataFrame([job(1, D(2026, 8, 30)), job(2, D(2026, 8, 31)), job(3, D(2026, 8, 24), True, D(2026, 8, 31))], JOB)).collect()
    assert {(r["id"], r["week"], r["no"]) for r in week} == {("j1", D(2026, 8, 24), 1), ("j2", D(2026, 8, 31), 1), ("j3", D(2026, 8, 31), 2)}
    assert agenda.roll_daily(spark.createDataFrame([job(1, D(2026, 1, 1), repeat="daily")], JOB), D(2026, 2, 2)).first()["due"] == D(2026, 2, 2)


def test_report_pages(spark):
    df = spark.createDataFrame([job(k, D(2026, 8, 25)) for k in range(1, 5)], JOB)
    pics = spark.createDataFrame([(1, f"j{k}", p, f"p:{k}-{p}") for k, n in ((1, 3), (2, 3), (3, 3), (4, 1)) for p in range(n)], "book_id int, job_id string, pos int, ref string")
    rows = reports.report_layout(df, pics).collect()
    said, rows = [r for r in rows if r["page"] == 1], [r for r in rows if r["page"] > 1]
    assert [(r["no"], r["id"], r["pair"]) for r in sorted(said, key=lambda r: r["no"])] == [(k, f"j{k}", None) for k in range(1, 5)]
    assert len(rows) == 7 and {r["pages"] for r in rows + said} == {5}
    saved = spark.createDataFrame([(1, D(2026, 8, 24), "j3", 1)], "book_id int, week date, id string, place int")
    moved = reports.report_layout(df, pics.limit(0), saved).orderBy("no").collect()
    assert [r["id"] for r in moved] == ["j3", "j1", "j2", "j4"] and {r["pages"] for r in moved} == {1}
    per = {}
    for r in rows:
        per[r["page"]] = per.get(r["page"], 0) + 1 + (r["right_ref"] is not None)
    assert max(per.values()) <= 4 and min(per) == 2


def test_calls(spark):
    schema = "book_id int, id string, port string, kind string, date date, arrival date"
    c = spark.createDataFrame([(1, "k1", "Port A", "lastmin", D(2028, 3, 1), D(2028, 3, 1)), (1, "k2", "", "arrival", D(2028, 3, 1), None)], schema)
    items = spark.createDataFrame([("lastmin", 1, "Item", True, False), ("arrival", 1, "Other", False, False)], "kind string, seq int, item string, ra boolean, ptw boolean")
    rows = {r["call_id"]: r for r in calls.expand_calls(c, items).collect()}
    assert rows["k1"]["due"] == D(2028, 2, 29) and rows["k1"]["job"] == "Item — Port A" and rows["k2"]["job"] == "Other"
    again = spark.createDataFrame([(1, "k3", "PORT A", "lastmin", D(2028, 3, 1), None), (1, "k4", "Port A", "arrival", D(2028, 3, 1), None)], schema)
    assert [r["id"] for r in calls.accept_calls(c, again).collect()] == ["k4"]
    nowhere = spark.createDataFrame([(1, "k5", None, "arrival", D(2028, 3, 1), None)], schema)
    assert calls.accept_calls(nowhere, nowhere).count() == 0 and calls.accept_calls(c, nowhere).count() == 1


def test_ids_and_clocks(spark):
    ids = spark.createDataFrame([("mtihxds0abcde",), ("abc",), ("",), ("z" * 13,), (None,)], "id string")
    assert [r[0] for r in ids.select(ledger.born_at(F.col("id"))).collect()] == [1788256800000, 0, 0, 0, 0]
    clock = spark.createDataFrame([("a", 5000, 3)], "dev string, ms long, c int")
    for seen, want in (((1000, 0), (5000, 4)), ((9000, 7), (9000, 8))):
        got = ledger.absorb_clock(clock, spark.createDataFrame([("a", *seen)], "dev string, ms long, c int"), 100).first()
        assert (got["ms"], got["c"]) == want
    assert sorted((r["ms"], r["c"]) for r in ledger.next_stamps(clock, 3, 9999).collect()) == [(9999, 0), (9999, 1), (9999, 2)]


EDIT = "book_id int, list string, id string, upd long, ctr int, dev string, amount double, deleted boolean"


@pytest.mark.parametrize("seed", range(3))
def test_merge_in_any_order(spark, tmp_path, seed):
    """Random edits in k files, shuffled and repeated: the same ledger each time, from the batch and from the stream."""
    r = random.Random(seed)
    edits = [(1, r.choice(["spend", "income"]), f"s{r.randrange(12)}", r.randrange(6), r.randrange(2), r.choice("ab"), float(r.randrange(100)), r.random() < 0.25) for _ in range(80)]
    want = None
    for _ in range(2):
        own = edits + r.sample(edits, 20)
        r.shuffle(own)
        df = spark.createDataFrame(own, EDIT)
        got = sorted(map(tuple, merge.live_records(merge.reduce_edits(df)).collect()))
        live, dead = df.where("not deleted").drop("deleted"), df.where("deleted").drop("deleted")
        a, b = live.where("upd % 2 = 0"), live.where("upd % 2 = 1")
        for first, second in ((a, b), (b, a)):
            merged = ledger.merge_ledgers(first, second, second, tombs=dead)
            assert sorted(map(tuple, merged.collect())) == got
        assert want is None or want == got
        want = got
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(edits, EDIT).repartition(5).write.parquet(source)
    stream = spark.readStream.schema(spark.createDataFrame(edits, EDIT).schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, progress = f"file://{tmp_path}/out", f"file://{tmp_path}/progress"
    assert merge.last_version(spark, out) is None
    merge.stream_merge(stream, out, progress).awaitTermination()
    assert sorted(map(tuple, merge.live_records(merge.last_version(spark, out)).collect())) == want
    merge.stream_merge(stream, out, progress).awaitTermination()  # a restart without new files
    assert sorted(map(tuple, merge.live_records(merge.last_version(spark, out)).collect())) == want
    assert max(len(v) for v in merge.versions(spark, out).values()) <= 2
    late = [(1, "spend", "s0", 99, 0, "a", 5.0, False)]
    spark.createDataFrame(late, EDIT).write.mode("append").parquet(source)
    before = merge.versions(spark, out)
    merge.stream_merge(stream, out, progress).awaitTermination()
    assert sum(before[b][0] != v[0] for b, v in merge.versions(spark, out).items() if b in before) <= 1
    again = merge.live_records(merge.reduce_edits(spark.createDataFrame(edits + late, EDIT)))
    assert sorted(map(tuple, merge.live_records(merge.last_version(spark, out)).collect())) == sorted(map(tuple, again.collect()))


def test_agenda_with_birthdays(spark):
    today = D(2026, 8, 25)
    rows = [job(1, D(2026, 8, 27)), job(2, D(2026, 8, 20), repeat="daily"), job(3, D(2026, 8, 20))]
    df = spark.createDataFrame(rows, JOB)
    people = spark.createDataFrame([(1, "b1", "2/O Ali", D(1990, 8, 27)), (1, "b2", "Eva (Family)", D(1985, 9, 2))], "book_id int, id string, label string, dob date")
    plan = agenda.build_agenda(df, spark.sql(VIEWS["repeat_days"]), today, 1, people)
    got = {(r["day"], r["id"], r["note"]) for r in plan.where("not daily").collect()}
    assert got == {(D(2026, 8, 27), "j1", ""), (D(2026, 8, 20), "j3", ""), (today, "j3", "overdue"), (D(2026, 8, 27), "b1", ""), (D(2026, 9, 2), "b2", "")}
    daily = sorted((r["day"], r["forecast"]) for r in plan.where("daily").collect())
    assert daily[0] == (today, False) and daily[1:] == [(today + dt.timedelta(k), True) for k in range(1, 32)]
    cells = {r["day"]: r for r in agenda.month_cells(plan).collect()}
    assert cells[D(2026, 8, 27)]["shown"].startswith("2/O Ali; ") and cells[D(2026, 9, 2)]["severity"] == "birthday" and cells[today]["severity"] == "urgent"
    back = agenda.read_agenda(agenda.agenda_payload(plan))
    assert back.count() == plan.count() and {r["job"] for r in back.where("birthday").collect()} == {"2/O Ali", "Eva (Family)"}


def test_backups(spark):
    today = D(2026, 3, 31)
    lists = spark.createDataFrame([(k, "jobs", 0 if k == 5 else 3) for k in range(1, 6)], "book_id int, list string, n long")
    b = spark.createDataFrame([(1, today - dt.timedelta(21), None), (2, today - dt.timedelta(13), None), (3, today - dt.timedelta(21), today - dt.timedelta(8)), (4, today - dt.timedelta(21), today - dt.timedelta(3))], "book_id int, last_backup date, snoozed date")
    assert sorted(r["book_id"] for r in quality.backup_due(lists, b, today).collect()) == [1, 3]


def test_checks_refuse_empty_input(spark):
    empty = spark.createDataFrame([], "category string, unit string, factor double, offset double, name string, cat string, id string, model string")
    for check in (lambda: quality.check_factors(empty, empty), lambda: quality.check_categories(empty), lambda: quality.check_instruments(empty), lambda: quality.check_notes_complete(empty, empty, empty), lambda: quality.check_marks(empty)):
        with pytest.raises(ValueError, match="empty"):
            check()
    with pytest.raises(ValueError, match="references"):
        media.orphan_media(empty, {"jobs": []}, D(2026, 1, 1))


def test_files(spark, tmp_path, monkeypatch):
    sheet = tmp_path / "jobs.csv"
    sheet.write_text("﻿Due Date,Job,Interval\n03-Jul-2026,\"Grease, all\",weekly (7 days)\n,Undated,\nbad,Odd,\n05-Jul-2026,,\n", encoding="utf-8")
    rows = {r["job"]: r for r in files.read_jobs_csv(spark, f"file://{sheet}").collect()}
    assert rows["Grease, all"]["due"] == D(2026, 7, 3) and rows["Grease, all"]["repeat"] == "weekly" and rows["Undated"]["due"] is None and rows["Odd"]["priority"] == "normal" and len(rows) == 3
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed/a.csv").write_text("Job,Due Date,Interval\nShort sheet,05-Jul-2026,weekly (7 days)\n")
    (tmp_path / "mixed/b.csv").write_text("Due Date,Job,Priority,Status,Date Completed,Remarks,Weekly Report,Deck Planner,RA,PTW,Permit Type,Interval\n01-Jul-2026,Long sheet,Urgent,Pending,,\"two\nlines\",Yes,Yes,No,No,,\n")
    mixed = {r["job"]: r for r in files.read_jobs_csv(spark, f"file://{tmp_path}/mixed").collect()}
    assert set(mixed) == {"Short sheet", "Long sheet"} and mixed["Short sheet"]["due"] == D(2026, 7, 5) and mixed["Short sheet"]["priority"] == "normal"
    assert mixed["Long sheet"]["priority"] == "urgent" and mixed["Long sheet"]["remarks"] == "two\nlines" and mixed["Long sheet"]["planner"] and not mixed["Short sheet"]["planner"]
    days = spark.sql(VIEWS["repeat_days"])
    df = spark.createDataFrame([job(1, D(2026, 5, 10), job="Sound, tanks"), job(2, None), job(3, D(2026, 5, 11), True, D(2026, 5, 12))], JOB)
    files.write_jobs_csv(df, days, f"file://{tmp_path}/out")
    back = {r["job"]: r for r in files.read_jobs_csv(spark, f"file://{tmp_path}/out/book_id=1/*.csv").collect()}
    assert back["Sound, tanks"]["due"] == D(2026, 5, 10) and back["job 3"]["done"] and back["job 3"]["date_completed"] == D(2026, 5, 12)
    files.write_ics(df, f"file://{tmp_path}/ics")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "ics").rglob("part-*.txt")).decode()
    assert raw.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0") and raw.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n") and raw.count("BEGIN:VEVENT") == 1 and "SUMMARY:Sound\\, tanks" in raw and "DTSTAMP:" in raw
    lists = {"loans": spark.createDataFrame([(1, "l1", 5.0), (2, "l2", 6.0)], "book_id long, id string, principal double")}
    files.write_backup_json(lists, f"file://{tmp_path}/backup")
    got = files.read_backup_json(spark, f"file://{tmp_path}/backup", {"loans": "id: string, principal: double", "spend": "id: string"})
    assert sorted(map(tuple, got["loans"].collect())) == [(1, "l1", 5.0), (2, "l2", 6.0)] and got["spend"].count() == 0
    own = spark.createDataFrame([(2, "EUR", 3)], "book_id long, currency string, place int")
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty/a.json").write_text('{\n  "app": "opsbook",\n  "book_id": 7,\n  "settings": {\n    "currency": "INR"\n  },\n  "data": {\n    "loans": [\n      {"id": "l9", "principal": 1.5}\n    ]\n  }\n}\n')
    for r in files.backup_documents(lists, settings=own).collect():
        (tmp_path / f"pretty/{r['book_id']}.json").write_text(r["document"] + "\n")
    got = files.read_backup_json(spark, f"file://{tmp_path}/pretty", {"loans": "id: string, principal: double"}, settings="currency: string")
    assert sorted(map(tuple, got["loans"].collect())) == [(1, "l1", 5.0), (2, "l2", 6.0), (7, "l9", 1.5)]
    assert sorted(map(tuple, got["settings"].collect())) == [(2, "EUR"), (7, "INR")]
    monkeypatch.setattr(files, "PART_ROWS", 7)
    many = spark.range(100).selectExpr("id % 2 AS book_id", "concat('l', id) AS id", "id * 1.0D AS principal")
    documents = files.backup_documents({"loans": many}, settings=own)
    assert documents.where("book_id < 2").count() > 10 and documents.where("book_id = 2").count() == 1
    again = files.parse_backups(documents, {"loans": "id: string, principal: double"}, "currency: string")
    assert sorted(map(tuple, again["loans"].collect())) == sorted(map(tuple, many.collect())) and again["settings"].count() == 1
    files.write_ledger_csv(lists, f"file://{tmp_path}/flat")
    assert any(p.read_text().startswith('"list","id","name"') for p in (tmp_path / "flat").rglob("*.csv"))
    good = tmp_path / "i1.json"
    good.write_text('{"format":"opsbook-instruments","version":"1","source":"s","instruments":[{"model":"M","parts":[{"name":"p"}]}]}')
    (tmp_path / "i2.json").write_text("rubbish")
    (tmp_path / "i3.json").write_text('{"format":"other","instruments":[{"model":"N"}]}')
    assert [r["model"] for r in files.read_instruments_json(spark, f"file://{tmp_path}/i*.json").collect()] == ["M"]


def test_sign_off(spark, tmp_path):
    tables = {"jobs": spark.createDataFrame([(1, "a"), (2, "b")], "book_id int, id string"), "birthdays": spark.createDataFrame([(1, "x")], "book_id int, id string")}
    left = files.sign_off(tables, spark.createDataFrame([(1,)], "book_id int"), f"file://{tmp_path}/archive")
    assert [r["id"] for r in left["jobs"].collect()] == ["b"] and left["birthdays"].count() == 1
    assert spark.read.parquet(f"file://{tmp_path}/archive/jobs").count() == 1


def test_sign_off_that_fails_goes_on(spark, tmp_path, monkeypatch):
    """After the second of three tables fails to come there is no archive and nothing is cleared; the next call finishes."""
    names = ("jobs", "crew", "cargo")
    tables = {n: spark.createDataFrame([(1, n), (2, "b"), (3, "c")], "book_id int, id string") for n in names}
    books, at = spark.createDataFrame([(1,), (2,)], "book_id int"), f"file://{tmp_path}/deep/archive"
    staged, whole = [], archive.stage_table

    def stage(df, path):
        if len(staged) == 2:
            raise OSError("lost")
        staged.append(path.rpartition("/")[2])
        whole(df, path)

    with monkeypatch.context() as m:
        m.setattr(archive, "stage_table", stage)
        with pytest.raises(OSError, match="lost"):
            files.sign_off(tables, books, at)
    assert not (tmp_path / "deep/archive").exists() and archive.archived(spark, at) is None
    again = []
    monkeypatch.setattr(archive, "stage_table", lambda df, path: (again.append(path.rpartition("/")[2]), whole(df, path)))
    left = files.sign_off(tables, books, at)
    assert staged == ["jobs", "crew"] and again == ["cargo"] and {n: df.count() for n, df in left.items()} == dict.fromkeys(names, 1)
    assert archive.archived(spark, at)["rows"] == dict.fromkeys(names, 2) and not (tmp_path / "deep/archive.staging").exists()
    (tmp_path / "deep/archive" / archive.RECORD).unlink()  # lost after the rename: the call writes it again
    assert files.sign_off(tables, books, at)["jobs"].count() == 1 and len(again) == 1
    with pytest.raises(ValueError, match="other books"):
        files.sign_off(tables, spark.createDataFrame([(3,)], "book_id int"), at)


def folded_plainly(t, width=74):
    lines, line = [], ""
    for ch in t:
        if len((line + ch).encode()) > width:
            lines, line = [*lines, line], ch
        else:
            line += ch
    return "\r\n ".join([*lines, line])


def test_folding_is_one_pass(spark):
    """Random texts beside the plain rule, a long one, and no work on single characters, which cost the length's square."""
    r = random.Random(5)
    texts = ["".join(r.choice(chars) for _ in range(n)) for chars in ("a b\r\n", "aé", "aé日😀\n", "́x$\\") for n in (0, 1, 73, 74, 75, 76, 148, 149, 500)] + ["é日" * 100_000 + "x" * 300_000]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string").select("id", text.ics_fold(F.col("t")).alias("line"))
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {x["id"]: x["line"] for x in rows.collect()}
    assert [got[k] for k in range(len(texts))] == [folded_plainly(t) for t in texts] and got[len(texts)] is None
