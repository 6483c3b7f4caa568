"""Queries over loans, deposits, savings, budgets and holdings; money is rounded to 4 places."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import budget, loans, savings
from .registry import query
from .views import VIEWS, view, with_views

TODAY = dt.date(2024, 1, 25)
MONTHS = "SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-07-01', INTERVAL 1 MONTH)) AS DATE) AS month"


def money(df, *cols, places=4, nudge=0.0):
    """Rounded columns; the nudge moves exact halves, which the two engines round differently."""
    return df.withColumns({c: F.round(F.col(c) + nudge, places) + F.lit(0.0) for c in cols})


def _months(spark):
    return spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-06-01', INTERVAL 1 MONTH)) AS month")


EMI = "CASE WHEN rate = 0 THEN principal / months ELSE principal * (rate / 1200) * pow(1 + rate / 1200, months) / (pow(1 + rate / 1200, months) - 1) END"


@query(with_views(f"SELECT book_id, id, round({EMI}, 4) AS emi FROM loans", "loans"))
def q61_emi(spark, sf):
    c = F.col
    return view(spark, sf, "loans").select("book_id", "id", F.round(loans.emi(c("principal"), c("rate"), c("months")), 4).alias("emi"))


@query(with_views(f"""SELECT book_id, id, k, round(CASE WHEN rate = 0 THEN principal - principal / months * k ELSE principal * pow(1 + rate / 1200, k) - ({EMI}) * (pow(1 + rate / 1200, k) - 1) / (rate / 1200) END, 4) + 0.0 AS balance
FROM loans, (VALUES (1), (6), (12)) n(k)""", "loans"))
def q62_loan_balance(spark, sf):
    c = F.col
    rows = view(spark, sf, "loans").withColumn("k", F.explode(F.array(F.lit(1), F.lit(6), F.lit(12))))
    return money(rows.select("book_id", "id", "k", loans.loan_balance(c("principal"), c("rate"), c("months"), c("k")).alias("balance")), "balance")


SCHEDULE = f"""WITH RECURSIVE pre AS (SELECT book_id, loan_id, month_no, sum(amount) AS amount FROM prepayments GROUP BY 1, 2, 3),
base AS (SELECT book_id, id AS loan_id, principal, rate / 1200 AS i, coalesce(emi, {EMI}) AS e FROM loans),
s AS (
  SELECT book_id, loan_id, i, e, 0 AS month_no, CAST(0 AS DOUBLE) AS opening, CAST(0 AS DOUBLE) AS interest, CAST(0 AS DOUBLE) AS principal_paid, CAST(0 AS DOUBLE) AS extra, CAST(principal AS DOUBLE) AS closing, e <= principal * i AS never FROM base
  UNION ALL
  SELECT book_id, loan_id, i, e, month_no, opening, interest, part, extra, CASE WHEN opening - part - extra < 0.005 THEN 0 ELSE opening - part - extra END, never FROM (
    SELECT q.*, CASE WHEN never THEN 0 ELSE least(coalesce(p.amount, 0), opening - part) END AS extra FROM (
      SELECT book_id, loan_id, i, e, month_no + 1 AS month_no, closing AS opening, closing * i AS interest, never,
        CASE WHEN never THEN e - closing * i WHEN closing - least(e - closing * i, closing) < 0.005 THEN closing ELSE least(e - closing * i, closing) END AS part
      FROM s WHERE closing > 0 AND NOT (never AND month_no = 1){{until}}) q LEFT JOIN pre p ON p.book_id = q.book_id AND p.loan_id = q.loan_id AND p.month_no = q.month_no)
), schedule AS (SELECT book_id, loan_id, month_no, opening, interest, principal_paid, extra, closing, never FROM s WHERE month_no > 0)"""


def _recursive(sql, *names, until=""):
    """The views as expressions after WITH RECURSIVE."""
    return SCHEDULE.replace("{until}", until).replace("WITH RECURSIVE pre", "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in ("loans", "prepayments", *names)) + ", pre") + sql


def _schedule(spark, sf, between=None):
    return loans.amortise(view(spark, sf, "loans"), view(spark, sf, "prepayments"), between)


@query(_recursive(" SELECT book_id, loan_id, month_no, round(opening + 1e-7, 4) + 0.0 AS opening, round(interest + 1e-7, 4) + 0.0 AS interest, round(principal_paid + 1e-7, 4) + 0.0 AS principal_paid, round(extra + 1e-7, 4) + 0.0 AS extra, round(closing + 1e-7, 4) + 0.0 AS closing, never FROM schedule"))
def q67_amortise(spark, sf):
    return money(_schedule(spark, sf), "opening", "interest", "principal_paid", "extra", "closing", nudge=1e-7)


@query(_recursive(""" SELECT book_id, loan_id, count(*) AS months, round(sum(interest), 4) + 0.0 AS total_interest,
CASE WHEN NOT bool_or(never) THEN CAST(DATE '2024-01-01' + to_months(CAST(count(*) - 1 AS INT)) AS DATE) END AS payoff FROM schedule GROUP BY 1, 2"""))
def q67_schedule_summary(spark, sf):
    return money(loans.schedule_summary(_schedule(spark, sf), view(spark, sf, "loans")), "total_interest")


@query(_recursive(f""", plain AS (
  SELECT book_id, loan_id, CASE WHEN e <= principal * i THEN 1 ELSE months END AS m0, CASE WHEN e <= principal * i THEN principal * i WHEN i = 0 THEN 0 ELSE e * months - principal END AS i0
  FROM (SELECT book_id, id AS loan_id, principal, rate / 1200 AS i, months, {EMI} AS e FROM loans WHERE emi IS NULL))
SELECT s.book_id, s.loan_id, round(coalesce(sum(interest) FILTER (WHERE month_no <= 18), 0) + 1e-5, 2) + 0.0 AS interest_to_date, round(max_by(closing, CASE WHEN month_no <= 18 THEN month_no END) + 1e-5, 2) + 0.0 AS balance,
count(*) AS months, CASE WHEN NOT bool_or(never) THEN CAST(DATE '2024-01-01' + to_months(CAST(count(*) - 1 AS INT)) AS DATE) END AS clears, any_value(m0) - count(*) AS months_saved, round(any_value(i0) - sum(interest) + 1e-3, 1) + 0.0 AS interest_saved
FROM schedule s JOIN plain USING (book_id, loan_id) GROUP BY 1, 2"""))
def q68_loan_status(spark, sf):
    own = view(spark, sf, "loans").where("emi IS NULL")
    plain = loans.amortise(own)
    out = loans.loan_status(loans.amortise(own, view(spark, sf, "prepayments")), plain, own, dt.date(2025, 6, 15))
    return money(money(out, "interest_to_date", "balance", places=2, nudge=1e-5), "interest_saved", places=1, nudge=1e-3)


GONE = "greatest(0, (2002 - year(start)) * 12 + 6 - month(start) - CASE WHEN day(start) > 15 THEN 1 ELSE 0 END)"
ASOF = dt.date(2002, 6, 15)


@query(with_views("SELECT book_id, id, round(pow(1 + rate / (100 * comp), comp / 12.0), 9) AS growth FROM holdings", "holdings"))
def q63_growth(spark, sf):
    return view(spark, sf, "holdings").select("book_id", "id", F.round(savings.growth(F.col("rate"), F.col("comp")), 9).alias("growth"))


@query(with_views(f"""SELECT book_id, id, round(principal * pow(1 + rate / 400, least({GONE}, months) / 3.0), 4) AS value, round(principal * rate / 400, 4) AS payout FROM holdings WHERE kind = 'fd'""", "holdings"))
def q64_fd_value(spark, sf):
    c = F.col
    v = savings.fd_value(c("principal"), c("rate"), c("comp"), c("months"), c("start"), F.lit(ASOF))
    return view(spark, sf, "holdings").where("kind = 'fd'").select("book_id", "id", F.round(v, 4).alias("value"), F.round(savings.fd_payout(c("principal"), c("rate"), c("comp")), 4).alias("payout"))


@query(with_views(f"""SELECT book_id, id, CAST(any_value(done) AS INT) AS done, round(sum(monthly * pow(1 + rate / 400, (least(gone, months) - j) / 3.0)), 4) AS value FROM (
SELECT *, unnest(range(done)) AS j FROM (SELECT *, least(gone + 1, months) AS done FROM (SELECT *, {GONE} AS gone FROM holdings WHERE kind = 'rd'))) GROUP BY 1, 2""", "holdings"))
def q65_rd_value(spark, sf):
    c, on = F.col, F.lit(ASOF)
    v = savings.rd_value(c("monthly"), c("rate"), c("comp"), c("months"), c("start"), on)
    return view(spark, sf, "holdings").where("kind = 'rd'").select("book_id", "id", savings.rd_done(c("months"), c("start"), on).alias("done"), F.round(v, 4).alias("value"))


PROJECTED = """SELECT book_id, id, CAST(month_no AS INT) AS month_no, lump * pow(g, month_no) + sum_pow AS value, lump + paid AS paid, monthly * pow(1 + step / 100, (month_no - 1) // 12) AS instalment FROM (
  SELECT p.book_id, p.id, p.month_no, p.monthly, p.lump, p.step, p.g, sum(p.monthly * pow(1 + p.step / 100, (j - 1) // 12) * pow(p.g, p.month_no - j + 1)) AS sum_pow, sum(p.monthly * pow(1 + p.step / 100, (j - 1) // 12)) AS paid
  FROM (SELECT *, 1 + rate / 1200 AS g, unnest(range(1, years * 12 + 1)) AS month_no FROM plans) p, range(1, 61) r(j) WHERE j <= p.month_no GROUP BY ALL)"""


@query(with_views(f"SELECT book_id, id, month_no, round(value + 1e-7, 4) AS value, round(paid + 1e-7, 4) AS paid, round(instalment + 1e-7, 4) AS instalment FROM ({PROJECTED})", "plans"))
def q69_project_savings(spark, sf):
    return money(savings.project_savings(view(spark, sf, "plans")), "value", "paid", "instalment", nudge=1e-7)


UNIT = f"""SELECT p.*, u.unit, pow(1 + rate / 1200, years * 12) AS lump_growth FROM plans p JOIN (
SELECT p.book_id, p.id, sum(pow(1 + step / 100, (j - 1) // 12) * pow(1 + rate / 1200, years * 12 - j + 1)) AS unit FROM plans p, range(1, 61) r(j) WHERE j <= years * 12 GROUP BY 1, 2) u USING (book_id, id)"""


@query(with_views(f"SELECT book_id, id, round(greatest((target - lump * lump_growth) / unit, 0), 4) AS needed FROM ({UNIT})", "plans"))
def q66_solve_monthly(spark, sf):
    return money(savings.solve_monthly(view(spark, sf, "plans")), "needed")


@query(with_views(f"SELECT book_id, id, round(greatest((target - monthly * unit) / lump_growth, 0), 4) AS needed FROM ({UNIT})", "plans"))
def q66_solve_lump(spark, sf):
    return money(savings.solve_lump(view(spark, sf, "plans")), "needed")


@query(with_views("SELECT book_id, id, round(rate / 1200, 8) AS monthly_rate, round(pow(1 + rate / 1200, 12) - 1, 8) AS annual FROM plans", "plans"))
def q70_irr(spark, sf):
    """A plan whose growth is its rate must return that rate."""
    return savings.plan_rates(view(spark, sf, "plans")).withColumns({c: F.round(c, 8) for c in ("monthly_rate", "annual")})


@query(with_views(f"""SELECT book_id, id, CAST(month_no // 3 AS INT) AS period, round(value + 1e-7, 4) AS value, round(paid + 1e-7, 4) AS paid, round(pow(1 + rate / 1200, 3) - 1, 7) AS period_return
FROM ({PROJECTED}) JOIN (SELECT book_id, id, rate FROM plans) USING (book_id, id) WHERE month_no % 3 = 0""", "plans"))
def q71_period_returns(spark, sf):
    return money(savings.plan_returns(view(spark, sf, "plans"), 3), "value", "paid", nudge=1e-7).withColumn("period_return", F.round("period_return", 7))


FLOWS = """SELECT book_id, id, month, amount FROM (
  SELECT CAST(o_custkey % 150 AS BIGINT) AS book_id, o_custkey AS id, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INT) AS month,
    CASE WHEN o_orderkey % 4 = 3 THEN o_totalprice / 2 ELSE -o_totalprice END AS amount FROM orders
  UNION ALL SELECT CAST(o_custkey % 150 AS BIGINT), o_custkey, CAST(96 AS INT), sum(o_totalprice) FROM orders GROUP BY 1, 2)"""


# the rate by halving, in SQL: present value of each key's flows at the middle, 46 times
@query(f"""WITH RECURSIVE flows AS ({FLOWS}), ends AS (SELECT book_id, id, sum(amount / pow(1 - 0.99, month)) AS low, sum(amount / pow(1 + 10.0, month)) AS high FROM flows GROUP BY 1, 2),
halves AS (SELECT book_id, id, CAST(-0.99 AS DOUBLE) AS a, CAST(10 AS DOUBLE) AS b, sign(low) AS s, 0 AS n FROM ends WHERE sign(low) * sign(high) < 0
  UNION ALL SELECT book_id, id, CASE WHEN sign(v) = s THEN (a + b) / 2 ELSE a END, CASE WHEN sign(v) = s THEN b ELSE (a + b) / 2 END, s, n + 1 FROM (
    SELECT h.book_id, h.id, a, b, s, n, sum(amount / pow(1 + (a + b) / 2, month)) AS v FROM halves h JOIN flows f ON f.book_id = h.book_id AND f.id = h.id WHERE n < 46 GROUP BY 1, 2, 3, 4, 5, 6))
SELECT e.book_id, e.id, round((a + b) / 2, 7) AS monthly_rate FROM ends e LEFT JOIN (SELECT * FROM halves WHERE n = 46) h ON h.book_id = e.book_id AND h.id = e.id""")
def q70_irr_of_uneven_flows(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    return savings.irr(spark.sql(FLOWS), savings.KEY).select("book_id", "id", F.round("monthly_rate", 7).alias("monthly_rate"))


@query(with_views("SELECT book_id, CAST(date_trunc('month', date) AS DATE) AS month, cat, round(sum(amount), 4) AS total, count(*) AS n FROM spend GROUP BY ALL", "spend"))
def q42_spend_by_category(spark, sf):
    return money(budget.spend_by_category(view(spark, sf, "spend")), "total")


@query(with_views("""SELECT book_id, CASE WHEN rn <= 6 THEN cat ELSE 'Other (' || CAST(k - 6 AS STRING) || ')' END AS label, CAST(least(rn, 7) AS INT) AS place, round(sum(total), 4) AS value, round(sum(total) / any_value(whole), 6) AS share
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY total DESC, cat) AS rn, count(*) OVER (PARTITION BY book_id) AS k, sum(total) OVER (PARTITION BY book_id) AS whole
FROM (SELECT book_id, cat, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM spend GROUP BY 1, 2)) GROUP BY 1, 2, 3""", "spend"))
def q43_fold_other(spark, sf):
    exact = view(spark, sf, "spend").groupBy("book_id", F.col("cat").alias("label")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("value"))
    return money(budget.fold_other(exact, ["book_id"]), "value").withColumn("share", F.round("share", 6))


@query(with_views("""SELECT book_id, cat, count(*) AS n, CASE WHEN CAST(substr(cat, 4) AS INT) < 5 THEN 'House' WHEN CAST(substr(cat, 4) AS INT) < 11 THEN 'Travel' ELSE 'Yours' END AS "group",
CAST(substr(cat, 4) AS INT) >= 14 - book_id % 3 AS unlisted FROM spend GROUP BY book_id, cat""", "spend"))
def q36_category_groups(spark, sf):
    groups = spark.range(11).select(F.concat(F.lit("cat"), "id").alias("cat"), F.when(F.col("id") < 5, "House").otherwise("Travel").alias("group"))
    own = view(spark, sf, "spend")
    listed = own.select("book_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), (13 - F.col("book_id") % 3).cast("int"))))
    return budget.category_groups(own, groups, listed.select("book_id", F.concat(F.lit("cat"), "k").alias("cat")))


K = "CASE cycle WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END"
DUE = f"""SELECT book_id, list, id, name, month, amount, amount / ({K}) AS average FROM cash_items, ({MONTHS}) m
WHERE (year(month) - year(start)) * 12 + month(month) - month(start) >= 0 AND ((year(month) - year(start)) * 12 + month(month) - month(start)) % ({K}) = 0"""


@query(with_views(f"SELECT book_id, list, id, month, round(amount, 4) AS amount, round(average, 4) AS average, round(CASE WHEN month = DATE '2024-01-01' THEN amount / 2 ELSE 0 END, 4) AS received FROM ({DUE})", "cash_items"))
def q44_items_due(spark, sf):
    items = view(spark, sf, "cash_items")
    got = items.select("book_id", "id", F.lit(dt.date(2024, 1, 1)).alias("month"), (F.col("amount") / 2).alias("amount"))
    return money(budget.items_due(items, _months(spark), got).drop("name"), "amount", "average", "received")


@query(_recursive(f""", due AS ({DUE}), inc AS (SELECT book_id, month, sum(amount) AS income FROM due WHERE list = 'income' GROUP BY 1, 2), fix AS (SELECT book_id, month, sum(amount) AS fixed FROM due WHERE list = 'fixed' GROUP BY 1, 2),
inst AS (SELECT book_id, CAST(DATE '2024-01-01' + to_months(month_no - 1) AS DATE) AS month, sum(interest + principal_paid) AS instalments FROM schedule WHERE month_no <= 6 GROUP BY 1, 2),
sp AS (SELECT book_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS spent FROM spend WHERE date >= DATE '2024-01-01' AND date < DATE '2024-07-01' GROUP BY 1, 2)
SELECT book_id, month, round(coalesce(income, 0), 4) AS income, round(coalesce(instalments, 0), 4) AS instalments, round(coalesce(fixed, 0), 4) AS fixed, round(coalesce(spent, 0), 4) AS spent,
round(coalesce(income, 0) - coalesce(instalments, 0) - coalesce(fixed, 0) - coalesce(spent, 0), 4) + 0.0 AS "left"
FROM inc FULL JOIN inst USING (book_id, month) FULL JOIN fix USING (book_id, month) FULL JOIN sp USING (book_id, month)""", "cash_items", "spend", until=" AND month_no < 6"))
def q45_month_summary(spark, sf):
    out = budget.month_summary(view(spark, sf, "cash_items"), _schedule(spark, sf, (dt.date(2024, 1, 1), dt.date(2024, 6, 1))), view(spark, sf, "loans"), view(spark, sf, "spend"), _months(spark))
    return money(out, "income", "instalments", "fixed", "spent", "left")


@query(with_views("""SELECT book_id, round(total, 4) AS total, days, round(CASE WHEN days >= 5 THEN total / days END, 4) AS per_day, round(CASE WHEN days >= 5 THEN total / days * 31 END, 4) AS projected
FROM (SELECT book_id, sum(amount) AS total, CAST(least(greatest(25, max(day(date))), 31) AS INT) AS days FROM spend WHERE date >= DATE '2024-01-01' AND date < DATE '2024-02-01' GROUP BY 1)""", "spend"))
def q46_spend_rate(spark, sf):
    return money(budget.spend_rate(view(spark, sf, "spend"), dt.date(2024, 1, 1), TODAY), "total", "per_day", "projected")


HELD = f"""SELECT *, CASE kind WHEN 'fd' THEN principal * pow(1 + rate / 400, least({GONE}, months) / 3.0)
WHEN 'rd' THEN monthly * pow(1 + rate / 400, (least({GONE}, months) - least({GONE} + 1, months) + 1) / 3.0) * (pow(1 + rate / 400, least({GONE} + 1, months) / 3.0) - 1) / (pow(1 + rate / 400, 1 / 3.0) - 1)
ELSE units * price END AS value, CASE kind WHEN 'fd' THEN principal WHEN 'rd' THEN monthly * least({GONE} + 1, months) ELSE units * buy END AS cost FROM holdings"""


@query(with_views(f"SELECT book_id, kind, round(sum(value), 4) AS value, round(sum(cost), 4) AS cost, count(*) AS n FROM ({HELD}) GROUP BY 1, 2", "holdings"))
def q47_portfolio_value(spark, sf):
    return money(budget.portfolio_value(view(spark, sf, "holdings"), ASOF), "value", "cost")


@query(with_views("SELECT book_id, id, round(saved, 4) AS saved, round(greatest(5000 - saved, 0) / 7, 4) AS monthly FROM (SELECT book_id, goal_id AS id, sum(amount) AS saved FROM goal_payments GROUP BY 1, 2)", "goal_payments"))
def q48_goal_plan(spark, sf):
    paid = view(spark, sf, "goal_payments")
    goals = paid.select("book_id", F.col("goal_id").alias("id")).distinct().withColumns({"target": F.lit(5000.0), "date": F.lit(dt.date(2024, 8, 10))})
    return money(budget.goal_plan(goals, paid, TODAY), "saved", "monthly")


@query(with_views("SELECT book_id, 'spend' AS list, count(*) AS n FROM spend GROUP BY 1 UNION ALL SELECT book_id, 'loans', count(*) FROM loans GROUP BY 1 UNION ALL SELECT book_id, 'invest', count(*) FROM holdings GROUP BY 1", "spend", "loans", "holdings"))
def q49_list_counts(spark, sf):
    from ..operators.quality import list_counts

    return list_counts({"spend": view(spark, sf, "spend"), "loans": view(spark, sf, "loans"), "invest": view(spark, sf, "holdings")})


@query(with_views("""SELECT book_id, id, "asof" FROM (SELECT *, CAST(DATE '2024-01-20' - CAST(substr(id, 2)::INT % 60 AS INT) AS DATE) AS "asof" FROM holdings) WHERE kind NOT IN ('fd', 'rd') AND CAST("asof" + INTERVAL 1 MONTH AS DATE) < DATE '2024-01-25'""", "holdings"))
def q18_stale_prices(spark, sf):
    own = view(spark, sf, "holdings").withColumn("asof", F.date_sub(F.lit(dt.date(2024, 1, 20)), F.col("id").substr(2, 9).cast("int") % 60))
    return budget.stale_prices(own, TODAY).select("book_id", "id", "asof")


@query(with_views("""SELECT h.book_id, h.id AS holding_id, m.day, (SELECT max_by(p, d) FROM prices p WHERE p.book_id = h.book_id AND p.holding_id = h.id AND p.d <= m.day) AS price
FROM holdings h, (SELECT CAST(unnest(range(DATE '1995-06-01', DATE '2002-01-01', INTERVAL 6 MONTH)) AS DATE) AS day) m""", "holdings", "prices"))
def q33_price_asof(spark, sf):
    days = [dt.date(y, m, 1) for y in range(1995, 2002) for m in (6, 12)]
    return budget.price_asof(view(spark, sf, "holdings"), view(spark, sf, "prices"), days, daily=True)


@query("""SELECT holding_id, d, upd, p FROM (SELECT *, row_number() OVER (PARTITION BY holding_id, d ORDER BY upd DESC, p DESC) AS rn
FROM (SELECT 'h' || CAST(l_partkey AS STRING) AS holding_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_orderkey AS upd, l_extendedprice AS p FROM lineitem)) WHERE rn = 1""")
def q56_one_per_day(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("h"), "l_partkey").alias("holding_id"), F.trunc("l_shipdate", "month").alias("d"), F.col("l_orderkey").alias("upd"), F.col("l_extendedprice").alias("p")
    )
    return budget.one_per_day(rows, ["holding_id"])


@query(with_views('SELECT book_id, holding_id, min_by(p, d) AS "first", max_by(p, d) AS "last", count(*) AS n, round(max_by(p, d) / min_by(p, d) - 1, 8) AS change FROM prices GROUP BY 1, 2 HAVING count(*) >= 2', "prices"))
def q57_price_trend(spark, sf):
    return budget.price_trend(view(spark, sf, "prices")).withColumn("change", F.round("change", 8))


@query(with_views("""SELECT book_id, id, round(CASE WHEN kind NOT IN ('fd', 'rd') AND substr(id, 2)::INT % 3 = 0 THEN price * 1.1 ELSE price END, 4) AS price,
CASE WHEN kind NOT IN ('fd', 'rd') AND substr(id, 2)::INT % 3 = 0 THEN DATE '2024-01-25' ELSE start END AS asof FROM holdings""", "holdings"))
def q37_apply_price_sheet(spark, sf):
    own = view(spark, sf, "holdings").withColumn("asof", F.col("start"))
    sheet = own.where("cast(substring(id, 2, 9) as int) % 3 = 0").select("book_id", "id", (F.col("price") * 1.1).alias("price"))
    return money(budget.apply_price_sheet(own, sheet, TODAY)[0].select("book_id", "id", "price", "asof"), "price")


@query(with_views(f"""SELECT book_id, DATE '2002-06-15' AS d, round(sum(CASE WHEN kind IN ('fd', 'rd') OR substr(id, 2)::INT % 3 <> 0 THEN value ELSE value * 1.1 END), 4) AS value, round(sum(cost), 4) AS cost
FROM ({HELD}) GROUP BY book_id HAVING bool_or(kind NOT IN ('fd', 'rd') AND substr(id, 2)::INT % 3 = 0)""", "holdings"))
def q37_snapshot(spark, sf):
    own = view(spark, sf, "holdings").withColumn("asof", F.col("start"))
    sheet = own.where("cast(substring(id, 2, 9) as int) % 3 = 0").select("book_id", "id", (F.col("price") * 1.1).alias("price"))
    return money(budget.snapshot(*budget.apply_price_sheet(own, sheet, ASOF), ASOF), "value", "cost")


@query(with_views("SELECT book_id, string_agg(DISTINCT cat, ',' ORDER BY cat) AS cats FROM spend GROUP BY 1", "spend"))
def q58_merge_categories(spark, sf):
    own = view(spark, sf, "spend")

    def side(where):
        return own.where(where).groupBy("book_id").agg(F.collect_set("cat").alias("cats"))

    return budget.merge_categories(side("note = 'click'"), side("note = 'purchase'")).select("book_id", F.array_join("cats", ",").alias("cats"))


@query(with_views("""SELECT book_id, CASE WHEN book_id % 3 = 0 THEN cats ELSE cats || ',new' END AS cats, 2 AS cats_v FROM (SELECT book_id, string_agg(DISTINCT cat, ',' ORDER BY cat) AS cats FROM spend GROUP BY 1)""", "spend"))
def q58_top_up_categories(spark, sf):
    own = view(spark, sf, "spend").groupBy("book_id").agg(F.sort_array(F.collect_set("cat")).alias("cats"))
    own = own.withColumn("cats_v", F.when(F.col("book_id") % 3 == 0, 2).when(F.col("book_id") % 3 == 1, 1))
    return budget.top_up_categories(own, ["new"], 2).select("book_id", F.array_join("cats", ",").alias("cats"), "cats_v")


@query(with_views("SELECT 'dup' || CAST(k % 4 AS STRING) AS cat, count(*) AS n FROM (SELECT DISTINCT CAST(substr(cat, 4) AS INT) AS k FROM spend) GROUP BY 1 HAVING count(*) > 1", "spend"))
def q92_check_categories(spark, sf):
    from ..operators.quality import check_categories

    cats = view(spark, sf, "spend").select(F.substring("cat", 4, 2).cast("int").alias("k")).distinct()
    return check_categories(cats.select(F.concat(F.lit("dup"), F.col("k") % 4).alias("cat"), F.lit("g").alias("group")))
