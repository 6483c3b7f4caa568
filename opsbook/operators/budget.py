"""Spending, items due, month summaries, goals and holdings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_diff, month_start
from .savings import elapsed_months, fd_value, rd_done, rd_value

CYCLE = {"monthly": 1, "quarterly": 3, "yearly": 12}


def _every() -> F.Column:
    return F.coalesce(*(F.when(F.col("cycle") == c, n) for c, n in CYCLE.items()))


def spend_by_category(spend: DataFrame, month: dt.date | None = None) -> DataFrame:
    rows = spend.withColumn("month", month_start(F.col("date")))
    if month:
        rows = rows.where(F.col("month") == F.lit(month))
    return rows.groupBy("book_id", "month", "cat").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def fold_other(parts: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """parts (keys…, label, value): the n largest and one `Other (k)`, with shares of the whole."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "label"))
    size = F.count("*").over(Window.partitionBy(*keys))
    rows = parts.withColumns({"rn": rn, "size": size})
    label = F.when(F.col("rn") <= n, F.col("label")).otherwise(F.concat(F.lit("Other ("), (F.col("size") - n).cast("string"), F.lit(")")))
    folded = rows.groupBy(*keys, label.alias("label"), F.least("rn", F.lit(n + 1)).alias("place")).agg(F.sum("value").alias("value"))
    return folded.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy(*keys)))


def category_groups(spend: DataFrame, category_group: DataFrame, listed: DataFrame) -> DataFrame:
    """Categories in use with their group, `Yours` without one; `unlisted` says the book's list (book_id, cat) no longer
    has it."""
    used = spend.groupBy("book_id", "cat").agg(F.count("*").alias("n"))
    own = listed.select("book_id", "cat", F.lit(False).alias("_no")).distinct()
    j = used.join(category_group.select("cat", "group"), "cat", "left").join(own, ["book_id", "cat"], "left")
    return j.select("book_id", "cat", "n", F.coalesce("group", F.lit("Yours")).alias("group"), F.coalesce("_no", F.lit(True)).alias("unlisted"))


def items_due(items: DataFrame, months: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """Items that land in each month: from their start month, every 1, 3 or 12 months; and the average a month.

    months is a short list; each month is matched to the items whose start falls on it within their cycle, an
    equality on (cycle, remainder). received: (book_id, id, month, amount).
    """
    place = F.year("month") * 12 + F.month("month")
    cycles = F.explode(F.array(*(F.struct(F.lit(c).alias("cycle"), F.lit(n).alias("n")) for c, n in CYCLE.items()))).alias("k")
    when = months.select("month", cycles).select(F.col("k.cycle").alias("cycle"), F.pmod(place, F.col("k.n")).alias("rest"), "month")
    start = F.pmod(F.year("start") * 12 + F.month("start"), _every())
    rows = items.withColumn("rest", start).join(when, ["cycle", "rest"]).where(month_diff(F.col("start"), F.col("month")) >= 0)
    out = rows.select("book_id", "list", "id", "name", "month", "amount", (F.col("amount") / _every()).alias("average"))
    if received is None:
        return out
    got = received.groupBy("book_id", "id", "month").agg(F.sum("amount").alias("received"))
    return out.join(got, ["book_id", "id", "month"], "left").withColumn("received", F.coalesce("received", F.lit(0.0)))


def month_summary(items: DataFrame, schedule: DataFrame, loans: DataFrame, spend: DataFrame, months: DataFrame) -> DataFrame:
    """(book_id, month, income, instalments, fixed, spent, left) of every book and month with any of them."""
    key = ["book_id", "month"]
    due = items_due(items, months)
    income = due.where("list = 'income'").groupBy(*key).agg(F.sum("amount").alias("income"))
    fixed = due.where("list = 'fixed'").groupBy(*key).agg(F.sum("amount").alias("fixed"))
    rows = schedule.join(loans.select("book_id", F.col("id").alias("loan_id"), "start"), ["book_id", "loan_id"])
    rows = rows.withColumn("month", F.add_months(month_start(F.col("start")), F.col("month_no") - 1)).join(months.select("month"), "month", "left_semi")
    paid = rows.groupBy(*key).agg(F.sum(F.col("interest") + F.col("principal_paid")).alias("instalments"))
    spent = spend.withColumn("month", month_start(F.col("date"))).join(months.select("month"), "month", "left_semi").groupBy(*key).agg(F.sum("amount").alias("spent"))
    out = income.join(paid, key, "full_outer").join(fixed, key, "full_outer").join(spent, key, "full_outer").na.fill(0.0)
    return out.withColumn("left", F.col("income") - F.col("instalments") - F.col("fixed") - F.col("spent"))


def spend_rate(spend: DataFrame, month: dt.date, today: dt.date) -> DataFrame:
    """(book_id, total, days, per_day, projected): no rate before five days; a past month counts whole."""
    rows = spend.where(month_start(F.col("date")) == F.lit(month)).groupBy("book_id").agg(F.sum("amount").alias("total"), F.max(F.dayofmonth("date")).alias("last"))
    size = F.dayofmonth(F.last_day(F.lit(month)))
    gone = F.when(F.last_day(F.lit(month)) < F.lit(today), size).when(F.lit(today) < F.lit(month), 0).otherwise(F.dayofmonth(F.lit(today)))
    days = F.least(F.greatest(gone, F.col("last")), size)
    out = rows.withColumn("days", days)
    per = F.when(F.col("days") >= 5, F.col("total") / F.col("days"))
    return out.select("book_id", "total", "days", per.alias("per_day"), (per * size).alias("projected"))


def goal_plan(goals: DataFrame, payments: DataFrame, today: dt.date) -> DataFrame:
    """(book_id, id, saved, monthly): what is put by and what each month until the date must add."""
    saved = payments.groupBy("book_id", F.col("goal_id").alias("id")).agg(F.sum("amount").alias("saved"))
    g = goals.join(saved, ["book_id", "id"], "left").withColumn("saved", F.coalesce("saved", F.lit(0.0)))
    left = F.greatest(F.lit(1.0), F.ceil(F.months_between("date", F.lit(today))))
    return g.select("book_id", "id", "saved", (F.greatest(F.col("target") - F.col("saved"), F.lit(0.0)) / left).alias("monthly"))


# --- holdings -----------------------------------------------------------------------------------------------


def holding_values(invest: DataFrame, today: dt.date) -> DataFrame:
    """invest with value and cost: units times price, deposits by their terms."""
    c, on = F.col, F.lit(today)
    fd = fd_value(c("principal"), c("rate"), c("comp"), c("months"), c("start"), on)
    rd = rd_value(c("monthly"), c("rate"), c("comp"), c("months"), c("start"), on)
    paid = c("monthly") * rd_done(c("months"), c("start"), on)
    return invest.withColumns({
        "value": F.when(c("kind") == "fd", fd).when(c("kind") == "rd", rd).otherwise(c("units") * c("price")),
        "cost": F.when(c("kind") == "fd", c("principal")).when(c("kind") == "rd", paid).otherwise(c("units") * c("buy")),
    })


def portfolio_value(invest: DataFrame, today: dt.date) -> DataFrame:
    return holding_values(invest, today).groupBy("book_id", "kind").agg(F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.count("*").alias("n"))


def stale_prices(invest: DataFrame, today: dt.date) -> DataFrame:
    """Priced holdings whose price is more than a month old."""
    return invest.where(~F.col("kind").isin("fd", "rd") & (F.add_months("asof", 1) < F.lit(today)))


def one_per_day(points: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of each key and day, by (upd, ctr, dev)."""
    order = F.struct(*(F.col(c) for c in ("upd", "ctr", "dev") if c in points.columns), *([F.col("p")] if "p" in points.columns else []))
    return points.groupBy(*keys, "d").agg(F.max_by(F.struct(*(c for c in points.columns if c not in (*keys, "d"))), order).alias("r")).select(*keys, "d", "r.*")


def price_asof(holdings: DataFrame, prices: DataFrame, days: list[dt.date], daily: bool = False) -> DataFrame:
    """(book_id, holding_id, day, price): the latest price on or before each of the days, null before the first.

    The days divide a holding's history into ranges. Of a range only its last price matters, which is found by aggregates
    that combine where the prices lie, so a holding of very many prices is spread over tasks; what a range hands to the
    next is carried over one row a day. Of several prices of one day the highest counts; null prices do not. With `daily`,
    holdings have one price a day at most, as one_per_day() gives them: then a range has no more rows than days, and is
    dealt to one task without an aggregate of days before it.
    """
    asked = sorted(days)
    bounds = F.array(*map(F.lit, asked)).cast("array<date>")
    ask = holdings.select("book_id", F.col("id").alias("holding_id"), F.posexplode(bounds).alias("range", "day"))
    known = prices.where(F.col("p").isNotNull() & (F.col("d") <= F.lit(asked[-1]) if asked else F.lit(False)))
    known = known.select("book_id", "holding_id", "d", F.col("p").cast("double").alias("p"), F.size(F.filter(bounds, lambda x: x < F.col("d"))).alias("range"))
    if daily:
        spread = 4 * int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # an aggregate and a join meet in these tasks
        per = known.repartition(spread, "book_id", "holding_id", "range")
    else:
        per = known.groupBy("book_id", "holding_id", "range", "d").agg(F.max("p").alias("p"))
    last = per.groupBy("book_id", "holding_id", "range").agg(F.max_by("p", "d").alias("p"))
    carried = Window.partitionBy("book_id", "holding_id").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    rows = ask.join(last, ["book_id", "holding_id", "range"], "left")
    return rows.select("book_id", "holding_id", "day", F.last("p", ignorenulls=True).over(carried).alias("price"))


def price_trend(prices: DataFrame) -> DataFrame:
    """First and last price of holdings with two prices or more."""
    both = prices.groupBy("book_id", "holding_id").agg(F.min_by("p", "d").alias("first"), F.max_by("p", "d").alias("last"), F.count("*").alias("n"))
    return both.where("n >= 2").withColumn("change", F.col("last") / F.col("first") - 1)


def apply_price_sheet(invest: DataFrame, sheet: DataFrame, asof: dt.date) -> tuple[DataFrame, DataFrame]:
    """(holdings, new points): prices (book_id, id, price) at one date; deposits stay as they are."""
    new = sheet.select("book_id", "id", F.col("price").alias("_p"))
    j = invest.join(new, ["book_id", "id"], "left")
    hit = F.col("_p").isNotNull() & ~F.col("kind").isin("fd", "rd")
    points = j.where(hit).select("book_id", F.col("id").alias("holding_id"), F.lit(asof).alias("d"), F.col("_p").alias("p"), F.lit("sheet").alias("src"))
    return j.withColumns({"price": F.when(hit, F.col("_p")).otherwise(F.col("price")), "asof": F.when(hit, F.lit(asof)).otherwise(F.col("asof"))}).drop("_p"), points


def snapshot(invest: DataFrame, points: DataFrame, asof: dt.date) -> DataFrame:
    """(book_id, d, value, cost): one row for each book that the price sheet touched, all its holdings valued that day."""
    touched = points.select("book_id").distinct()
    per = holding_values(invest, asof).join(touched, "book_id", "left_semi").groupBy("book_id")
    return per.agg(F.sum("value").alias("value"), F.sum("cost").alias("cost")).select("book_id", F.lit(asof).alias("d"), "value", "cost")


def merge_categories(a: DataFrame, b: DataFrame) -> DataFrame:
    """Category lists (book_id, cats) of both sides together, without loss."""
    x, y = a.select("book_id", F.col("cats").alias("_a")), b.select("book_id", F.col("cats").alias("_b"))
    none = F.array().cast("array<string>")
    return x.join(y, "book_id", "full_outer").select("book_id", F.sort_array(F.array_union(F.coalesce("_a", none), F.coalesce("_b", none))).alias("cats"))


def top_up_categories(settings: DataFrame, defaults: list[str], version: int) -> DataFrame:
    """Add the defaults once per version; a book that has this version keeps what it trimmed."""
    old = F.coalesce("cats_v", F.lit(0)) < version
    added = F.array_distinct(F.concat("cats", F.array(*map(F.lit, defaults))))
    return settings.withColumns({"cats": F.when(old, added).otherwise(F.col("cats")), "cats_v": F.greatest(F.coalesce("cats_v", F.lit(0)), F.lit(version))})
