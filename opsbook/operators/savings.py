"""Deposits, savings plans and money-weighted returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(rate: Column, comp: Column) -> Column:
    """Growth in a month of a rate compounded comp times a year."""
    return F.pow(1 + rate / (100 * comp), comp / 12)


def elapsed_months(start: Column, as_of: Column) -> Column:
    """Whole completed months, never below 0."""
    return F.greatest(F.lit(0), F.floor(F.months_between(as_of, start)).cast("int"))


def fd_value(principal: Column, rate: Column, comp: Column, months: Column, start: Column, as_of: Column, payout: Column | None = None) -> Column:
    """Value of a fixed deposit; after maturity as at maturity; with periodic payout the principal."""
    value = principal * F.pow(growth(rate, comp), F.least(elapsed_months(start, as_of), months))
    return value if payout is None else F.when(payout == "periodic", principal).otherwise(value)


def fd_payout(principal: Column, rate: Column, comp: Column) -> Column:
    """Interest of one period."""
    return principal * rate / (100 * comp)


def rd_done(months: Column, start: Column, as_of: Column) -> Column:
    return F.least(elapsed_months(start, as_of) + 1, months)


def rd_value(monthly: Column, rate: Column, comp: Column, months: Column, start: Column, as_of: Column) -> Column:
    """Recurring deposit: the instalments paid so far, each grown for its months; at the end, for the whole term."""
    g, gone = growth(rate, comp), F.least(elapsed_months(start, as_of), months)
    done = rd_done(months, start, as_of)
    # instalment j (from 0) has grown gone - j months
    last = gone - done + 1
    return F.when(rate == 0, monthly * done).otherwise(monthly * F.pow(g, last) * (F.pow(g, done) - 1) / (g - 1))


KEY = ["book_id", "id"]


def _powers(q: Column, n: Column) -> Column:
    """1 + q + … + q^(n-1), also where q is 1 or so near it that q^n - 1 would lose its digits."""
    return F.when(q == 1, n).when(F.abs(q - 1) < 0.5, F.expm1(n * F.log1p(q - 1)) / (q - 1)).otherwise((F.pow(q, n) - 1) / (q - 1))


def _instalment(month_no: Column) -> Column:
    """The instalment of a month from 1: it grows by step percent every 12 months."""
    return F.col("monthly") * F.pow(1 + F.col("step") / 100, F.floor((month_no - 1) / 12))


def _unit(month_no: Column) -> Column:
    """Value after so many months of instalments that begin with 1: whole years first, then those of the year begun."""
    g, s, years = growth(F.col("rate"), F.col("comp")), 1 + F.col("step") / 100, F.floor((month_no - 1) / 12)
    whole = F.pow(g, month_no - 11) * _powers(g, F.lit(12)) * _powers(s * F.pow(g, F.lit(-12)), years)
    return whole + F.pow(s, years) * g * _powers(g, month_no - 12 * years)


def _value(month_no: Column) -> Column:
    return F.col("monthly") * _unit(month_no) + F.col("lump") * F.pow(growth(F.col("rate"), F.col("comp")), month_no)


def _paid(month_no: Column) -> Column:
    s, years = 1 + F.col("step") / 100, F.floor((month_no - 1) / 12)
    return F.col("monthly") * (12 * _powers(s, years) + F.pow(s, years) * (month_no - 12 * years)) + F.col("lump")


def _dealt(plans: DataFrame) -> DataFrame:
    """Plans of a year or more, dealt over tasks before each becomes many rows: few files hold very many plans."""
    spread = int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plans.where("years > 0").repartition(spread, *KEY)  # a number given is kept, however small the plans are


def project_savings(plans: DataFrame) -> DataFrame:
    """(book_id, id, month_no, value, paid, instalment): v = (v + instalment) * g each month, the lump at the start.

    The instalment grows by step percent every 12 months. Each month has a closed form, so no row waits for another and
    only the plans are shuffled, never their months.
    """
    k = F.col("month_no")
    rows = _dealt(plans).withColumn("month_no", F.explode(F.sequence(F.lit(1), F.col("years") * 12)))
    return rows.select(*KEY, "month_no", _value(k).alias("value"), _paid(k).alias("paid"), _instalment(k).alias("instalment"))


def _unit_value(plans: DataFrame) -> DataFrame:
    """Final value of an instalment of 1 with the plan's steps, and the growth of a lump of 1."""
    end = F.col("years") * 12
    return plans.where("years > 0").withColumns({"unit": _unit(end), "lump_growth": F.pow(growth(F.col("rate"), F.col("comp")), end)})


def solve_monthly(plans: DataFrame) -> DataFrame:
    """(book_id, id, needed): the instalment that reaches the target; 0 if the lump does."""
    need = (F.col("target") - F.col("lump") * F.col("lump_growth")) / F.col("unit")
    return _unit_value(plans).select(*KEY, F.greatest(need, F.lit(0.0)).alias("needed"))


def solve_lump(plans: DataFrame) -> DataFrame:
    """(book_id, id, needed): the lump that reaches the target beside the instalments; 0 if they do."""
    need = (F.col("target") - F.col("monthly") * F.col("unit")) / F.col("lump_growth")
    return _unit_value(plans).select(*KEY, F.greatest(need, F.lit(0.0)).alias("needed"))


# --- returns ------------------------------------------------------------------------------------------------


LOW, HIGH = -0.99, 10.0  # monthly rates that are looked for
ROUNDS = 100


def sign_changes(amounts: np.ndarray) -> int:
    """How often flows in order of time change sign: more than one, and several rates may fit."""
    signs = np.sign(amounts[amounts != 0])
    return int((signs[1:] != signs[:-1]).sum())


def solve_rates(months: list[np.ndarray], amounts: list[np.ndarray]) -> np.ndarray:
    """Monthly rate at which each row's flows, in order of their months, are worth nothing; NaN without a change of sign.

    All rows of about as many flows go on together. A bracket around the rate is kept: Newton's step is taken where it
    stays inside, else the bracket is halved. Rows with several changes of sign are halved only, which decides
    between several rates by the bracket's ends alone.
    """
    out = np.full(len(months), np.nan)
    by_size: dict[int, list[int]] = {}
    for k, f in enumerate(amounts):
        if (f > 0).any() and (f < 0).any():
            by_size.setdefault(1 << (len(f) - 1).bit_length(), []).append(k)
    for rows in by_size.values():
        width = max(len(amounts[k]) for k in rows)
        a, m = np.zeros((len(rows), width)), np.zeros((len(rows), width))
        for r, k in enumerate(rows):
            a[r, : len(amounts[k])], m[r, : len(months[k])] = amounts[k], months[k]
        last = m.max(1, keepdims=True)
        single = np.array([sign_changes(amounts[k]) == 1 for k in rows])

        def worth(rate: np.ndarray, a: np.ndarray = a, m: np.ndarray = m, last: np.ndarray = last) -> tuple[np.ndarray, np.ndarray]:
            """Value at the start, or at the end for rates below zero, so that no power grows; and its slope."""
            t = np.where(rate[:, None] < 0, last - m, -m)
            v = a * np.exp(t * np.log1p(rate)[:, None])
            return v.sum(1), (t * v).sum(1) / (1 + rate)

        low, high = np.full(len(rows), LOW), np.full(len(rows), HIGH)
        with np.errstate(all="ignore"):
            at_low, at_high = np.sign(worth(low)[0]), np.sign(worth(high)[0])
            rate = (low + high) / 2
            for _ in range(ROUNDS):
                value, slope = worth(rate)
                same = np.sign(value) == at_low
                low, high = np.where(same, rate, low), np.where(same, high, rate)
                step = rate - value / slope
                good = single & (step > low) & (step < high)
                following = np.where(good, step, (low + high) / 2)
                if (np.abs(following - rate) <= 1e-16 * (1 + np.abs(rate))).all():
                    break
                rate = following
        out[rows] = np.where(at_low * at_high < 0, rate, np.nan)
    return out


def _rates(df: DataFrame, flows: str) -> DataFrame:
    """df with monthly_rate and sign_changes of its column of flows (m, a), one a month in order of the months."""

    def rates(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for m, a in batches:
            months, amounts = ([np.asarray(f, float) for f in s] for s in (m, a))
            yield pd.DataFrame({"rate": solve_rates(months, amounts), "changes": [sign_changes(f) for f in amounts]})

    rate = F.pandas_udf(rates, "rate double, changes int")
    found = df.withColumn("found", rate(F.col(f"{flows}.m"), F.col(f"{flows}.a")))
    return found.withColumns({"monthly_rate": F.nanvl("found.rate", F.lit(None).cast("double")), "sign_changes": F.col("found.changes")}).drop("found")


def _annual() -> Column:
    return (F.pow(1 + F.col("monthly_rate"), 12) - 1).alias("annual")


def irr(flows: DataFrame, key: list[str], changes: bool = False) -> DataFrame:
    """(key…, monthly_rate, annual[, sign_changes]) from signed flows (key…, month, amount); months start at 0.

    Only months with a flow are gathered, so a key costs its flows, not its last month. With `changes` the number of
    changes of sign tells where a rate need not be the only one. Flows without month or amount do not count.
    """
    per = flows.where("month is not null and amount is not null").groupBy(*key, "month").agg(F.sum("amount").alias("amount"))
    whole = per.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("month").cast("double").alias("m"), F.col("amount").cast("double").alias("a")))).alias("f"))
    return _rates(whole, "f").select(*key, "monthly_rate", _annual(), *(["sign_changes"] if changes else []))


def _held(opening: Column, first: Column, n: Column) -> Column:
    """Flows (m, a) of a plan held for n months from month_no `first`: opening value and instalments in, the last value out.

    Amounts that are not known are left out, as irr() does.
    """

    def flow(month: Column, amount: Column) -> Column:
        return F.struct(month.cast("double").alias("m"), amount.cast("double").alias("a"))

    def paid(m: Column) -> Column:
        return F.when(m == 0, F.coalesce(_instalment(first) + opening, _instalment(first), F.nullif(opening, F.lit(0)))).otherwise(_instalment(first + m))

    flows = F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda m: flow(m, -paid(m))), F.array(flow(n, _value(first + n - 1))))
    return F.filter(flows, lambda x: x["a"].isNotNull())


def plan_rates(plans: DataFrame) -> DataFrame:
    """(book_id, id, monthly_rate, annual): irr() of the plan_flows() of a plan, which a plan's row has in it: its months
    are neither shuffled nor sorted, so memory does not grow with the plans."""
    paying = _instalment(F.lit(1)).isNotNull() | (F.col("lump") != 0)  # asked of the terms: asked of the flows, Spark makes them twice
    rows = _dealt(plans.where(paying)).select(*KEY, _held(F.col("lump"), F.lit(1), F.col("years") * 12).alias("f"))
    return _rates(rows, "f").select(*KEY, "monthly_rate", _annual())


def plan_flows(projected: DataFrame, plans: DataFrame) -> DataFrame:
    """Signed flows of a plan: the lump and instalments paid in, the final value taken out at the end."""
    paid = projected.select(*KEY, (F.col("month_no") - 1).alias("month"), (-F.col("instalment")).alias("amount"))
    lump = plans.where("lump <> 0").select(*KEY, F.lit(0).alias("month"), (-F.col("lump")).alias("amount"))
    end = projected.groupBy(*KEY).agg(F.max("month_no").alias("month"), F.max_by("value", "month_no").alias("amount"))
    return paid.unionByName(lump).unionByName(end)


def period_returns(projected: DataFrame, plans: DataFrame, months: int) -> DataFrame:
    """(book_id, id, period, value, paid, period_return): each `months` months, the money-weighted return on opening value
    and flows."""
    each = [*KEY, "period"]
    rows = projected.withColumn("period", F.ceil(F.col("month_no") / months).cast("int"))
    end = rows.groupBy(*each).agg(F.max_by("value", "month_no").alias("value"), F.max_by("paid", "month_no").alias("paid"), F.count("*").alias("n"))
    opening = F.lag("value").over(Window.partitionBy(*KEY).orderBy("period"))
    end = end.join(plans.select(*KEY, "lump"), KEY).withColumn("opening", F.coalesce(opening, F.col("lump")))
    flows = rows.select(*each, ((F.col("month_no") - 1) % months).alias("month"), (-F.col("instalment")).alias("amount"))
    flows = flows.unionByName(end.select(*each, F.lit(0).alias("month"), (-F.col("opening")).alias("amount")))
    flows = flows.unionByName(end.select(*each, F.col("n").cast("int").alias("month"), F.col("value").alias("amount")))
    rate = irr(flows, each)
    return end.join(rate, each).select(*each, "value", "paid", (F.pow(1 + F.col("monthly_rate"), F.col("n")) - 1).alias("period_return"))


def plan_returns(plans: DataFrame, months: int) -> DataFrame:
    """period_returns() of the project_savings() of plans; a period's flows are made from the plan's row, so no period waits
    for another and only the plans are shuffled."""
    end, first = F.col("years") * 12, (F.col("period") - 1) * months + 1
    rows = _dealt(plans).withColumn("period", F.explode(F.sequence(F.lit(1), F.ceil(end / months).cast("int"))))
    rows = rows.withColumns({"first": first, "n": F.least(F.lit(months), end - first + 1)})
    last, opening = F.col("first") + F.col("n") - 1, F.when(F.col("period") == 1, F.col("lump")).otherwise(_value(F.col("first") - 1))
    rows = rows.select(*KEY, "period", _value(last).alias("value"), _paid(last).alias("paid"), "n", _held(opening, F.col("first"), F.col("n")).alias("f"))
    return _rates(rows, "f").select(*KEY, "period", "value", "paid", (F.pow(1 + F.col("monthly_rate"), F.col("n")) - 1).alias("period_return"))
