"""Operators that spread hot keys: beside plain rules on random rows, with their plans."""

from __future__ import annotations

import datetime as dt
import random
from bisect import bisect_right

import numpy as np
from pyspark.sql import functions as F

from opsbook.operators import budget, ledger, savings, units

D = dt.date


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prices_asof_equal_the_plain_rule(spark):
    r = random.Random(7)
    start = D(2024, 1, 1)
    holdings = [(b, f"h{k}") for b in range(2) for k in range(5)]
    prices = [(b, f"h{r.choice([0, 0, 0, 1, 2, 3])}", start + dt.timedelta(r.randrange(60)), r.choice([None, 1.0, 2.0, 5.0])) for b in range(2) for _ in range(200)]
    days = [start + dt.timedelta(k) for k in (40, 3, 10, 10, 90, -5)]
    got = budget.price_asof(spark.createDataFrame(holdings, "book_id int, id string"), spark.createDataFrame(prices, "book_id int, holding_id string, d date, p double"), days)
    want = []
    for b, h in holdings:
        for day in days:
            known = [(d, p) for x, y, d, p in prices if (x, y) == (b, h) and p is not None and d <= day]
            want.append((b, h, day, max(known)[1] if known else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert budget.price_asof(spark.createDataFrame(holdings, "book_id int, id string"), spark.createDataFrame(prices, "book_id int, holding_id string, d date, p double"), []).count() == 0


def test_history_is_not_windowed(spark):
    """What is sorted by holding is a row a day asked for, never the prices."""
    prices = spark.range(1000).selectExpr("0 AS book_id", "'h' AS holding_id", "date_add(date'2024-01-01', cast(id % 50 as int)) AS d", "id * 1.0 AS p")
    text = plan(budget.price_asof(spark.createDataFrame([(0, "h")], "book_id int, id string"), prices, [D(2024, 2, 1)]))
    assert "SortAggregate" not in text and text.count("Window ") == 1


def table_value(xs, ys, x):
    if x is None:
        return None, "no value"
    if not xs or x < xs[0] or x > xs[-1] or np.isnan(x):
        return None, "out of range"
    k = min(bisect_right(xs, x) - 1, len(xs) - 2)
    return ys[k] + (x - xs[k]) / (xs[k + 1] - xs[k]) * (ys[k + 1] - ys[k]), "ok"


def test_interpolation_by_cells(spark):
    """Even and uneven axes, ends, points on the table's own values, missing products and values."""
    r = random.Random(8)
    axes = {"even": [k / 7 for k in range(60)], "uneven": sorted(10 ** r.uniform(-6, 6) for _ in range(80)), "two": [1.0, 2.0], "negative": [-5.0, -1.0, 0.0, 3.0]}
    ys = {p: [r.uniform(-9, 9) for _ in xs] for p, xs in axes.items()}
    table = [(p, x, y) for p, xs in axes.items() for x, y in zip(xs, ys[p])]
    points = [(k, p, x) for k, (p, x) in enumerate((p, x) for p, xs in axes.items() for x in [*xs, None, float("nan"), xs[0] - 1, xs[-1] + 1, *(r.uniform(xs[0], xs[-1]) for _ in range(50))])]
    points += [(9999, "none", 1.0), (9998, None, 1.0)]
    got = units.interp_lookup(spark.createDataFrame(points, "id int, product string, x double"), spark.createDataFrame(table, "product string, x double, y double"), "x", ["y"])
    rows = {row["id"]: row for row in got.collect()}
    assert len(rows) == len(points) == got.count()
    for k, p, x in points:
        value, status = table_value(axes.get(p, []), ys.get(p, []), x)
        assert rows[k]["status"] == status and (value is None) == (rows[k]["y"] is None) and (value is None or abs(value - rows[k]["y"]) < 1e-9 * max(1, abs(value)))


def test_a_long_table_of_one_product(spark):
    """200,000 intervals and as many points: each point meets those of its cell alone."""
    table = spark.range(200_001).selectExpr("'p' AS product", "id * 1.0D AS x", "id * 2.0D AS y")
    points = spark.range(200_000).selectExpr("id", "'p' AS product", "(id * 7919 % 200000) + 0.25D AS x")
    got = units.interp_lookup(points, table, "x", ["y"])
    assert got.where("status = 'ok' and abs(y - 2 * x) < 1e-6").count() == 200_000


def test_rates_cost_their_flows(spark):
    """A flow after 100,000 months, an early one, Newton beside halving, and the number of changes of sign."""
    rows = [("far", 0, -100.0), ("far", 100_000, 100.0 * 1.0001**100_000), ("year", 0, -1000.0), ("year", 12, 1126.825), ("loss", 0, -100.0), ("loss", 600, 1.0)]
    rows += [("two", 0, -100.0), ("two", 1, 230.0), ("two", 2, -132.0), ("none", 0, 5.0), ("none", 3, 5.0), ("null", 0, None), ("null", None, 3.0)]
    got = {r["id"]: r for r in savings.irr(spark.createDataFrame(rows, "id string, month long, amount double"), ["id"], changes=True).collect()}
    assert abs(got["far"]["monthly_rate"] - 0.0001) < 1e-12 and abs(got["year"]["monthly_rate"] - 0.01) < 1e-6
    assert abs(got["loss"]["monthly_rate"] - (0.01 ** (1 / 600) - 1)) < 1e-12
    assert got["two"]["sign_changes"] == 2 and got["year"]["sign_changes"] == 1 and got["none"]["monthly_rate"] is None and got["none"]["sign_changes"] == 0
    assert "null" not in got


def test_rates_are_roots():
    rng = np.random.default_rng(3)
    months = [np.sort(rng.choice(400, 30, replace=False)).astype(float) for _ in range(200)]
    amounts = [np.where(np.arange(30) < 20, -1, 1) * rng.uniform(1, 100, 30) for _ in range(200)]
    rates = savings.solve_rates(months, amounts)
    for m, a, r in zip(months, amounts, rates):
        worth = (a * (1 + r) ** (-m)).sum()
        assert abs(worth) < 1e-6 * np.abs(a * (1 + r) ** (-m)).sum()


def test_diff_reads_differing_parts_alone(spark):
    rows = [(b, lst, f"i{k}", float(k)) for b in range(5) for lst in ("spend", "loans") for k in range(40)]
    schema = "book_id int, list string, id string, amount double"
    other = [x for x in rows if x[:3] != (2, "spend", "i7")] + [(2, "spend", "i8", 8.0), (None, "spend", "n", 1.0)]
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    want = sorted(map(repr, map(tuple, ledger.ledger_diff(a, b).collect())))
    assert len(want) == 3
    for keys, bucket in ((["book_id"], None), (["book_id", "list"], None), (["book_id", "list"], "id")):
        assert sorted(map(repr, map(tuple, ledger.ledger_diff(a, b, keys, bucket).collect()))) == want
    assert ledger.ledger_diff(a, a, ["book_id"], "id").count() == 0 and ledger.ledger_digests(a, ["book_id"]).count() == 5
    x, y = ledger.ledger_digests(a, ["book_id"]), ledger.ledger_digests(b, ["book_id"])
    assert x.join(y, ["book_id", "rows", "sum", "xor"]).count() == 4
    assert ledger.ledger_digests(a.orderBy(F.rand(1)), ["book_id"]).exceptAll(x).count() == 0


def odd_plans(spark):
    """Terms at which a geometric sum is not to be divided out: no rate, no step, steps that equal the growth or nearly."""
    r, rows = random.Random(9), []
    for rate, step in ((0.0, 0.0), (0.0, 10.0), (12.0, 0.0), (12.0, (1.01**12 - 1) * 100), (12.0, (1.01**12 - 1) * 100 + 1e-9), (1e-9, 1e-9), (7.0, -100.0), (7.0, -130.0), (-6.0, 5.0), (300.0, 80.0), (8.0, 200.0)):
        rows += [(3, len(rows) + k, r.choice([0.0, 900.0]), r.choice([100.0, 5e4]), rate, years, step, r.choice([1, 4, 12]), 1e6) for k, years in enumerate((1, 2, 7, 30))]
    rows += [(4, 0, None, 100.0, 5.0, 2, 0.0, 12, 1.0), (4, 1, 100.0, None, 5.0, 2, 0.0, 12, 1.0), (4, 2, 100.0, 0.0, None, 2, 0.0, 12, 1.0), (4, 3, None, 0.0, 5.0, 1, 0.0, 12, 1.0), (4, 4, 100.0, 0.0, 5.0, 0, 0.0, 12, 1.0)]
    return rows, spark.createDataFrame(rows, "book_id int, id int, monthly double, lump double, rate double, years int, step double, comp int, target double")


def test_plans_equal_the_plain_rule(spark):
    rows, plans = odd_plans(spark)
    got = {(r["book_id"], r["id"], r["month_no"]): r for r in savings.project_savings(plans).collect()}
    assert len(got) == sum(12 * x[5] for x in rows)
    for book, k, monthly, lump, rate, years, step, comp, _ in rows[:44]:
        g, value, paid = (1 + rate / (100 * comp)) ** (comp / 12), lump, lump
        for month in range(1, 12 * years + 1):
            put = monthly * (1 + step / 100) ** ((month - 1) // 12)
            value, paid, row = (value + put) * g, paid + put, got[book, k, month]
            size = max(1, abs(value), abs(monthly) * max(1, abs(1 + step / 100)) ** years)
            assert abs(row["value"] - value) < 1e-9 * size and abs(row["paid"] - paid) < 1e-9 * max(1, abs(paid), size) and abs(row["instalment"] - put) < 1e-9 * max(1, abs(put))


def test_returns_of_plans_equal_those_of_their_flows(spark):
    _, plans = odd_plans(spark)
    rows = savings.project_savings(plans)

    def table(df, n):
        return {tuple(r)[:n]: tuple(r)[n:] for r in df.collect()}

    for got, want in ((table(savings.plan_rates(plans), 2), table(savings.irr(savings.plan_flows(rows, plans), savings.KEY), 2)), *((table(savings.plan_returns(plans, m), 3), table(savings.period_returns(rows, plans, m), 3)) for m in (3, 5, 12))):
        assert set(got) == set(want) and len(got) > 40
        for k, w in want.items():
            assert all((x is None) == (y is None) and (x is None or abs(x - y) <= 1e-8 * max(1, abs(y))) for x, y in zip(got[k], w)), (k, got[k], w)


def test_months_of_plans_are_not_shuffled(spark, sf_dir):
    """Memory of a task: the plans are dealt out once; no window, sort, aggregate or join sees their months."""
    from opsbook.plans import queries as books

    for name in ("q69_project_savings", "q70_irr", "q71_period_returns", "q66_solve_monthly", "q66_solve_lump"):
        text = plan(books.QUERIES[name](spark, sf_dir))
        assert not any(x in text for x in ("Window", "Sort", "Aggregate", "Join")) and text.count("Exchange") <= 1, name


def test_daily_prices_are_dealt_once(spark):
    """One price a day: the same rows as without saying so, and no aggregate of days before that of ranges."""
    r = random.Random(10)
    start = D(2024, 1, 1)
    holdings = spark.createDataFrame([(b, f"h{k}") for b in range(2) for k in range(6)], "book_id int, id string")
    rows = [(b, f"h{k}", start + dt.timedelta(d), r.choice([None, 1.0, 2.0, 5.0])) for b in range(2) for k in range(5) for d in r.sample(range(60), 25)]
    prices = spark.createDataFrame(rows, "book_id int, holding_id string, d date, p double")
    days = [start + dt.timedelta(k) for k in (40, 3, 10, 10, 90, -5)]
    got, want = (budget.price_asof(holdings, prices, days, daily) for daily in (True, False))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and got.count() == 72
    assert "max(p" in plan(want) and "max(p" not in plan(got) and "SortAggregate" not in plan(got)
    assert budget.price_asof(holdings, prices, [], True).count() == 0
