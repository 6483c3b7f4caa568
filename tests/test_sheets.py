"""Quoted sheets, read by splits and written, beside Python's csv."""

from __future__ import annotations

import csv
import datetime as dt
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsbook.plans.views import VIEWS
from opsbook.sources import files, records


def python_records(text: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab",\n\r', max_size=40))
def test_lines_end_inside_as_python_reads_them(text):
    """The automaton's state after each line decides where records end; so do Python's records."""
    inside, ends, lines = False, [], text.split("\n")
    for k, line in enumerate(lines):
        inside = records.ends_inside(line, inside)
        if not inside:
            ends.append(k)
    start, found = 0, []
    for k in ends:
        found += records.cells_of("\n".join([*lines[start : k + 1], ""]))
        start = k + 1
    if start < len(lines):
        found += records.cells_of("\n".join(lines[start:]))
    assert found == python_records(text)


def test_sheets_in_splits_equal_python(spark, tmp_path, small_splits):
    """Files of many splits: doubled quotes, commas, all line breaks, 200 columns, unclosed and stray quotes."""
    r = random.Random(3)

    def value() -> str:
        return "".join(r.choice(["a", "b", '"', ",", "\n", "\r", "\r\n", "\\", " ", "é", '""']) for _ in range(r.choice([0, 1, 3, 8, 30])))

    want = []
    for f in range(6):
        out = io.StringIO(newline="")
        width = [2, 200, 5, 3, 0, 1][f]
        rows = [[value() for _ in range(width)] for _ in range([120, 12, 60, 1, 0, 90][f])]
        csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        text = out.getvalue() if width else "".join(r.choice(["a", '"', ",", "\n", "b", "\r\n", '"x",']) for _ in range(3000)) + '"open'
        (tmp_path / f"f{f}.csv").write_bytes(text.encode())
        want += [(f"f{f}.csv", cells) for cells in python_records(text)]
    got = records.read_records(spark, f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() > 1
    assert [(x["source"].split("/")[-1], x["cells"]) for x in got.orderBy("source", "block", "n").collect()] == want


def test_one_field_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {k}, "quoted"' for k in range(200))
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["Job", "Remarks"], ["first", long], ["second", "x"]])
    (tmp_path / "long.csv").write_bytes(out.getvalue().encode())
    rows = {r["job"]: r["remarks"] for r in files.read_jobs_csv(spark, f"file://{tmp_path}/long.csv").collect()}
    assert rows == {"first": long, "second": "x"}


def test_wide_sheet_and_doubled_quotes(spark, tmp_path):
    names = [f"Extra {k}" for k in range(150)] + ["Job", "Remarks", "Due Date"]
    cells = [f"{k}" for k in range(150)] + ['Check "A" valve, then B', 'say "hi", ok', "03-Jul-2026"]
    out = io.StringIO(newline="")
    csv.writer(out).writerows([names, cells])
    (tmp_path / "wide.csv").write_text(out.getvalue())
    row = files.read_jobs_csv(spark, f"file://{tmp_path}/wide.csv").collect()
    assert [(r["job"], r["remarks"], r["due"]) for r in row] == [('Check "A" valve, then B', 'say "hi", ok', dt.date(2026, 7, 3))]


def test_written_sheets_are_read_by_python_and_here(spark, tmp_path):
    hard = ['Check "A", B', " back\\slash ", "two\nlines", "a\rb", '"', '""', ",", "é\\\"x", "plain"]
    rows = [(1, str(k), f"job {k}", v) for k, v in enumerate(hard)]
    df = spark.createDataFrame(rows, "book_id int, id string, job string, remarks string").selectExpr(
        "book_id", "id", "job", "CAST(NULL AS DATE) AS due", "'normal' AS priority", "false AS done", "CAST(NULL AS DATE) AS date_completed", "remarks",
        "false AS weekly_report", "false AS planner", "false AS ra", "false AS ptw", "'' AS ptw_type", "'' AS repeat",
    )
    files.write_jobs_csv(df, spark.sql(VIEWS["repeat_days"]), f"file://{tmp_path}/out")
    want = {f"job {k}": v for k, v in enumerate(hard)}
    python = {}
    for p in (tmp_path / "out").rglob("*.csv"):
        head, *body = python_records(p.read_bytes().decode())
        python |= {r[head.index("Job")]: r[head.index("Remarks")] for r in body}
    assert python == want
    assert {r["job"]: r["remarks"] for r in files.read_jobs_csv(spark, f"file://{tmp_path}/out/*/*.csv").collect()} == want
    lists = {"notes": spark.createDataFrame([(1, "n1", 'a "b", c\nd')], "book_id int, id string, text string")}
    files.write_ledger_csv(lists, f"file://{tmp_path}/flat")
    (flat,) = (tmp_path / "flat").rglob("*.csv")
    assert python_records(flat.read_bytes().decode()) == [["list", "id", "name", "text"], ["notes", "n1", "", 'a "b", c\nd']]


def test_empty_sheets_give_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("Job,Due Date\n")
    assert files.read_jobs_csv(spark, f"file://{tmp_path}").count() == 0
