"""JSON documents read by splits, beside Python's json."""

from __future__ import annotations

import json
import random

import pytest

from opsbook.sources import documents, files


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(r.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "\n", "é", ":"]) for _ in range(r.randrange(12)))
    if kind < 4:
        return r.choice([1, -2.5, True, None])
    if kind < 6:
        return {f"k{k}": value(r, depth + 1) for k in range(r.randrange(5))}
    return [value(r, depth + 1) for _ in range(r.randrange(5))]


def test_documents_in_splits_equal_python(spark, tmp_path, small_splits):
    """One a line, pretty-printed, several a line, and one longer than many splits."""
    r, want = random.Random(4), []
    for f in range(5):
        own = [{"n": k, "of": f, "v": value(r)} for k in range([60, 40, 50, 1, 0][f])]
        if f == 3:
            own[0]["v"] = [value(r) for _ in range(300)]
        sep, indent = [("\n", None), ("\n", 1), ("  ", None), ("\n", 2), ("", None)][f]
        (tmp_path / f"f{f}.json").write_text(sep.join(json.dumps(d, indent=indent, ensure_ascii=False) for d in own) + ("\n" if f else ""), encoding="utf-8")
        want += own
    got = documents.read_documents(spark, f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() > 1
    key = lambda d: (d["of"], d["n"])
    assert sorted((json.loads(x["document"]) for x in got.collect()), key=key) == sorted(want, key=key)


def test_large_backup_is_read_by_several_tasks(spark, tmp_path, small_splits):
    rows = spark.range(500).selectExpr("id % 3 AS book_id", """concat('l"{', id) AS id""", "id * 1.0D AS principal")
    text = [r["document"] for r in files.backup_documents({"loans": rows}).collect()]
    (tmp_path / "all.json").write_text("\n".join(json.dumps(json.loads(t), indent=1) for t in text))
    got = files.read_backup_json(spark, f"file://{tmp_path}", {"loans": "id: string, principal: double"})["loans"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert documents.lines_of(spark, f"file://{tmp_path}").select("block").distinct().count() > 10


def test_rubbish_is_handed_on(spark, tmp_path):
    (tmp_path / "a.json").write_text('rubbish }} ] {"app": 1}\n{"app": 2, "open": [')
    (tmp_path / "b.json").write_text("")
    got = sorted(r["document"].strip() for r in documents.read_documents(spark, f"file://{tmp_path}").collect())
    assert len(got) >= 2 and any('"app": 2' in d for d in got)
    assert files.read_backup_json(spark, f"file://{tmp_path}", {"loans": "id: string"})["loans"].count() == 0
