"""Indexed searches beside scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from opsbook.operators import jobs, units
from opsbook.sources import search

NOTE = "id int, category string, title string, body string"


@pytest.fixture(scope="module")
def notes(spark):
    r = random.Random(6)
    words = ["Pump", "valve", "Überlauf", "a", "of", "deck 3", "100%", "O'Neil", "", "x_y", "𝄞clef"]
    rows = [(k, r.choice("abc"), f"{chr(97 + k % 26)}{k} {r.choice(words)}", r.choice([None, " ".join(r.choice(words) for _ in range(r.randrange(12)))])) for k in range(400)]
    return spark.createDataFrame([*rows, (400, None, None, None), (401, "a", "only here: zanzibar", "x")], NOTE)


def test_index_gives_the_rows_of_a_scan(spark, notes, tmp_path):
    at = f"file://{tmp_path}/index"
    search.write_note_index(notes, at, parts=12)
    for text in ("pump", "PUMP V", "ü", "of", "", "zanzibar", "100%", "x_y", "o'neil", "not there at all", "a1", "𝄞cl", "3 100", " "):
        got, want = search.search_index(spark, at, text), jobs.search_notes(notes, text)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), text
        assert got.columns == notes.columns
    assert len(search.parts_with(spark, at, "zanzibar")) == 1 and search.parts_with(spark, at, "ab") is None and search.parts_with(spark, at, "qqq") == []
    plan = search.search_index(spark, at, "zanzibar")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan
    read = [p for p in search.search_index(spark, at, "zanzibar").select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(read) == 1


def test_empty_index(spark, notes, tmp_path):
    search.write_note_index(notes.limit(0), f"file://{tmp_path}/none", parts=3)
    search.write_place_index(spark.createDataFrame([], "name string, lat double"), f"file://{tmp_path}/places")
    assert search.search_places(spark, f"file://{tmp_path}/places", "a").count() == 0


def test_places_by_prefix(spark, tmp_path):
    rows = [(f"{p}{k}", float(k)) for k in range(300) for p in ("Port ", "port-", "Ödland ", "x%")] + [(None, 1.0), ("", 2.0)]
    places, at = spark.createDataFrame(rows, "name string, lat double"), f"file://{tmp_path}/places"
    search.write_place_index(places, at)
    for prefix in ("PORT 1", "port", "ö", "x%2", "none", ""):
        got, want = search.search_places(spark, at, prefix), units.find_places(places, prefix)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), prefix
    plan = search.search_places(spark, at, "port")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(_name,port)" in plan


def test_postings_are_the_runs_of_the_texts(spark, notes, tmp_path, monkeypatch):
    """Beside plain slices: few and very many different characters, texts in chunks; no list of a text's characters in the plan."""
    r = random.Random(7)
    for chars in ("ab ", "aé日😀\x00", "".join(chr(0x4E00 + k) for k in range(400))):
        for _ in range(50):
            texts = ["".join(r.choice(chars) for _ in range(r.randrange(9))) for _ in range(r.randrange(6))]
            assert sorted(search.grams(texts)) == sorted({t[k : k + 3] for t in texts for k in range(len(t) - 2)})
    monkeypatch.setattr(search, "CHUNK", 20)
    batch = search.pa.RecordBatch.from_pydict({"part": [0, 0, 0, 1, 1], "text": ["abcd" * 8, "xbcd", "", "abc", "d"]})
    made = [tuple(x.values()) for b in search._postings(iter([batch])) for x in b.to_pylist()]
    assert set(made) == {(0, "abc"), (0, "bcd"), (0, "cda"), (0, "dab"), (0, "xbc"), (1, "abc")}
    at = f"file://{tmp_path}/runs"
    search.write_note_index(notes, at, parts=5)
    want = {(x["part"], t[k : k + 3]) for x in spark.read.parquet(f"{at}/entries").selectExpr("part", "lower(concat_ws(' ', title, body)) AS t").collect() for t in [x["t"]] for k in range(len(t) - 2)}
    kept = spark.read.parquet(f"{at}/postings")
    assert {tuple(x) for x in kept.select("part", "gram").collect()} == want and kept.count() == len(want)
