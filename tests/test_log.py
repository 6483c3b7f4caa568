"""The log-structured table of the streaming merge: runs, levels, manifests, batches that run again."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from opsbook.streaming import merge

EDIT = "book_id int, list string, id string, upd long, ctr int, dev string, amount double, deleted boolean"


def edits(spark, rows):
    return spark.createDataFrame(rows, EDIT)


def some(r, n, ids):
    return [(r.randrange(3), "spend", f"s{r.randrange(ids)}", r.randrange(1000), 0, r.choice("ab"), float(r.randrange(100)), r.random() < 0.2) for _ in range(n)]


def size(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def live(spark, at):
    return sorted(map(tuple, merge.live_records(merge.last_version(spark, at)).collect()))


def test_levels_and_batches_that_run_again(spark, tmp_path):
    r, at, all_rows = random.Random(1), f"file://{tmp_path}/t", []
    for n in range(10):
        rows = some(r, 30, 25)
        all_rows += rows
        merge.append(edits(spark, rows), at, n)
        if n in (2, 5, 8):  # a batch after a merge of runs, again: the same runs, the same ledger
            before = merge.versions(spark, at)
            merge.append(edits(spark, rows), at, n)
            assert merge.versions(spark, at) == before
        assert all(len(v) < merge.RUNS for v in merge.versions(spark, at).values())
        assert live(spark, at) == sorted(map(tuple, merge.live_records(merge.reduce_edits(edits(spark, all_rows))).collect()))
    assert sorted((k, len(v)) for k, v in merge.versions(spark, at).items()) == [(0, 1), (2, 1)]  # 10 = 1 + 9


def test_a_batch_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    r, at = random.Random(2), f"file://{tmp_path}/t"
    for n in range(2):
        merge.append(edits(spark, some(r, 20, 9)), at, n)
    before = live(spark, at)
    rows = some(r, 20, 9)
    with monkeypatch.context() as m:
        m.setattr(merge, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            merge.append(edits(spark, rows), at, 2)
    assert live(spark, at) == before
    merge.append(edits(spark, rows), at, 2)
    assert live(spark, at) != before and list(merge.versions(spark, at)) == [1]


def test_bytes_of_a_batch_follow_the_batch(spark, tmp_path):
    """A small batch after a large table writes a small run, not the table."""
    at, big = f"file://{tmp_path}/t", [(k % 40, "spend", f"s{k}", k, 0, "a", float(k), False) for k in range(60_000)]
    merge.append(edits(spark, big), at, 0)
    table = size(tmp_path / "t")
    merge.append(edits(spark, [(k, "spend", f"s{k}", 10**6, 0, "b", 1.0, False) for k in range(40)]), at, 1)
    assert size(tmp_path / "t") - table < table / 20
    assert merge.last_version(spark, at).count() == 60_000


def test_another_stream_is_refused(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    merge.append(edits(spark, some(random.Random(3), 5, 3)), at, 0, "first")
    with pytest.raises(ValueError, match="first"):
        merge.append(edits(spark, some(random.Random(3), 5, 3)), at, 1, "second")
