"""The ledger merge as a stream: edits arrive in any order, any number of times, and the result is the batch merge's.

No watermark: a late edit is compared by its stamp, and an old one loses anyway. The state is a log-structured table. A
batch appends its own edits as a sorted run; RUNS runs of a level become one of the next; a reader reduces over the runs
there are. So an edit is written once a level, of which there are about log RUNS of the number of batches, whatever the size of the
table. Which runs count is in a manifest for each batch, which appears whole or not at all. A batch that runs again starts
from the manifest before it and writes the same folders.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import KEY, alive, latest
from ..sources.store import file_system, read_text, write_text

EDIT_KEY = [*KEY, "deleted"]
RUNS = 3  # runs of a level that are merged


def reduce_edits(edits: DataFrame) -> DataFrame:
    """For each id the last write and the last delete; the rest can no longer matter."""
    return latest(edits, EDIT_KEY)


def live_records(edits: DataFrame) -> DataFrame:
    """The ledger that the edits (…, deleted) make; as in the batch merge, a delete is of a book's id in any list."""
    cols = [c for c in edits.columns if c != "deleted"]
    return alive(edits.where("not deleted").select(cols), edits.where("deleted").select(cols), ["book_id", "id"])


def manifests(spark: SparkSession, folder: str) -> dict[int, str]:
    """Batch number and path of each manifest."""
    path, store = file_system(spark, f"{folder}/manifests")
    if not store.exists(path):
        return {}
    names = [str(f.getPath()) for f in store.listStatus(path)]
    return {int(n.rpartition("-")[2]): n for n in names if n.rpartition("/")[2].startswith("batch-")}


def runs_before(spark: SparkSession, folder: str, batch: int | None = None, checkpoint: str | None = None) -> list[tuple[int, int, str]]:
    """(level, batch, path) of each run that counts before a batch, or by the last manifest; the newest first."""
    found = {n: p for n, p in manifests(spark, folder).items() if batch is None or n < batch}
    if not found:
        return []
    last = json.loads(read_text(spark, found[max(found)]))
    if checkpoint is not None and last["checkpoint"] != checkpoint:
        raise ValueError(f"{folder} is written by the stream with checkpoint {last['checkpoint']}; another would number its batches anew")
    return [(level, n, f"{folder}/{name}") for level, n, name in last["runs"]]


def versions(spark: SparkSession, folder: str) -> dict[int, list[tuple[int, str]]]:
    """(batch, path) of the runs of each level, the newest first."""
    out: dict[int, list[tuple[int, str]]] = {}
    for level, n, path in runs_before(spark, folder):
        out.setdefault(level, []).append((n, path))
    return out


def _write_run(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)


def append(batch: DataFrame, folder: str, number: int, checkpoint: str = "") -> None:
    """One batch of edits into the table: a run, then a merge of the levels that are full with it, then the manifest.

    An empty batch writes nothing.
    """
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    before = runs_before(spark, folder, number, checkpoint)
    name = f"run-{number:09d}"
    _write_run(reduce_edits(batch), f"{folder}/{name}")
    runs = [(0, number, f"{folder}/{name}"), *before]
    level = 0
    while sum(own == level for own, _, _ in runs) + (level > 0) >= RUNS:  # a merge below adds one here
        level += 1
    if level:
        full = [r for r in runs if r[0] < level]
        merged = f"{folder}/merged-{number:09d}"
        _write_run(reduce_edits(spark.read.schema(batch.schema).parquet(*(p for _, _, p in full))), merged)
        runs = [(level, number, merged), *(r for r in runs if r[0] >= level)]
    listed = [(own, n, p.rpartition("/")[2]) for own, n, p in runs]
    write_text(spark, f"{folder}/manifests/batch-{number:09d}", json.dumps({"checkpoint": checkpoint, "runs": listed}))
    _clean(spark, folder, number, {p for _, _, p in runs} | {p for _, _, p in before})


def _clean(spark: SparkSession, folder: str, number: int, needed: set[str]) -> None:
    """Remove what neither this batch nor the one before, which it would start from again, has in its manifest."""
    kept = {p.rpartition("/")[2] for p in needed} | {"manifests"}
    path, store = file_system(spark, folder)
    for own in store.listStatus(path):
        if own.getPath().getName() not in kept:
            store.delete(own.getPath(), True)
    old = sorted(n for n in manifests(spark, folder) if n < number)[:-1]
    for n in old:
        p, store = file_system(spark, f"{folder}/manifests/batch-{n:09d}")
        store.delete(p, False)


def stream_merge(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold the stream's edits into the table in `folder`, batch by batch, as far as there are files."""
    sink = stream.writeStream.foreachBatch(lambda batch, number: append(batch, folder, number, checkpoint))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_version(spark: SparkSession, folder: str) -> DataFrame | None:
    """All edits that count, as last written by any run of the stream; None before the first."""
    paths = [p for _, _, p in runs_before(spark, folder)]
    return reduce_edits(spark.read.parquet(*paths)) if paths else None
