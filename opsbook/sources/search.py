"""Indexes for searches that are asked often: an inverted index of trigrams over notes, and places in order of their names.

A search gives the rows that a scan gives; it reads only the files that can hold some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import search_notes

GRAM = 3


BETWEEN = 0xD800  # no character: stands between texts
CHUNK = 1 << 21  # characters looked at together
DENSE = 1 << 24  # runs that are marked in an array; with more characters than that allows, they are sorted


def grams(texts: list[str]) -> list[str]:
    """The different runs of GRAM characters inside the texts; shorter texts have none."""
    points = np.frombuffer(chr(BETWEEN).join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < GRAM:
        return []
    used = np.zeros(0x110000, bool)
    used[points] = True
    chars = np.flatnonzero(used).astype(np.uint32)
    number = np.zeros(0x110000, np.int64)
    number[chars] = np.arange(len(chars))
    at, n = number[points], len(chars)
    runs = at[: len(at) - GRAM + 1]
    for k in range(1, GRAM):
        runs = runs * n + at[k : len(at) - GRAM + 1 + k]
    if n**GRAM <= DENSE:
        marks = np.zeros(n**GRAM, bool)
        marks[runs] = True
        runs = np.flatnonzero(marks)
    else:
        runs = np.unique(runs)
    found = chars[np.stack([runs // n ** (GRAM - 1 - k) % n for k in range(GRAM)], axis=1)]
    whole = np.ascontiguousarray(found[(found != BETWEEN).all(1)]).tobytes().decode("utf-32-le")
    return [whole[k : k + GRAM] for k in range(0, len(whole), GRAM)]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, gram) of rows (part, text), once for each chunk of a part's texts."""

    def made(part: int, texts: list[str]) -> pa.RecordBatch:
        found = grams(texts)
        return pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array(found, pa.string())], ["part", "gram"])

    for batch in batches:
        now, texts, size = None, [], 0
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if texts and (part != now or size >= CHUNK):
                yield made(now, texts)
                texts, size = [], 0
            now, text = part, text.as_py()
            texts.append(text)
            size += len(text)
        if texts:
            yield made(now, texts)


def write_note_index(entries: DataFrame, path: str, parts: int = 64) -> None:
    """Entries (…, category, title, body) in `parts` parts of similar titles, and for each trigram the parts that have it.

    Postings are of parts, not of entries: a trigram has at most `parts` of them, however common it is, and they are
    found where the entries lie, many texts at once, before they are shuffled. They are sorted, so a search reads those of
    its trigrams.
    """
    dealt = entries.repartitionByRange(parts, "category", "title").withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(f"{path}/entries")
    kept = entries.sparkSession.read.schema(dealt.schema).parquet(f"{path}/entries")
    texts = kept.select(F.col("part").cast("int").alias("part"), F.lower(F.concat_ws(" ", "title", "body")).alias("text"))
    postings = texts.mapInArrow(_postings, "part int, gram string").distinct()
    postings.repartitionByRange("gram").sortWithinPartitions("gram", "part").write.parquet(f"{path}/postings")


def parts_with(spark: SparkSession, path: str, text: str) -> list[int] | None:
    """The parts whose entries have all trigrams of the text; None if it has none and every part must be read."""
    wanted = grams([text.lower()])
    if not wanted:
        return None
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(wanted)).groupBy("part").count()
    return [r["part"] for r in found.where(F.col("count") == len(wanted)).select("part").collect()]  # numbers of folders


def search_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """search_notes() of the indexed entries: a part is read if the postings of all trigrams have it, then verified."""
    entries, parts = spark.read.parquet(f"{path}/entries"), parts_with(spark, path, text)
    chosen = entries if parts is None else entries.where(F.col("part").isin(parts) if parts else F.lit(False))
    return search_notes(chosen, text).drop("part")


def write_place_index(places: DataFrame, path: str) -> None:
    """Places in order of their names in lower case, so that a prefix lies in few files and row groups."""
    rows = places.withColumn("_name", F.lower("name"))
    rows.repartitionByRange("_name").sortWithinPartitions("_name").write.parquet(path)


def search_places(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """find_places() of the indexed places; the prefix is pushed to the files' least and greatest names."""
    return spark.read.parquet(path).where(F.col("_name").startswith(prefix.lower())).drop("_name")
