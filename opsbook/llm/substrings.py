"""Substring dedup: overlapping content-defined chunks, compared by digest over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

MEAN_WORDS = 5  # a boundary follows a word with probability 1 / MEAN_WORDS
LONG_WORD = 32  # bytes; boundaries fall inside longer words too, as in scripts without spaces
MEAN_CHARS = 16  # there a boundary follows a character with probability 1 / MEAN_CHARS
GREATEST = 96  # bytes between two boundaries
LEAST_BYTES = 128  # of a chunk, about 21 English words; shorter passages stay


def gear_table() -> np.ndarray:
    """256 pseudo-random values: SplitMix64 of the byte."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.uint8)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] in 8 bits, so of the last 8 bytes; by doubling the window."""
    h = GEAR[data]
    for step in (1, 2, 4):
        shifted = h[:-step] << np.uint8(step)
        h = h.copy()
        h[step:] += shifted
    return h


def boundaries(text: bytes) -> np.ndarray:
    """0, the byte offsets at which a chunk may begin or end, and the length; words are one space apart.

    A boundary comes after a word whose last 8 bytes have a hash below a threshold, and in a long word after such
    a character. It depends on those bytes alone: an insertion moves boundaries but changes none further on.
    Only where none comes for GREATEST bytes, one is set that far from the last.
    """
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    if not n:
        return np.zeros(1, np.int64)
    h, space = gear_hash(b), np.flatnonzero(b == 32)
    at = space[h[space - 1] < 256 // MEAN_WORDS] + 1
    size = np.diff(np.concatenate([[-1], space, [n]])) - 1
    if size.max() > LONG_WORD:
        char = np.repeat(size > LONG_WORD, size + 1)[:n] & ((b & 0xC0) != 0x80) & (b != 32)
        char[0] = False
        char[1:] &= (b[:-1] != 32) & (h[:-1] < 256 // MEAN_CHARS)
        at = np.union1d(at, np.flatnonzero(char))
    at = np.concatenate([[0], at, [n]])
    more = (np.diff(at) - 1) // GREATEST
    if more.any():
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = np.repeat(at[:-1], more) + GREATEST * step
        for _ in range(3):  # never inside a character
            extra -= (b[extra] & 0xC0) == 0x80
        at = np.union1d(at, extra)
    return at


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and digest of each chunk: from every boundary to the first that is LEAST_BYTES or more away.

    Chunks overlap, so what two texts share from a boundary on is shared in whole chunks, and a digest stands for one
    unbroken passage. White space counts as one space, and none at a chunk's ends is part of its digest.
    """
    text = b" ".join(data.split())
    at = boundaries(text)
    to = np.searchsorted(at, at + LEAST_BYTES, "left")
    first = np.flatnonzero(to < len(at))
    start, end = at[first], at[to[first]]
    digest = xxhash.xxh3_64_digest
    found = b"".join([digest(text[s:e].strip()) for s, e in zip(start.tolist(), end.tolist())])
    if len(text) != len(data):  # offsets in the text as it is
        b = np.frombuffer(data, np.uint8)
        solid = (b != 32) & ((b < 9) | (b > 13))
        solid[1:] &= ~solid[:-1]
        words, own = np.flatnonzero(solid), np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1])
        start, end = (words[k] + x - own[k] for x, k in ((x, np.searchsorted(own, x, "right") - 1) for x in (start, end)))
    end = np.where(at[to[first]] == len(text), len(data), end)
    return start, end, np.frombuffer(found, ">i8").astype(np.int64)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digests): the distinct chunks of every document, written once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "digests": [np.unique(chunks(t.encode())[2]) if t else [] for t in b["text"]]})

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInPandas(run, "doc_id long, digests array<long>"), "chunks")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, found): digests of a document's chunks that a smaller doc_id has as well, with the smallest.

    Counts are combined before the shuffle, and the join back is an equi-join that adaptive execution
    splits where one digest holds many rows. Rows that repeat a doc_id add nothing.
    """
    rows = chunk_rows(docs).select("doc_id", F.explode("digests").alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin < last")
    hits = rows.join(first.select("digest", "origin"), "digest").where("doc_id > origin")
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct("digest", "origin")).alias("found"))


def repeated_spans(data: bytes, digests: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Byte spans that these chunks cover, and the digests among them that the text has."""
    start, end, own = chunks(data)
    hit = np.isin(own, digests)
    start, end = start[hit], end[hit]
    if not len(start):
        return [], own[hit]
    new = np.flatnonzero(np.concatenate([[True], start[1:] > np.maximum.accumulate(end)[:-1]]))
    return list(zip(start[new].tolist(), np.maximum.reduceat(end, new).tolist())), own[hit]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with a new text, and __removed (bytes, spans, origins): each passage stays where its doc_id is smallest.

    What goes are chunks, each of which one smaller doc_id has in one piece but for its white space.
    A null or empty text stays as it is. Passages that recur only within one document stay. Rows without
    doc_id are neither changed nor compared. Rows that repeat a doc_id count as one document. An empty table
    gives no rows.
    """
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, found in batches:
            out = []
            for t, known in zip(text, found):
                if t is None or known is None:
                    out.append((t, 0, 0, []))
                    continue
                data, origin = t.encode(), {r["digest"]: r["origin"] for r in known}
                spans, used = repeated_spans(data, np.array(list(origin), np.int64))
                keep, at = [], 0
                for s, e in spans:
                    keep.append(data[at:s])
                    at = e
                new = b"".join([*keep, data[at:]]).decode() if spans else t
                out.append((new, sum(e - s for s, e in spans), len(spans), sorted({origin[x] for x in used.tolist()})))
            yield pd.DataFrame(out, columns=["text", "bytes", "spans", "origins"])

    # marked so that a filter on its result does not make it run twice
    edit = F.pandas_udf(run, "text string, bytes long, spans int, origins array<long>").asNondeterministic()
    found = repeated_chunks(docs).select(F.col("doc_id").alias("__id"), F.col("found").alias("__found"))
    joined = docs.join(found, docs["doc_id"].cast("long") == found["__id"], "left").withColumn("__removed", edit(docs["text"].cast("string"), "__found"))
    return joined.drop("__id", "__found").withColumn("text", F.col("__removed.text"))
