"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Seeds are counted over all documents and over all items. Every place of a document that has one of an item's starters is
aligned. Not starters are:

- the commonest quarter of the item's distinct seeds, by the number of documents that hold them;
- of the seeds that more than SHARED_ITEMS items have, those of the most items, as long as the words that they cover are
  together less than LEAST_SCORE of the item.

So a copy is aligned if it keeps more than a quarter of the item's seeds and one of them is not in such a shared stem, or if
what it keeps of shared stems covers LEAST_SCORE of the item by itself. A stem that many items have and that is too
short for a hit makes no candidates, however many documents hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SEED = 3  # words in a seed
COMMON = 0.25  # of an item's seeds, the commonest: no candidates by themselves
SHARED_ITEMS = 16  # items that have a seed: with more it belongs to a shared stem
ROW_ITEMS = 64  # items of a document that are aligned in one row, about
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.4  # of the score that the item has against itself
FILTER_LOG = 26  # the filter of seeds that items have is 2**FILTER_LOG bits, whatever the benchmark's size
CELLS = 4_000_000  # alignment cells computed at once
HELD_WORDS = 4_000_000  # words of windows held before they are aligned

_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}
# scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han; each character counts as a word
_SOLO = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-case alphanumeric words."""
    kept = (text or "").lower()
    if kept.isascii():
        kept = kept.translate(_ASCII)
    else:
        kept = _SOLO.sub(r" \g<0> ", "".join(c if c.isalnum() else " " for c in kept))
    return np.array([xxhash.xxh32_intdigest(w) for w in kept.encode().split()], np.uint32)


def seeds_of(words: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of SEED words."""
    if len(words) < SEED:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - SEED + 1, np.uint64)
    for k in range(SEED):
        h = (h ^ words[k : len(h) + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def item_rows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, size, words, seeds, places): each different item with a number of its own, written once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["item_id"], b["text"]):
                words = words_of(t)
                seeds, place = np.unique(seeds_of(words), return_index=True)
                out.append((i, len(words), words.tobytes(), seeds.view(np.int64), place))
            yield pd.DataFrame(out, columns=["item_id", "size", "words", "seeds", "places"])

    source = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    made = source.mapInPandas(run, "item_id long, size int, words binary, seeds array<long>, places array<int>")
    return cut(made.withColumn("item", F.monotonically_increasing_id()), "items")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds' upper FILTER_LOG bits as 64-bit words: of fixed size, however many seeds there are."""
    word = F.shiftrightunsigned("seed", 70 - FILTER_LOG)
    bit = F.shiftrightunsigned("seed", 64 - FILTER_LOG).bitwiseAND(F.lit(63)).cast("int")
    rows = seeds.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out, found = np.zeros(1 << (FILTER_LOG - 6), np.uint64), rows.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def seed_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, seed, place, first): places of documents whose seed passes the filter, written once; first in its document."""
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for b in batches:
            ids, found = [], []
            for i, t in zip(b["doc_id"], b["text"]):
                own = seeds_of(words_of(t))
                at = own >> np.uint64(64 - FILTER_LOG)
                place = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                if len(place):
                    first = np.zeros(len(place), bool)
                    first[np.unique(own[place], return_index=True)[1]] = True
                    ids.append(np.full(len(place), i))
                    found.append((own[place].view(np.int64), place, first))
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), **{c: np.concatenate(x) for c, x in zip(("seed", "place", "first"), zip(*found))}})

    return cut(docs.mapInPandas(run, "doc_id long, seed long, place int, first boolean"), "seed-hits")


def covered(places: np.ndarray, size: int) -> int:
    """Words of an item that seeds at these places cover."""
    words = np.zeros(size, bool)
    for k in range(SEED):
        words[places + k] = True
    return int(words.sum())


def starters(words: np.ndarray, seeds: np.ndarray, docs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which of an item's seeds, held by so many documents and items, start a comparison."""
    rank = np.empty(len(seeds), np.int64)
    rank[np.lexsort((seeds, docs))] = np.arange(len(seeds))
    starts = (docs > 0) & (rank < len(seeds) - int(len(seeds) * COMMON))
    stem = np.flatnonzero(items > SHARED_ITEMS)
    if len(stem):
        stem = stem[np.lexsort((seeds[stem], -docs[stem], -items[stem]))]
        own = seeds_of(words).view(np.int64)
        low, high = 0, len(stem)  # how many can go: covered words only grow with it
        while low < high:
            k = (low + high + 1) // 2
            if covered(np.flatnonzero(np.isin(own, seeds[stem[:k]])), len(words)) < LEAST_SCORE * len(words):
                low = k
            else:
                high = k - 1
        starts[stem[:low]] = False
    return starts


def starting_seeds(items: DataFrame, seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """(item, seed, at) of the starters of each item; documents that have a seed are counted once each."""
    docs = hits.where("first").groupBy("seed").agg(F.count("*").alias("docs"))
    both = seeds.groupBy("seed").agg(F.count("*").alias("items")).join(docs, "seed", "left")
    own = seeds.join(both, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "at", F.coalesce("docs", F.lit(0)).alias("docs"), "items")).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, words, known in zip(b["item"], b["words"], b["known"]):
                seed, at, n, m = (np.array([x[c] for x in known], np.int64) for c in ("seed", "at", "docs", "items"))
                keep = starters(np.frombuffer(words, np.uint32), seed, n, m)
                out.append(pd.DataFrame({"item": item, "seed": seed[keep], "at": at[keep].astype(np.int32)}))
            if out:
                yield pd.concat(out)

    return items.select("item", "words").join(own, "item").mapInPandas(run, "item long, seed long, at int")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item, starts): items of which a document has a starter, and where the item would begin in it."""
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    seeds = seeds.select("item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    hits = seed_hits(docs, seeds)
    pairs = hits.select("doc_id", "seed", "place").join(starting_seeds(items, seeds, hits), "seed")
    return pairs.groupBy("doc_id", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("starts"))


def windows(starts: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Bounds of each stretch of a document of so many words with starts near one diagonal."""
    starts, slack = np.sort(starts), size // 4 + 2
    edges = np.concatenate([[0], np.flatnonzero(np.diff(starts) > slack) + 1, [len(starts)]])
    return [(max(0, int(starts[a]) - slack), min(length, int(starts[b - 1]) + size + slack)) for a, b in zip(edges, edges[1:])]


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, row by row of the item for all pairs at once."""
    best = np.zeros(len(items))
    order = np.argsort([len(t) for t in texts], kind="stable")
    at = 0
    while at < len(order):
        take, width = 1, len(texts[order[at]])
        while at + take < len(order) and (take + 1) * max(width, len(texts[order[at + take]])) <= CELLS // 16:
            width = max(width, len(texts[order[at + take]]))
            take += 1
        part = order[at : at + take]
        at += take
        rows = max(len(items[k]) for k in part)
        x, y = np.full((take, rows), -1), np.full((take, width), -2)
        for r, k in enumerate(part):
            x[r, : len(items[k])], y[r, : len(texts[k])] = items[k], texts[k]
        kind = np.int16 if MATCH * rows + width < 30_000 else np.int32
        h, top = np.zeros((take, width + 1), kind), np.zeros(take, kind)
        slope = np.arange(width + 1, dtype=kind) * kind(-GAP)
        for c in range(rows):
            step = (y == x[:, c : c + 1]).astype(kind)
            step *= kind(MATCH - MISMATCH)
            step += kind(MISMATCH)
            step += h[:, :-1]
            h += kind(GAP)
            np.maximum(h, 0, out=h)
            np.maximum(h[:, 1:], step, out=h[:, 1:])
            h += slope
            np.maximum.accumulate(h, axis=1, out=h)  # gaps along the text
            h -= slope
            np.maximum(top, h.max(1), out=top)
        best[part] = top
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, words): benchmark items found in documents, best window of each.

    Items of fewer than 3 words have no seed and match nothing, as do null texts; rows without id are left out.
    Rows that repeat a doc_id or an item_id count together. Empty tables give no rows.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = item_rows(benchmark)
    pairs = cut(candidates(docs, items), "candidates")
    rows = pairs.groupBy("doc_id").agg(F.ceil(F.count("*") / ROW_ITEMS).cast("int").alias("rows"))
    found = pairs.join(rows, "doc_id").withColumn("row", F.pmod(F.xxhash64("item"), "rows"))
    found = found.join(items.select("item", "item_id", F.col("words").alias("own")), "item")
    found = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item_id", "own", "starts")).alias("found")).drop("row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def aligned(held: list[tuple]) -> pd.DataFrame:
            own, texts = [x[2].astype(np.int64) for x in held], [x[4].astype(np.int64) for x in held]
            share = align(own, texts) / np.maximum([MATCH * len(w) for w in own], 1)
            rows = [(held[j][0], held[j][1], share[j], held[j][3], len(texts[j])) for j in np.flatnonzero(share >= least)]
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "words"])

        for b in batches:
            held, n = [], 0
            for i, t, known in zip(b["doc_id"], b["text"], b["found"]):
                words = words_of(t)
                for item in known:
                    own = np.frombuffer(item["own"], np.uint32)
                    for s, e in windows(np.asarray(item["starts"], np.int64), len(own), len(words)):
                        held.append((i, item["item_id"], own, s, words[s:e]))
                        n += e - s + len(own)
                    if n >= HELD_WORDS:
                        yield aligned(held)
                        held, n = [], 0
            if held:
                yield aligned(held)

    scored = docs.join(found, "doc_id").mapInPandas(run, "doc_id long, item_id long, score double, first_word int, words int")
    best = F.max_by(F.struct("score", "first_word", "words"), F.struct("score", -F.col("first_word"), "words"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which an item was found; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
