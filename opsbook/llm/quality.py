"""Quality rules: counts, and repetition from suffix arrays over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in 3-word windows found twice or more
WINDOW = 3
REPEAT_WORDS = 8  # shorter maximal repeats do not count
MOST_COVERED = 0.3  # fraction of words in repeats
LONGEST = 100  # words of the longest repeat
SYMBOLS = "#*$%&|<>"
BATCH_CHARS = 800_000


def neighbours(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the longest common prefix of its suffix with a neighbour in its document's suffix array.

    The suffix arrays of all documents of a batch are built together by prefix doubling: the first rank is
    (document, word), and a round sorts only the suffixes whose rank is still shared. The ranks of each
    round then give the common prefixes of adjacent suffixes by descending powers of two.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, "right")  # of each word's document
    rank = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [], 1
    size = np.bincount(rank, minlength=n)
    first = np.cumsum(size) - size  # rank = number of smaller suffixes
    rank = first[rank]
    shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(shared):
        levels.append((k, rank))
        nxt = shared + k
        second = np.where(nxt < end[shared], rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[shared]))
        a, b = rank[shared][order], second[order]
        place = np.arange(len(order)) - np.searchsorted(a, a, "left")  # within the rank
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = rank.copy()
        rank[shared[order]] = a + place[lead]
        groups = np.diff(np.append(np.flatnonzero(new), len(order)))
        shared = np.sort(shared[order][np.repeat(groups > 1, groups)])
        k *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)  # of suffix[j - 1] and suffix[j]
    at = np.flatnonzero(doc[suffix[1:]] == doc[suffix[:-1]]) + 1
    x, y = suffix[at - 1].copy(), suffix[at].copy()
    for k, ranks in reversed(levels):
        inside = (x < end[suffix[at - 1]]) & (y < end[suffix[at]])
        same = inside & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)])
        # ranks that agree on a document's last words agree on fewer than k of them
        step = np.where(same, np.minimum(k, np.minimum(end[suffix[at - 1]] - x, end[suffix[at]] - y)), 0)
        x, y, lcp[at] = x + step, y + step, lcp[at] + step
    best = np.zeros(n, np.int64)
    best[suffix] = np.maximum(lcp, np.append(lcp[1:], 0))
    return best


def covered(lengths: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Words in the union of the repeats that start at each word, of at least `least` words."""
    n = len(lengths)
    starts = np.flatnonzero(lengths >= least)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + (lengths[starts] if most is None else most), -1)
    return np.cumsum(mark[:n]) > 0


def measure(texts: list[str | None]) -> pd.DataFrame:
    """The counts of each text, with covered_words and longest_repeat from the suffix arrays."""
    out: list[pd.DataFrame] = []
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b] or "") <= BATCH_CHARS):
            n += len(texts[b] or "")
            b += 1
        words = [(t or "").encode().split() for t in texts[a:b]]  # only of these texts: words take 10 times the text's memory
        size = np.array([len(w) for w in words])
        doc = np.repeat(np.arange(b - a), size)
        flat = [w for ws in words for w in ws]
        ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
        del words, flat
        repeat = neighbours(ids, doc)
        long = np.where(repeat >= REPEAT_WORDS, repeat, 0)
        longest = np.zeros(b - a, np.int64)
        np.maximum.at(longest, doc, long)
        rows = []
        for t in texts[a:b]:
            t = t or ""
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
            rows.append((len(t) - sum(map(t.count, " \t\n\x0b\f\r")), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines))))
        counts = pd.DataFrame(rows, columns=["word_chars", "n_symbols", "n_dup_lines"])
        counts.insert(0, "n_words", size)
        counts["n_repeat_words"] = np.bincount(doc, covered(repeat, WINDOW, WINDOW), b - a).astype(np.int64)
        counts["covered_words"] = np.bincount(doc, covered(long, REPEAT_WORDS), b - a).astype(np.int64)
        counts["longest_repeat"] = longest
        out.append(counts)
        a = b
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def quality(docs: DataFrame) -> DataFrame:
    """docs with __quality: the counts, base_failed and kept.

    Null and empty texts have no words, so they fail. A text is kept if the base rules pass, its repeats
    of 8 words or more cover at most 30 % of its words and none has over 100 words. Repeated rows are judged
    one by one. An empty table gives no rows.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield measure([None if t is None else t for t in texts])

    q = F.pandas_udf(run, COUNTS)
    failed = F.expr(f"__q.n_words < {LEAST_WORDS} OR 100 * __q.n_repeat_words > {MOST_REPEATED} * __q.n_words")
    kept = F.expr(
        f"NOT base_failed AND __q.covered_words <= {MOST_COVERED} * __q.n_words AND __q.longest_repeat <= {LONGEST}"
    )
    own = docs.select(F.struct("*").alias("__row"), q(F.col("text").cast("string")).alias("__q")).withColumn("base_failed", failed).withColumn("kept", kept)
    return own.select("__row.*", F.struct("__q.*", "base_failed", "kept").alias("__quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    return quality(docs).where("__quality.kept").select(docs.columns)
