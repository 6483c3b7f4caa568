"""Best-fit packing: a configuration linear program over the length histogram, then placement by rank."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .tokens import Kind, encoder, text_batches

CAPACITY = 2048
PHASES, ROUNDS = 6, 10  # solutions rounded one after another, and rounds of multiplicative weights for each
ENOUGH = 0.9  # of the pieces placed by the program, and the bound reached: no phase more
SMALL = 32  # pieces of less than 1 / SMALL of a sequence are kept to fill what the others leave
CLOSE = 1.001  # times the bound: patterns with room left are not tried as well
NEAR = 0.02  # a pattern worth this much less than the best still counts as an answer to the prices
COOLING_ROUNDS, COOLING_PHASES = 240, 9  # of the slow program, for histograms on which the quick one stays far from the bound
COOLING_STEP, COOLING_SPREAD = (0.1, 0.002), (0.02, 0.003)  # of its first and last round: how fast prices move, how near to the best answers are
STEP, RATE = 0.5, 1.0  # most of a length's need that a round covers, and how fast prices fall with it

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


def tokenizer() -> Kind:
    import public_tokenizers

    return Kind(public_tokenizers.path("word_bpe_49k.json"), keeps_space=False, lower=True)


def pieces(docs: DataFrame, kind: Kind, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and the end id, cut only beyond the capacity; written, with a rank.

    `task` and `local` number the pieces of one length: local is the rank within the task that made them.
    The table is written before use, so a task run again cannot change ranks that others have read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(kind)
        for b in batches:
            texts, names = [t or "" for t in b["text"]], b["doc_id"].to_numpy()
            for x, y in text_batches(texts):
                ids, counts = enc.encode(texts[x:y])
                at = np.concatenate([[0], np.cumsum(counts)])
                out = []
                for k in range(y - x):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        out.append((names[x + k], p, s, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                        seen[len(part)] += 1
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, PIECES)
    return cut(rows, "pieces")


# --- the linear program -------------------------------------------------------------------------------------


def price_table(lengths: np.ndarray, value: np.ndarray, capacity: int, longest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value that fits each room, and the length to take there (-1: leave one place empty): knapsack by
    dynamic programming. Ties go to the shortest length, or to the longest."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fits[room]
        if n:
            gain = value[:n] + best[room - lengths[:n]]
            k = int(gain.argmax()) if not longest else n - 1 - int(gain[::-1].argmax())
            if gain[k] > best[room]:
                best[room], choice[room] = gain[k], k
    return best, choice


def trace(room: int, lengths: np.ndarray, choice: np.ndarray, most: np.ndarray, first: int | None = None) -> tuple[tuple[int, int], ...]:
    """The pattern ((length index, times), …) that the table holds for this room, with `first` in it; a length is used at
    most `most` times, and room that this leaves goes to the next best."""
    used: dict[int, int] = defaultdict(int)
    if first is not None:
        used[first] = 1
        room -= int(lengths[first])
    while room > 0:
        k = int(choice[room])
        if k < 0 or used[k] >= most[k]:
            room -= 1
            continue
        used[k] += 1
        room -= int(lengths[k])
    return tuple(sorted((k, n) for k, n in used.items() if n))


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(amount of each pattern, lower bound) of the covering program: least sum of x_p, every length covered.

    Each round prices lengths, fills the knapsack table once, and reads from it the best pattern with each length; those
    worth nearly the best are used as far as their scarcest length allows, all scaled so that no length gets over
    STEP of its need; then prices fall where needs were covered. Any prices give a bound: the worth of all pieces
    by the worth of the best pattern.
    """
    value, share, bound = lengths / capacity, np.zeros(len(lengths)), 0.0
    amount: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for _ in range(rounds):
        best, choice = price_table(lengths, value, capacity)
        bound = max(bound, float(value @ need) / best[capacity])
        worth = value + best[capacity - lengths]
        found: dict[tuple[tuple[int, int], ...], float] = {}
        for k in np.flatnonzero(worth >= (1 - NEAR) * best[capacity]).tolist():
            p = trace(capacity, lengths, choice, need, k)
            found[p] = min(need[j] / n for j, n in p)
        covered = np.zeros(len(lengths))
        for p, x in found.items():
            for j, n in p:
                covered[j] += x * n / need[j]
        scale = STEP / covered.max()
        for p, x in found.items():
            amount[p] += scale * x
        share += scale * covered
        value = value * np.exp(-RATE * scale * covered)
    reached = share[share > 0]
    return {p: x / float(np.median(reached)) for p, x in amount.items()}, bound


def anneal(lengths: np.ndarray, need: np.ndarray, capacity: int, value: np.ndarray | None = None) -> tuple[dict[tuple[tuple[int, int], ...], float], float, np.ndarray]:
    """(amount of each pattern, lower bound, prices) of the covering program, by slowly cooled weights.

    As in solve(), but a round's answer is spread over the patterns by how near their worth is to the best, and prices move
    by how much less or more than its share each length got. Steps and spread shrink from round to round; the amounts are
    the mean of the last rounds, in which prices have settled. A round whose answer alone is CLOSE to the bound ends it.
    """
    start = lengths / capacity if value is None else value
    log_value = np.log(start)
    amount: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    rounds = int(min(COOLING_ROUNDS, max(30, 48_000 // len(lengths))))
    bound, kept, counted = 0.0, lengths / capacity, 0
    for t in range(rounds):
        part = t / max(rounds - 1, 1)
        step, spread = (a * (b / a) ** part for a, b in (COOLING_STEP, COOLING_SPREAD))
        value = np.exp(log_value) if t else start  # as given, so that equal worths stay equal
        best, choice = price_table(lengths, value, capacity, longest=True)
        low = float(value @ need) / best[capacity]
        if low > bound:
            bound, kept = low, value
        weight = np.exp(((value + best[capacity - lengths]) / best[capacity] - 1) / spread)
        found: dict[tuple[tuple[int, int], ...], float] = {}
        for k in np.flatnonzero(weight > 1e-3).tolist():
            p = trace(capacity, lengths, choice, need, k)
            found[p] = max(found.get(p, 0.0), weight[k] * min(need[j] / n for j, n in p))
        covered = np.zeros(len(lengths))
        for p, x in found.items():
            for j, n in p:
                covered[j] += x * n / need[j]
        if covered.all() and sum(found.values()) <= CLOSE * bound * covered.min():  # one round's answer is good enough
            return {p: x / covered.min() for p, x in found.items()}, bound, kept
        mean = float((value * need) @ covered / (value @ need))
        log_value -= step * np.clip(covered / mean - 1, -1, 4)
        log_value -= log_value.max()
        if part >= 0.7:
            counted += 1
            for p, x in found.items():
                amount[p] += x / mean
    return {p: x / counted for p, x in amount.items()}, bound, kept


def cooled(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray, int]:
    """(patterns and how often, pieces left, lower bound): amounts are rounded down, and what that leaves goes back to the
    program, with the prices of the last, until it is little; the last phases round to the nearest."""
    left, rows, bound = need.copy(), [], 0
    prices = lengths / capacity
    for phase in range(COOLING_PHASES):
        own = np.flatnonzero(left > 0)
        if not len(own):
            break
        amount, low, prices[own] = anneal(lengths[own], left[own].astype(np.float64), capacity, prices[own])
        bound = max(bound, int(np.ceil(low - 1e-6)) if not phase else 0)
        before = int(left.sum())
        for p, x in sorted(amount.items(), key=lambda item: (-item[1], item[0])):
            n = min(int(x + 1e-6) if phase < COOLING_PHASES - 2 else max(1, round(x)), *(int(left[own[k]]) // c for k, c in p))
            if n > 0:
                rows.append(({int(own[k]): c for k, c in p}, n))
                for k, c in p:
                    left[own[k]] -= c * n
        if left.sum() > 0.98 * before:
            break
    return rows, left, bound


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold every piece of the histogram."""
    return packed(histogram, capacity, rounds)[0]


def packed(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], int, int]:
    """(patterns and how often, pieces that the program placed, lower bound of sequences).

    The program is solved and rounded in phases, each on what the ones before left. Rounding takes patterns in order of
    their amount, at least once and while pieces are left. What no phase places goes best-fit in decreasing order.
    Where this stays CLOSE to the bound no more is done; else, or if it places less than half of the pieces, the slowly
    cooled program is solved too. Of all states the one with the fewest sequences wins, which may be plain best fit; of equal
    ones, that with the most pieces placed by the program.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return [], 0, 0
    need = np.array([histogram[int(k)] for k in lengths], np.int64)
    small = capacity // SMALL if lengths[-1] >= capacity // SMALL else 0
    bound, answers = 0, []
    for parts in range(5):  # prices by room, and by whole parts of a sequence, which bound better where few pieces fit one
        steps = np.where(lengths * (parts + 1) % capacity, lengths * (parts + 1) // capacity / max(parts, 1), lengths / capacity) if parts else lengths / capacity
        if steps.any():
            bound = max(bound, int(np.ceil(float(steps @ need) / price_table(lengths, steps, capacity)[0][capacity] - 1e-6)))
    for whole in (True, False):
        least = min(answers, key=lambda found: found[:2], default=None)
        if least and least[0] <= bound * CLOSE and -2 * least[1] > need.sum():
            break
        left, rows = need.copy(), []
        for phase in range(PHASES):
            own = np.flatnonzero((left > 0) & (lengths >= small))
            if not len(own):
                break
            amount, low = solve(lengths[own], left[own].astype(np.float64), capacity, rounds)
            bound = max(bound, int(np.ceil(low - 1e-6)) if not phase else 0)  # holds for part of the pieces, so for all
            before = len(rows)
            for p, x in sorted(amount.items(), key=lambda item: (-item[1], item[0])):
                n = min(max(1, round(x)), *(int(left[own[k]]) // c for k, c in p))
                if n > 0 and not (whole and sum(int(lengths[own[k]]) * c for k, c in p) < capacity):
                    rows.append(({int(own[k]): c for k, c in p}, n))
                    for k, c in p:
                        left[own[k]] -= c * n
            if len(rows) == before:
                break
            placed = int(need.sum() - left.sum())
            made = best_fit(lengths, left, rows, capacity)
            answers.append((sum(n for _, n in made), -placed, made))
            if answers[-1][0] <= bound and placed >= ENOUGH * need.sum():
                return made, placed, bound
    if min(answers, key=lambda found: found[:2], default=(need.sum(),))[0] > bound * CLOSE or -2 * min((found[:2] for found in answers), default=(0, 0))[1] < need.sum():
        rows, left, low = cooled(lengths, need, capacity)
        made = best_fit(lengths, left, rows, capacity)
        bound = max(bound, low)
        answers.append((sum(n for _, n in made), -int(need.sum() - left.sum()), made))
    plain = best_fit(lengths, need, [], capacity)
    answers.append((sum(n for _, n in plain), 0, plain))
    _, placed, made = min(answers, key=lambda found: found[:2])
    return made, -placed, bound


def best_fit(lengths: np.ndarray, left: np.ndarray, rows: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place the pieces left over, longest first, in the least room that takes them; equal sequences together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for p, n in rows:
        flat = tuple(int(lengths[k]) for k, c in sorted(p.items(), reverse=True) for _ in range(c))
        room[capacity - sum(flat)][flat] += n
    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        while n:
            gap = next((g for g in range(size, capacity) if room.get(g)), None)
            if gap is None:
                fit = capacity // size
                whole, rest = divmod(n, fit)
                if whole:
                    room[capacity - fit * size][(size,) * fit] += whole
                if rest:
                    room[capacity - rest * size][(size,) * rest] += 1
                n = 0
                continue
            flat, have = next(iter(room[gap].items()))
            fit = gap // size
            whole = min(have, n // fit) if n >= fit else 0
            many, each = (whole, fit) if whole else (1, min(n, fit))
            room[gap][flat] -= many
            if not room[gap][flat]:
                del room[gap][flat]
            room[gap - each * size][flat + (size,) * each] += many
            n -= many * each
    return [(flat, n) for g in sorted(room) for flat, n in sorted(room[g].items()) if n]


def slots(rows: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each length, in rank order, runs of pieces: (key of the first, its sequence, offset)."""
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for flat, n in rows:
        at = 0
        for size in flat:
            by[size].append((base, at, n))
            at += size
        base += n
    key, seq, off = [], [], []
    for size in sorted(by):
        rank = 0
        for first, at, n in by[size]:
            key.append((size << 44) + rank)
            seq.append(first)
            off.append(at)
            rank += n
    return np.array(key, np.int64), np.array(seq, np.int64), np.array(off, np.int64)


def pack(docs: DataFrame, kind: Kind | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and offset; no sequence holds over `capacity` ids.

    The driver sees the histogram alone, of at most `capacity` lengths, so the program and the list of
    patterns have a fixed bound. A null or empty text is a piece of the end id only; null ids stay null.
    Repeated rows are packed as often as they come. An empty table gives no rows.
    """
    found = pieces(docs, kind or tokenizer(), end_id, capacity)
    per_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    key, seq, off = slots(patterns(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = docs.sparkSession.sparkContext.broadcast((key, seq, off))  # bounded by the histogram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, off = plan.value
        for b in batches:
            if not len(b):
                continue
            own = (b["length"].to_numpy() << 44) + b["base"].to_numpy() + b["local"].to_numpy()
            at = np.searchsorted(key, own, "right") - 1
            yield b.assign(sequence_id=seq[at] + own - key[at], offset=off[at])[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return found.join(base, ["task", "length"]).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
