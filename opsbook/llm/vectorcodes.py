"""Vector code compression: product codes of integer vectors by two exact rounds of k-means.

Vectors are cut into parts. Each chunk of rows is sorted, part by part, along a Hilbert curve and laid out in flat blocks
that store their box (least and greatest components) and their sums. In a round, distances from boxes to codebook
entries give each block a shortlist: an entry whose least distance to the box is greater than another's greatest cannot
be nearest to any row. A block with one entry left adds its sums unseen; the others are evaluated by
integer kernels on their shortlist alone. All arithmetic is in 64-bit integers, so nothing depends on how rows lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 32  # rows of a block
CHUNK = 1 << 19  # components of a chunk, about
BITS = 8  # of a component in a place on the curve, at most; 60 bits for all
LARGEST = 1 << 24  # of a component's integer: up to 8192 of them have squared distances that fit 64 bits
HOT_LABELS = 64  # labels with more than one in so many rows are sent to all tasks, which bounds their number


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n, d), of `bits` bits each; n * d bits in all.

    Skilling's transform: from the highest bit on, undo each axis's exchange or inversion, then Gray-decode and interleave.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    high = 1 << (bits - 1)
    bit = high
    while bit > 1:
        low = bit - 1
        for k in range(axes):
            flip = (x[k] & bit) > 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turn, bit = np.zeros_like(x[0]), high
    while bit > 1:
        turn = np.where(x[-1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(axes):
            place = place << 1 | (x[k] >> b & 1)
    return place


def curve_order(part: np.ndarray) -> np.ndarray:
    """Order of the rows of one part along the curve through its own bounds."""
    axes = min(part.shape[1], 60)
    bits = max(1, min(BITS, 60 // axes))
    own = part[:, :axes]
    low = own.min(0)
    span = np.maximum(own.max(0) - low + 1, 1)
    return np.argsort(hilbert((own - low << bits) // span, bits), kind="stable")


def blocks_of(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, rows in it, lows, highs, sums) of the parts of rows (n, dim): flat blocks of BLOCK rows, the last shorter."""
    n, width = len(rows), rows.shape[1] // PARTS
    order, laid = np.empty((PARTS, n), np.int32), np.empty((PARTS, n, width), np.int32)
    edges = np.arange(0, n, BLOCK)
    low, high, sums = (np.empty((PARTS, len(edges), width), np.int64) for _ in range(3))
    for p in range(PARTS):
        part = rows[:, p * width : (p + 1) * width]
        order[p] = curve_order(part)
        laid[p] = part[order[p]]
        low[p], high[p] = np.minimum.reduceat(laid[p], edges), np.maximum.reduceat(laid[p], edges)
        sums[p] = np.add.reduceat(laid[p].astype(np.int64), edges)
    return order, laid, low, high, sums


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(block, entry): whether the entry may be nearest to a row in the block's box; equal distances stay."""
    under, over = low[:, None, :] - book[None], book[None] - high[:, None, :]
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    return (near * near).sum(2) <= (far * far).sum(2).min(1)[:, None]


def nearest(laid: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray, skip_single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each row, squared distance, entry of each block that has one left, else -1), ties to the lower entry.

    With skip_single, rows of blocks with one entry left get no distance.
    """
    n = len(laid)
    listed = shortlists(low, high, book)
    many = listed.sum(1)
    single = np.where(many == 1, listed.argmax(1), -1)
    entry, distance = np.repeat(single, BLOCK)[:n], np.zeros(n, np.int64)
    ranked = np.argsort(~listed, axis=1, kind="stable")  # listed entries first, ascending
    size = np.left_shift(1, np.ceil(np.log2(many)).astype(np.int64))  # kernels of 1, 2, 4, … entries
    for k in np.unique(size):
        if k == 1 and skip_single:
            continue
        at = np.flatnonzero(size == k)
        kept = ranked[at, : min(int(k), len(book))]
        kept = np.where(np.arange(kept.shape[1]) < many[at, None], kept, kept[:, :1])  # padding repeats the first
        step = max(1, CHUNK // (BLOCK * kept.shape[1] * laid.shape[1]))
        for a in range(0, len(at), step):
            own, few = at[a : a + step], kept[a : a + step]
            rows = own[:, None] * BLOCK + np.arange(BLOCK)
            real = rows < n
            gap = laid[np.minimum(rows, n - 1)].astype(np.int64)[:, :, None, :] - book[few][:, None, :, :]
            far = np.einsum("brkw,brkw->brk", gap, gap)
            best = far.argmin(2)
            entry[rows[real]] = np.take_along_axis(few, best, 1)[real]
            distance[rows[real]] = np.take_along_axis(far, best[:, :, None], 2)[:, :, 0][real]
    return entry, distance, single


def part_sums(laid: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sums) of the rows nearest to each entry; blocks with one entry left add what they store."""
    count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    entry, _, single = nearest(laid, low, high, book, skip_single=True)
    lengths = np.minimum(BLOCK, len(laid) - np.arange(len(single)) * BLOCK)
    whole = single >= 0
    np.add.at(count, single[whole], lengths[whole])
    np.add.at(total, single[whole], sums[whole])
    rest = np.flatnonzero(~np.repeat(whole, BLOCK)[: len(laid)])
    np.add.at(count, entry[rest], 1)
    np.add.at(total, entry[rest], laid[rest].astype(np.int64))
    return count, total


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles, label) of whole vectors, and their length; 0 if there are none."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    rows = rows.where(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    return (rows.where(F.size("embedding") == first[0]), first[0]) if first else (rows, 0)


def integers(vectors: np.ndarray) -> np.ndarray:
    found = np.floor(vectors * SCALE)
    if len(found) and np.abs(found).max() > LARGEST:
        raise ValueError(f"components over {LARGEST // SCALE}: their squared distances do not fit 64 bits")
    return found.astype(np.int64)


def block_table(rows: DataFrame, dim: int) -> DataFrame:
    """Chunks of rows with their blocks, written once: (ids, labels, and the arrays of blocks_of as bytes)."""
    step = max(BLOCK, CHUNK // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                b = batch.slice(a, step)
                flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
                made = [pa.array([x.tobytes()], pa.binary()) for x in blocks_of(integers(flat.reshape(b.num_rows, dim)))]
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *made], names=["ids", "labels", "order", "laid", "low", "high", "sums"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return cut(rows.mapInArrow(run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, order binary, laid binary, low binary, high binary, sums binary"), "vector-blocks")


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """(vec_ids, labels, order, laid, low, high, sums) of each chunk."""
    width = dim // PARTS
    for batch in batches:
        for k in range(batch.num_rows):
            order, laid, low, high, sums = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("order", np.int32), ("laid", np.int32), ("low", np.int64), ("high", np.int64), ("sums", np.int64)))
            box = (PARTS, -1, width)
            yield batch.column("ids")[k].values, batch.column("labels")[k].values, order.reshape(PARTS, -1), laid.reshape(box), low.reshape(box), high.reshape(box), sums.reshape(box)


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after a round; the driver gets one row for each entry."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, _, _, laid, low, high, sums in _chunks(batches, width * PARTS):
            for p in range(PARTS):
                n, s = part_sums(laid[p], low[p], high[p], sums[p], books[p])
                count[p] += n
                total[p] += s
        at = np.flatnonzero(count.ravel())
        columns = [at, count.ravel()[at], *total.reshape(-1, width)[at].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["entry", "n", *(f"s{k}" for k in range(width))])

    names = ["n", *(f"s{k}" for k in range(width))]
    sums = blocks.mapInArrow(run, "entry long, " + ", ".join(f"{c} long" for c in names))
    out = books.reshape(-1, width).copy()
    for row in sums.groupBy("entry").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[row["entry"]] = np.array(row[2:], np.int64) // row["n"]  # floors
    return out.reshape(books.shape)


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each row by final codebooks; written once."""
    dim = books.shape[2] * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, order, laid, low, high, _ in _chunks(batches, dim):
            codes, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
            for p in range(PARTS):
                entry, distance, _ = nearest(laid[p], low[p], high[p], books[p])
                codes[order[p], p] = entry
                error[order[p]] += distance
            text = codes.tobytes().hex()
            code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    return cut(blocks.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"), "vector-codes")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with `label_error`: their errors summed over equal labels, null labels together.

    Sums of labels with more than one in HOT_LABELS of all rows, which are fewer than that, go to every task;
    the rows of other labels are joined with theirs, so no task gets a label of many rows.
    """
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    every = sums.agg(F.sum("n")).first()[0] or 0
    sums = sums.withColumnRenamed("label", "_label")
    hot, same = sums.where(F.col("n") * HOT_LABELS > every), F.col("label").eqNullSafe(F.col("_label"))
    marked = rows.join(F.broadcast(hot), same, "left")
    near = marked.where("n is not null").drop("_label", "n")
    rest = marked.where("n is null").select(rows.columns)
    return near.unionByName(rest.join(sums.where(F.col("n") * HOT_LABELS <= every), same).drop("_label", "n"))


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable row of embeddings.

    Left out are null vectors, those with null or non-finite components, and those that cannot be cut like the others:
    empty ones, and lengths that PARTS does not divide or that the usable row of least vec_id does not have. Rows that repeat
    a vec_id are rows of their own, ordered by their vectors where the first entries are taken; null vec_ids
    come last there. Fewer rows than ENTRIES make as many entries. An empty table gives no rows. A component over
    65,536 raises ValueError, since its error would not fit.
    """
    rows, dim = usable(embeddings)
    if not dim:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    books = integers(np.array([r[0] for r in first])).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    blocks = block_table(rows, dim)
    for _ in range(ROUNDS):
        books = next_books(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = with_label_error(encoded(blocks, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
