"""Token-ID files: range asymmetric numeral coding with one shared static frequency table.

A file holds consecutive documents. Its ids are cut into blocks of BLOCK ids, each coded on its own; in a
block, id k belongs to lane k mod LANES, and the lanes share one stream of 32-bit words. Every STEP_MARK steps
the lanes' states and the place in the stream are recorded, so that parts of a block decode side by side.
Layout, little-endian: header, doc ids and lengths, CRC-32 of these, then for each block its word count, CRC-32,
checkpoints and words. The frequency table is a file of its own beside them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, file_folder, open_store, write_file
from .tokens import Kind, encoder, text_batches

MAGIC, TABLE_MAGIC = b"opsrans1", b"opsfreq1"
HEADER = struct.Struct("<8sIIIIQQ")  # magic, table CRC, block, lanes, blocks, documents, ids
BLOCK, LANES, STEP_MARK = 65_536, 64, 256
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
FILE_IDS = 4 * 1024 * 1024
NO_ID = -(1 << 63)


class Table:
    """Frequencies of all ids, scaled to a power of two, with their cumulative sums and the reverse look-up."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.bits = int(freq.sum()).bit_length() - 1
        self.first = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(31 - self.bits + 32)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Every id that occurs gets a share of at least one; the commonest take up the rounding."""
        kinds = int((counts > 0).sum())
        total, size = int(counts.sum()), 1 << max(18, kinds.bit_length() + 2)
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (size / max(total, 1))).astype(np.int64)), 0)
        over, order = int(freq.sum()) - size, np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        for k in order:
            if over <= 0:
                break
            less = min(over, int(freq[k]) // 2)
            freq[k] -= less
            over -= less
        return cls(freq)

    def pack(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return TABLE_MAGIC + struct.pack("<II", zlib.crc32(body), len(self.freq)) + body

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        crc, n = struct.unpack_from("<II", data, 8)
        if data[:8] != TABLE_MAGIC or zlib.crc32(data[16 : 16 + 4 * n]) != crc:
            raise ValueError("damaged frequency table")
        return cls(np.frombuffer(data, "<u4", n, 16).astype(np.int64))


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(states, stream places, words) of each block; all lanes of all blocks go step by step together."""
    blocks, steps = -(-len(ids) // BLOCK), BLOCK // LANES
    if not blocks:
        return []
    padded = np.full(blocks * BLOCK, table.freq.argmax(), np.int64)
    padded[: len(ids)] = ids
    rows = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    x = np.full((blocks, LANES), LOW)
    word, out = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    marks = []
    bits = np.uint64(table.bits)
    for t in range(steps - 1, -1, -1):
        s = rows[t]
        f = table.freq[s]
        big = x >= table.limit[s]
        out[t], word[t] = big, x.astype(np.uint32)
        x = np.where(big, x >> np.uint64(32), x)
        q = x // f
        x = (q << bits) + (x - q * f) + table.first[s]
        if t % STEP_MARK == 0:
            marks.append(x)
    states = np.stack(marks[::-1], axis=1)
    words, out = word.transpose(1, 0, 2), out.transpose(1, 0, 2)
    places = np.cumsum(out.reshape(blocks, steps // STEP_MARK, -1).sum(2), axis=1)
    return [(states[b], np.concatenate([[0], places[b][:-1]]), words[b][out[b]]) for b in range(blocks)]


def decode_parts(states: np.ndarray, places: np.ndarray, words: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the parts that begin at these checkpoints (states: parts x LANES), all side by side; last states and places."""
    x, at = states.copy(), places.astype(np.int64)
    ids = np.empty((STEP_MARK, *x.shape), np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    for t in range(STEP_MARK):
        low = x & mask
        s = table.symbol[low]
        ids[t] = s
        x = table.freq[s] * (x >> bits) + low - table.first[s]
        need = x < LOW
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        x = np.where(need, (x << np.uint64(32)) | words[np.where(need, place, 0)], x)
        at += need.sum(1)
    return ids.transpose(1, 0, 2).reshape(len(states), -1), x, at


def pack_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table, table_crc: int) -> list[bytes]:
    blocks = encode_blocks(ids, table)
    head = HEADER.pack(MAGIC, table_crc, BLOCK, LANES, len(blocks), len(doc_ids), len(ids)) + doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes()
    parts = [head, struct.pack("<I", zlib.crc32(head))]
    for states, places, words in blocks:
        body = states.astype("<u8").tobytes() + places.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        parts += [struct.pack("<II", len(words), zlib.crc32(body)), body]
    return parts


def unpack_file(data: bytes, table: Table, table_crc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a file; checks the table, the CRC of the header and of each block, and that each part
    ends in the state and place where the next begins."""
    if len(data) < HEADER.size:
        raise ValueError("not a token file of this table")
    magic, crc, block, lanes, n_blocks, n_docs, n_ids = HEADER.unpack_from(data)
    if magic != MAGIC or crc != table_crc or (block, lanes) != (BLOCK, LANES):
        raise ValueError("not a token file of this table")
    at = HEADER.size
    if len(data) < at + 16 * n_docs + 4 or zlib.crc32(data[: at + 16 * n_docs]) != struct.unpack_from("<I", data, at + 16 * n_docs)[0]:
        raise ValueError("damaged header")
    doc_ids, lengths = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs + 4
    marks = BLOCK // LANES // STEP_MARK
    states, places, words, base = [], [], [], 0
    for _ in range(n_blocks):
        n, crc = struct.unpack_from("<II", data, at)
        size = marks * LANES * 8 + marks * 8 + 4 * n
        if zlib.crc32(data[at + 8 : at + 8 + size]) != crc:
            raise ValueError("damaged block")
        at += 8
        states.append(np.frombuffer(data, "<u8", marks * LANES, at).reshape(marks, LANES))
        places.append(np.frombuffer(data, "<u8", marks, at + marks * LANES * 8).astype(np.int64) + base)
        words.append(np.frombuffer(data, "<u4", n, at + marks * LANES * 8 + marks * 8))
        base += n
        at += size
    if not n_blocks:
        return doc_ids, lengths, np.empty(0, np.uint32)
    firsts, starts = np.concatenate(states), np.concatenate(places)
    ids, lasts, stops = decode_parts(firsts, starts, np.concatenate(words), table)
    inner = np.arange(1, len(firsts)) % marks != 0  # parts with a next one in their block
    ends = np.arange(len(firsts)) % marks == marks - 1
    if (lasts[:-1][inner] != firsts[1:][inner]).any() or (lasts[ends] != LOW).any() or (stops != np.append(starts[1:], base)).any():
        raise ValueError("damaged block")
    return doc_ids, lengths, ids.reshape(-1)[:n_ids]


def tokenizer() -> Kind:
    import public_tokenizers

    return Kind(public_tokenizers.path("byte_bpe_50k.json"), keeps_space=True, lower=False)


def token_ids(docs: DataFrame, kind: Kind, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): the library's ids and the end id of every row, written once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(kind)
        for b in batches:
            texts, names = [t or "" for t in b["text"]], b["doc_id"].to_numpy()
            for x, y in text_batches(texts):
                ids, counts = enc.encode(texts[x:y])
                at = np.concatenate([[0], np.cumsum(counts)])
                rows = [np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4") for k in range(y - x)]
                # low and high halves apart: the high one is mostly zero and compresses away
                halves = [(r & 0xFFFF).astype("<u2").tobytes() + (r >> 16).astype("<u2").tobytes() for r in rows]
                yield pd.DataFrame({"doc_id": names[x:y], "n_tokens": counts + 1, "ids": halves})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInPandas(run, "doc_id long, n_tokens long, ids binary"), "ids", compression="zstd")


def _join(halves: bytes) -> np.ndarray:
    low, high = np.frombuffer(halves, "<u2").reshape(2, -1).astype(np.uint32)
    return low | high << 16


def frequencies(rows: DataFrame) -> np.ndarray:
    """Counts of each id over all rows; the driver gets one row per distinct id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            if len(b):
                n = np.bincount(np.concatenate([_join(x) for x in b["ids"]]))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        yield pd.DataFrame({"id": np.flatnonzero(total), "n": total[total > 0]})

    found = rows.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    counts[[r["id"] for r in found]] = [r["n"] for r in found]
    return counts


def write_token_files(docs: DataFrame, folder: str, kind: Kind, end_id: int) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest (uri, first id, ids) in that order.

    A file's name is new in each attempt and only the manifest says which files count, so a task that runs
    again leaves at most a file that nobody reads.
    """
    rows = token_ids(docs, kind, end_id)
    counts = frequencies(rows)
    table = Table.of_counts(counts)
    packed = table.pack()
    write_file(f"{folder}/table.bin", [packed])
    crc = zlib.crc32(packed)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        names: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pd.DataFrame:
            uri = f"{folder}/{task:06d}-{number:04d}-{uuid.uuid4().hex}.rans"
            write_file(uri, pack_file(np.array(names, np.int64), np.array([len(x) for x in held]), np.concatenate(held), shared.value, crc))
            return pd.DataFrame({"task": [task], "number": [number], "uri": [uri], "ids": [n]})

        for b in batches:
            for i, halves in zip(b["doc_id"], b["ids"]):
                held.append(_join(halves))
                names.append(NO_ID if pd.isna(i) else int(i))
                n += len(held[-1])
                if n >= FILE_IDS:
                    yield flush()
                    names, held, n, number = [], [], 0, number + 1
        if held:
            yield flush()

    # no more tasks than the session sets for a shuffle: a task writes as many files as its ids need
    files = max(1, min(-(-int(counts.sum()) // FILE_IDS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    order = rows.withColumn("tie", F.xxhash64("ids"))
    order = order.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    made = cut(order.select("doc_id", "ids").mapInPandas(run, "task int, number int, uri string, ids long"), "manifest")
    tasks = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = made.groupBy("task").agg(F.sum("ids").alias("ids")).select("task", F.coalesce(F.sum("ids").over(tasks), F.lit(0)).alias("base"))
    before = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).join(bases, "task").withColumn("first", F.col("first") + F.col("base")).drop("base")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, dealt evenly over the tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, crc = None, 0
        for b in batches:
            for uri, first in zip(b["uri"], b["first"]):
                if table is None:
                    store, path = open_store(f"{folder}/table.bin")
                    with store.open_input_file(path) as f:
                        packed = f.read()
                    table, crc = Table.unpack(packed), zlib.crc32(packed)
                store, path = open_store(uri)
                with store.open_input_file(path) as f:
                    doc_ids, lengths, ids = unpack_file(f.read(), table, crc)
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[s:e].tobytes()) for s, e in zip(at, at[1:])]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "start": at[:-1] + first, "n_tokens": lengths, "ids_crc32": crcs})
                out.loc[doc_ids == NO_ID, "doc_id"] = pd.NA
                yield out

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each reads its share of the files, one after another
    return manifest.select("uri", "first").repartition(tasks).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, kind: Kind | None = None, end_id: int = 2) -> DataFrame:
    """Write the token files of docs into the shared folder and describe each document as read back.

    A null text counts as empty and gives the end id alone. Null ids come first. Rows that repeat a doc_id
    follow each other. No rows give no file.
    """
    folder = file_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, kind or tokenizer(), end_id), folder)
