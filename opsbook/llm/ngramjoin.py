"""N-gram Jaccard join: T-occurrence search by DivideSkip, in shards of the rare shingles that similar sets must share.

Two sets with a Jaccard similarity of PERCENT overlap in so much of each that both hold a common shingle among the first
few of their own, in whatever order all sets use. The order here is by the number of documents that hold a shingle, so
those first ones are rare, and shingles of one document alone, which link nothing, come before all. Documents that share
one of the first others meet in its shard. There a set finds the sets that reach its overlap T: the long inverted lists are
set aside, the short ones are merged by a heap that skips, and what they have often enough is looked up in the long ones
by binary search.

Shingles are counted in packed form: a chunk of documents sends each bucket of hash values one sorted array, and gets
back those that other documents have as well.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, local_components
from .shared import cut, whole_groups
from .simhash import cells, crossings, large_keys, shingle_hashes

WIDTH, PERCENT = 4, 85
CHUNK = 500_000  # shingles of a chunk, about
CHUNK_DOCS = 60_000
HEAVY = 16  # documents of a chunk that have a shingle: with more, the chunk lists them itself and it counts as held by most
BUCKETS = 4  # for each shuffle partition
MANY = 255  # shingles of so many documents, and heavy ones, are in one class of the order
EVERY = 0xFFFF  # in place of a document: a shingle that its chunk holds as heavy
GROUP_ROWS = 256  # sets of a group that is one shard
SHARD_ROWS = 512  # sets of a key's shard, and sets that search it
SMALL = 32  # shards of so many sets are searched by all of them at once
LEADERS = 8  # sets that the sets of a larger shard are compared with first
MU = 1.0  # DivideSkip's weight of a look-up against a merge step: lists are merged by the array, looked up one by one
MERGED = 2048  # entries of short lists up to which they are merged by the heap; more are counted

ENTRIES, SHARED, HEADER = 0, 1, 2


def least_overlap(a: int, b: int) -> int:
    """Common elements that sets of these sizes need: 100 * both >= PERCENT * (a + b - both)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


# --- shingles that documents share ----------------------------------------------------------------------------


def chunk_rows(sets: list[np.ndarray], chunk: int, buckets: int) -> list[tuple]:
    """(bucket, chunk, kind, tokens, docs) of a chunk: for each bucket an array of tail << 16 | document in order, and the
    documents of heavy shingles. A shingle is its bucket and the lower 48 bits of its hash."""
    token = np.concatenate([np.empty(0, np.uint64), *sets])
    doc = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    bucket = (token >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
    tail = token & np.uint64((1 << 48) - 1)
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    run = np.cumsum(new) - 1
    heavy = np.bincount(run, minlength=1)[run] > HEAVY if len(run) else new
    out = []
    if heavy.any():
        out.append((chunk % buckets, chunk, SHARED, (bucket[heavy] << np.uint64(48) | tail[heavy]).tobytes(), doc[heavy].astype(np.uint16).tobytes()))
        doc = np.where(heavy, np.uint64(EVERY), doc)
        kept = new | ~heavy
        bucket, tail, doc = bucket[kept], tail[kept], doc[kept]
    packed = tail << np.uint64(16) | doc
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    out += [(int(bucket[s]), chunk, ENTRIES, packed[s:e].tobytes(), b"") for s, e in zip(edges, edges[1:])]
    return out


def shared_in(bucket: int, packed: list[np.ndarray]) -> list[tuple[bytes, bytes, bytes] | None]:
    """For each chunk's array of a bucket the shingles (as numbers, documents, counts up to MANY) that more than one document has."""
    every = np.concatenate(packed)
    order = np.argsort(every >> np.uint64(16), kind="stable")
    tail = every[order] >> np.uint64(16)
    new = np.ones(len(tail), bool)
    new[1:] = tail[1:] != tail[:-1]
    run = np.cumsum(new) - 1
    count = np.minimum(np.bincount(run), MANY)
    marked = np.zeros(len(count), bool)
    marked[run[every[order] & np.uint64(EVERY) == EVERY]] = True
    count[marked] = MANY
    df = np.empty(len(every), np.uint8)
    df[order] = count[run]
    out, at = [], 0
    for p in packed:
        own = df[at : at + len(p)]
        at += len(p)
        keep = (own > 1) & (p & np.uint64(EVERY) != EVERY)
        p = p[keep]
        out.append(((np.uint64(bucket) << np.uint64(48) | p >> np.uint64(16)).tobytes(), (p & np.uint64(EVERY)).astype(np.uint16).tobytes(), own[keep].tobytes()) if len(p) else None)
    return out


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, size, digest, more, shared) of each row: its set's size and 128-bit digest, and the shingles that other rows
    hold too, rarest first, where they are enough for a link with another set; written once.

    A chunk's numbering of its documents must not change if a task is run again, so docs should be read from files.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(parts * BUCKETS, 1 << 16)

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        sets: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def made() -> pd.DataFrame:
            size = np.array([len(s) for s in sets], np.int64)
            digest = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            head = (chunk % buckets, chunk, HEADER, digest, np.concatenate([*ids, size]).tobytes())
            return pd.DataFrame([head, *chunk_rows(sets, chunk, buckets)], columns=["bucket", "chunk", "kind", "tokens", "docs"])

        held = 0
        for b in batches:
            for i, none, t in zip(b["id"].to_numpy(np.int64), b["none"].to_numpy(np.int64), b["text"]):
                ids.append(np.array([i, none]))
                sets.append(np.unique(shingle_hashes(t, WIDTH)))
                held += len(sets[-1])
                if held >= CHUNK or len(sets) == CHUNK_DOCS:
                    yield made()
                    chunk, held = chunk + 1, 0
                    sets.clear()
                    ids.clear()
        if sets:
            yield made()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "bucket"):
            out = [(c, k, t, d, b"") for c, k, t, d in zip(b["chunk"], b["kind"], b["tokens"], b["docs"]) if k != ENTRIES]
            for bucket, own in b[b["kind"] == ENTRIES].groupby("bucket", sort=False):
                found = shared_in(bucket, [np.frombuffer(t, np.uint64) for t in own["tokens"]])
                out += [(c, SHARED, *f) for c, f in zip(own["chunk"], found) if f]
            yield pd.DataFrame(out, columns=["chunk", "kind", "tokens", "docs", "counts"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "chunk", 5_000):
            for _, own in b.groupby("chunk", sort=False):
                head, rest = own[own["kind"] == HEADER].iloc[0], own[own["kind"] == SHARED]
                digest = np.frombuffer(head["tokens"], np.int64).reshape(-1, 2)
                n = len(digest)
                numbers = np.frombuffer(head["docs"], np.int64)
                ids, size = numbers[: 2 * n].reshape(-1, 2), numbers[2 * n :]
                token, doc, count = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], [np.empty(0, np.uint8)]
                for t, d, c in zip(rest["tokens"], rest["docs"], rest["counts"]):
                    token.append(np.frombuffer(t, np.uint64))
                    doc.append(np.frombuffer(d, np.uint16))
                    count.append(np.frombuffer(c, np.uint8) if c else np.full(len(doc[-1]), MANY, np.uint8))
                token, doc, count = map(np.concatenate, (token, doc, count))
                order = np.lexsort((token, count, doc))
                token, edges = token[order].view(np.int64), np.searchsorted(doc[order], np.arange(n + 1))
                enough = np.diff(edges) * 100 >= PERCENT * size  # else no other set can overlap in so much
                shared = [token[s:e] if k else token[:0] for s, e, k in zip(edges, edges[1:], enough)]
                yield pd.DataFrame({"id": ids[:, 0], "none": ids[:, 1] > 0, "size": size, "digest": digest[:, 0], "more": digest[:, 1], "shared": shared})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().cast("long").alias("none"), F.col("text").cast("string"))
    sent = rows.mapInPandas(divide, "bucket int, chunk long, kind int, tokens binary, docs binary")
    sent = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(compare, "chunk long, kind int, tokens binary, docs binary, counts binary")
    sent = sent.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInPandas(gather, "id long, none boolean, size long, digest long, more long, shared array<long>")
    return cut(sent.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "size", "digest", "more", "shared"), "shingle-sets")


# --- DivideSkip -----------------------------------------------------------------------------------------------


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(id, lists that have it) of the ids in at least `need` of the sorted lists: a heap of their heads, from which so many
    are taken at once that what they pass over cannot be in enough lists."""
    heap = [(own[0], k, 0) for k, own in enumerate(lists) if own]
    heapify(heap)
    found = []
    while len(heap) >= need:
        least = heap[0][0]
        taken = []
        while heap and heap[0][0] == least:
            taken.append(heappop(heap))
        if len(taken) >= need:
            found.append((least, len(taken)))
            past = least + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heappop(heap))
            if not heap:
                break
            past = heap[0][0]
        for _, k, at in taken:
            at = bisect_left(lists[k], past, at)
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k, at))
    return found


class Lists:
    """Inverted lists of the shards of a frame: rows in order of (shard, size), nodes alone are listed."""

    def __init__(self, shard: np.ndarray, size: np.ndarray, node: np.ndarray, sets: list[np.ndarray]) -> None:
        self.n, self.size = len(size), size
        length = np.array([len(s) for s in sets])
        row, token = np.repeat(np.arange(self.n), length), np.concatenate([np.empty(0, np.int64), *sets])
        order = np.lexsort((row, token, shard[row]))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (token[a] != token[b]) | (shard[row[a]] != shard[row[b]])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        listed = order[node[row[order]]]
        self.post = row[listed]  # rows list after list
        self.key = of[listed] * self.n + self.post  # ascending: where a list has a row, by binary search
        self.edge = np.searchsorted(of[listed], np.arange(new.sum() + 1))
        self.of = np.split(of, np.cumsum(length)[:-1]) if self.n else []
        useful = np.diff(self.edge)[of] > node[row]  # lists with another row
        self.useful = np.bincount(row[useful], minlength=self.n)
        self.need = -(-PERCENT * size // 100)

    def partners(self, q: int, first: int, last: int, comp: np.ndarray) -> np.ndarray:
        """Rows in [first, last) of other components than row q that it links with."""
        need = int(self.need[q])
        own = self.of[q]
        start = np.searchsorted(self.key, own * self.n + first)
        end = np.searchsorted(self.key, own * self.n + last)
        many = end - start
        keep = many > 0
        own, start, end, many = own[keep], start[keep], end[keep], many[keep]
        if len(own) < need:
            return np.empty(0, np.int64)
        aside = min(need - 1, int(need / (MU * np.log2(max(2, int(many.max()))) + 1)))
        order = np.argsort(many, kind="stable")
        short, long = order[: len(order) - aside], own[order[len(order) - aside :]]
        if many[short].sum() <= MERGED:
            merged = merge_skip([self.post[s:e].tolist() for s, e in zip(start[short], end[short])], need - aside)
            row, have = np.array(merged, np.int64).reshape(-1, 2).T
        else:
            have = np.bincount(np.concatenate([self.post[s:e] for s, e in zip(start[short], end[short])]) - first, minlength=last - first)
            row = np.flatnonzero(have >= need - aside)
            have, row = have[row], row + first
        other = comp[row] != comp[q]
        row, have = row[other], have[other].copy()
        for a in range(0, len(row), 256):
            probe = (long * self.n)[None, :] + row[a : a + 256, None]
            at = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
            have[a : a + 256] += (self.key[at] == probe).sum(1)
        return row[100 * have >= PERCENT * (self.size[q] + self.size[row] - have)]


def joined(shard: np.ndarray, size: np.ndarray, node: np.ndarray, sets: list[np.ndarray], given: np.ndarray | None = None) -> np.ndarray:
    """Component (smallest row) of each row: rows of a shard link if one of them is a node and they are similar.

    Rows come in order of (shard, size). Rows of one given component are linked to begin with. In a larger shard rows are first compared with a few leaders; then only those outside its largest
    component search, so a group of near copies costs its size. All rows of a small shard search.
    """
    n = len(size)
    lists = Lists(shard, size, node, sets)
    a, b = [np.arange(n)], [np.arange(n)]
    if given is not None:
        lead, inverse = np.unique(given, return_index=True, return_inverse=True)[1:]
        b[0] = lead[inverse]
    able = (lists.useful >= lists.need) & (size > 0)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [n]])
    wide = [(s, e) for s, e in zip(edges, edges[1:]) if e - s > SMALL]
    for s, e in wide:
        sorted_sets = {}
        leaders: list[int] = []
        for q in (s + np.flatnonzero(able[s:e])).tolist():
            own = sorted_sets[q] = np.sort(sets[q])
            for r in leaders:
                if (node[q] or node[r]) and size[r] * 100 >= PERCENT * size[q]:
                    at = np.minimum(np.searchsorted(sorted_sets[r], own), len(sorted_sets[r]) - 1)
                    both = int((sorted_sets[r][at] == own).sum())
                    if 100 * both >= PERCENT * (size[q] + size[r] - both):
                        a.append(np.array([q]))
                        b.append(np.array([r]))
                        del sorted_sets[q]
                        break
            else:
                if len(leaders) == LEADERS:
                    del sorted_sets[leaders.pop(0)]
                leaders.append(q)
    comp = local_components(n, np.concatenate(a), np.concatenate(b))
    for s, e in zip(edges, edges[1:]):
        rows = s + np.flatnonzero(able[s:e])
        if not len(rows):
            continue
        if e - s > SMALL:
            name, many = np.unique(comp[s:e], return_counts=True)
            rows = rows[comp[rows] != name[many.argmax()]]
        elif not node[s:e].all():
            rows = rows[~node[rows]]
        low = s + np.searchsorted(size[s:e], -(-PERCENT * size[rows] // 100))
        high = s + np.searchsorted(size[s:e], 100 * size[rows] // PERCENT, "right") if e - s > SMALL or not node[s:e].all() else rows
        for q, first, last in zip(rows.tolist(), low.tolist(), high.tolist()):
            if first < last:
                found = lists.partners(q, first, last, comp)
                if len(found):
                    a.append(np.full(len(found), q))
                    b.append(found)
    a.append(np.arange(n))
    b.append(comp)
    return local_components(n, np.concatenate(a), np.concatenate(b))


def search_links(dealt: DataFrame) -> DataFrame:
    """(shard, id, size, shared, node[, given]) -> (src, dst): links that join each shard's rows into its components."""
    known = "given" in dealt.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "shard", 5_000):
            shard = b["shard"].to_numpy()
            alone = np.ones(len(shard), bool)
            alone[1:] &= shard[1:] != shard[:-1]
            alone[:-1] &= shard[1:] != shard[:-1]
            b = b[~alone]
            if not len(b):
                continue
            ids = b["id"].to_numpy()
            comp = joined(b["shard"].to_numpy(), b["size"].to_numpy(np.int64), b["node"].to_numpy(bool), list(b["shared"]), b["given"].to_numpy() if known else None)
            own = comp != np.arange(len(comp))
            yield pd.DataFrame({"src": ids[own], "dst": ids[comp[own]]})

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "size", "id").mapInPandas(run, "src long, dst long").where("src <> dst")


def first_shingles(vertices: DataFrame) -> DataFrame:
    """(id, key, place): of each set's first shingles those that another set has among its first too; written once.

    Shingles that the same sets have are one key.
    """
    need = F.ceil(F.col("size") * PERCENT / 100)
    first = F.greatest(F.size("shared") - need + 1, F.lit(0)).cast("int")  # what is left of size - need + 1 after its own shingles
    keys = cut(vertices.where(first > 0).select("id", F.posexplode(F.slice("shared", F.lit(1), first)).alias("place", "key")), "shingle-keys")
    mark = F.xxhash64("id")
    members = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y")).where("n > 1")
    kept = members.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return cut(keys.join(kept, "key").select("id", "key", "place"), "live-keys")


def with_sets(rows: DataFrame, vertices: DataFrame) -> DataFrame:
    return rows.join(vertices.select("id", "size", "shared"), "id")


def set_components(vertices: DataFrame) -> DataFrame:
    """(id, size, shared) -> (id, component): sets joined by links between them.

    Sets that share keys, directly or by way of others, form a group. A group of up to GROUP_ROWS is one shard, so its sets
    are sent once and not under every key. In a larger group each set first goes to the shard of its rarest key alone,
    which links most of what is alike; then only keys whose sets are in different components still are searched.
    A key of more than SHARD_ROWS sets is dealt in cells, and what is outside its largest component searches all its cells.
    No link is lost and no task gets a whole large key.
    """
    keys = first_shingles(vertices)
    least = keys.groupBy("key").agg(F.min("id").alias("dst"))
    groups = components(keys.join(least, "key").select(F.col("id").alias("src"), "dst"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    groups = cut(groups.join(sizes, "component").select("id", F.col("component").alias("group"), (F.col("n") > GROUP_ROWS).alias("large")), "shingle-groups")
    shards = with_sets(groups.where("not large").select("id", F.xxhash64("group").alias("shard")), vertices).withColumn("node", F.lit(True))
    rest = keys.join(groups.where("large").select("id"), "id", "left_semi")
    if rest.isEmpty():
        return components(search_links(shards))
    rest = cut(rest, "large-groups")
    own = rest.groupBy("id").agg(F.min_by("key", "place").alias("key"))
    large = cut(large_keys(own, SHARD_ROWS), "hot-keys")
    cool = own.join(large, "key", "left_anti").select("id", F.xxhash64("key").alias("shard")).withColumn("node", F.lit(True))
    dealt = cells(own.join(large, "key")).select("id", "shard", "node").unionByName(cool)
    found = cut(components(search_links(shards.unionByName(with_sets(dealt, vertices).select(shards.columns)))), "linked-sets")

    placed = rest.join(found, "id", "left").withColumn("given", F.coalesce("component", "id")).drop("component", "place")
    open_keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("given").alias("a"), F.max("given").alias("b")).where("a <> b").select("key", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("trees"))
    rows = cut(placed.join(open_keys, "key"), "open-keys")
    known = found.select(F.col("id").alias("src"), F.col("component").alias("dst"))
    met = rows.where("trees = 1").select("id", "given", F.xxhash64("key").alias("shard"), F.lit(True).alias("node"))
    crossed = crossings(rows.where("trees > 1").drop("given"), found, SHARD_ROWS)
    if crossed is not None:
        met = met.unionByName(crossed.select(met.columns))
    return components(known.unionByName(search_links(with_sets(met, vertices))))


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Texts with equal sets are one vertex. A null, empty or wordless text has no shingles and links with nothing, not
    with its like: its component is its own doc_id. A null doc_id gets its component's id, null if no row
    there has an id. Rows that repeat a doc_id are texts of their own. An empty table gives no rows.
    """
    rows = shingle_sets(docs)
    classes = rows.where("size > 0").groupBy("digest", "more", "size").agg(F.min("doc_id").alias("least"), F.first("shared").alias("shared"))
    vertices = cut(classes.withColumn("id", F.monotonically_increasing_id()), "shingle-classes")
    comps = set_components(vertices)
    named = vertices.join(comps, "id", "left").select("digest", "more", "size", "least", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "component").select("digest", "more", "size", "component_id")
    out = rows.select("doc_id", "size", "digest", "more").join(by_set, ["digest", "more", "size"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
