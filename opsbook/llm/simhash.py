"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Trees are not broadcast whole, because the number of fingerprints has no bound. They are dealt out in
shards by keys that any two linked fingerprints share at least once (equal bit blocks, or MinHash bands),
each shard's tree meets its queries in one task, and a search follows only edges within the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, local_components
from .shared import cut, whole_groups

SHARD_ROWS = 16_384  # rows of one tree, and rows that search it in one task; a larger shard is split
SET_ROWS = 1024  # the same where rows carry their shingle sets
DEALS = 2  # times that the rows of a larger shard are dealt in cells
BLOCK = 1 << 16  # shingles counted at once in a long text
PAIRS = 1 << 15  # pairs whose signatures are compared at once
BANDS, BAND_ROWS, SIGNATURE = 16, 3, 128
ESTIMATE_MARGIN = 0.15  # four times a signature's standard error at similarity 0.8: the exact check follows


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words; a shorter text is one shingle, no words give none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space divides
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in more than half of the hashes; signed 64-bit."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null and wordless texts get 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, width)) for t in b["text"]], np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


# --- BK-trees -----------------------------------------------------------------------------------------------


def bk_forest(group: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each group of the rows with node set, inserted in row order, level by level.

    Returns root (of each row's group, -1: no tree), parent, edge (distance to the parent) and depth.
    """
    n = len(fp)
    root, parent = np.full(n, -1), np.full(n, -1)
    edge, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(node)
    if not len(at):
        return root, parent, edge, depth
    first = at[np.unique(group[at], return_index=True)[1]]
    pos = np.clip(np.searchsorted(group[first], group), 0, len(first) - 1)
    root = np.where(group[first][pos] == group, first[pos], -1)
    todo = at[root[at] != at]
    here, level = root[todo], 1
    while len(todo):
        d = np.bitwise_count(fp[todo] ^ fp[here]).astype(np.int64)
        key, lead, inverse = np.unique(here * 65 + d, return_index=True, return_inverse=True)
        child = todo[lead]
        parent[child], edge[child], depth[child] = key // 65, key % 65, level
        here, stay = child[inverse], np.ones(len(todo), bool)
        stay[lead] = False
        todo, here, level = todo[stay], here[stay], level + 1
    return root, parent, edge, depth


def linked(group: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, alike: Callable | None = None, given: np.ndarray | None = None) -> np.ndarray:
    """Component (smallest row) of each row: rows of a group link within radius, and if alike(a, b).

    Nodes are in their group's tree. All rows search it, or only those that are no nodes where there are any. Rows of
    one given component are linked to begin with. Tree edges within the radius are merged first. A search then
    leaves out subtrees that lie wholly in the query's component, so a large group of near copies costs its size, not
    its square.
    """
    n = len(fp)
    alike = alike or (lambda a, b: np.ones(len(a), bool))
    root, parent, edge, depth = bk_forest(group, fp, node)
    kids = np.flatnonzero(parent >= 0)
    a, b = kids, parent[kids]
    ok = (edge[a] <= radius)
    a, b = a[ok], b[ok]
    ok = alike(a, b)
    a, b = a[ok], b[ok]
    if given is not None:
        lead, inverse = np.unique(given, return_index=True, return_inverse=True)[1:]
        a, b = np.append(a, np.arange(n)), np.append(b, lead[inverse])
    comp = local_components(n, a, b)
    order = kids[np.argsort(parent[kids] * 65 + edge[kids], kind="stable")]
    keys = parent[order] * 65 + edge[order]
    deepest = np.argsort(-depth[kids], kind="stable")
    levels = np.split(kids[deepest], np.flatnonzero(np.diff(depth[kids][deepest])) + 1) if len(kids) else []

    def uniform() -> np.ndarray:
        same = np.ones(n, bool)
        for v in levels:
            same[parent[v[~same[v] | (comp[v] != comp[parent[v]])]]] = False
        return same

    rows = np.flatnonzero((root >= 0) & ~(node & (~node).any()))
    for start in range(0, len(rows), SHARD_ROWS):
        q = rows[start : start + SHARD_ROWS]
        v, same = root[q], uniform()
        found: list[np.ndarray] = []
        while len(q):
            live = ~(same[v] & (comp[q] == comp[v]))
            q, v = q[live], v[live]
            d = np.bitwise_count(fp[q] ^ fp[v]).astype(np.int64)
            hit = (d <= radius) & (comp[q] != comp[v])
            if hit.any():
                x, y = q[hit], v[hit]
                ok = alike(x, y)
                found.append(np.stack([x[ok], y[ok]]))
            lo = np.searchsorted(keys, v * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(keys, v * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            q = np.repeat(q, many)
            v = order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        if found:
            pairs = np.concatenate(found, axis=1)
            comp = comp[local_components(n, *np.concatenate([pairs, np.stack([np.arange(n), comp])], axis=1))]
            while (comp[comp] != comp).any():
                comp = comp[comp]
    return comp


def large_keys(rows: DataFrame, most: int) -> DataFrame:
    """(key, trees) of the keys with more than `most` rows, in how many cells they are dealt."""
    return rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("trees"))


def cells(hot: DataFrame) -> DataFrame:
    """Rows of large keys, each in a cell of its key in each of DEALS dealings: cells of two dealings overlap, so what is
    one component in most cells becomes one in all."""
    dealt = hot.withColumn("deal", F.explode(F.array(*map(F.lit, range(DEALS)))))
    return dealt.withColumns({"shard": F.xxhash64("key", "deal", F.pmod(F.xxhash64("id", "key", "deal"), "trees")), "node": F.lit(True)}).drop("deal", "trees")


def crossings(hot: DataFrame, comps: DataFrame, most: int) -> DataFrame | None:
    """Rows that must yet meet: those outside their key's largest component search every cell of the key.

    A cell's rows are copied to each part of so many searching rows, so a shard holds about twice `most` rows. Keys
    whose rows have become one component are left out; None if all have. What the largest component holds is linked
    already, so a key costs its size times the number of parts that stand outside it, not its square.
    """
    rows = hot.join(comps.withColumnRenamed("id", "_id"), hot["id"] == F.col("_id"), "left").withColumn("given", F.coalesce("component", "id")).drop("_id", "component")
    sizes = rows.groupBy("key", "given").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("given", F.struct("n", "given")).alias("top"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    keys = cut(keys.withColumn("parts", F.ceil(F.col("outside") / most).cast("int")).drop("outside"), "open-keys")
    if keys.isEmpty():
        return None
    rows = rows.join(keys, "key")
    nodes = rows.withColumns({"tree": F.pmod(F.xxhash64("id"), "trees").cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "node": F.lit(True)})
    trees = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    search = rows.where("given <> top").withColumns({"tree": trees, "part": F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int"), "node": F.lit(False)})
    met = nodes.unionByName(search).withColumn("shard", F.xxhash64("key", "tree", "part"))
    return met.drop("tree", "part", "trees", "parts", "top")


def search_links(dealt: DataFrame, radius: int, similarity: float | None) -> DataFrame:
    """(shard, id, fp, node[, given][, sig[, grams]]) -> (src, dst): links that join each shard's rows into its components."""
    size, exact, known = SIGNATURE // 2, "grams" in dealt.columns, "given" in dealt.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "shard", 5_000 if exact else 50_000):
            group = b["shard"].to_numpy()
            alone = np.ones(len(group), bool)
            alone[1:] &= group[1:] != group[:-1]
            alone[:-1] &= group[1:] != group[:-1]
            b, group = b[~alone], group[~alone]
            if not len(group):
                continue
            alike = None
            if similarity is not None:
                sig = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(-1, size)
                sets = [np.frombuffer(g, np.uint64) for g in b["grams"]] if exact else None

                def alike(x: np.ndarray, y: np.ndarray, sig: np.ndarray = sig, sets: list[np.ndarray] | None = sets) -> np.ndarray:
                    ok = np.empty(len(x), bool)
                    for k in range(0, len(x), PAIRS):
                        ok[k : k + PAIRS] = same_share(sig[x[k : k + PAIRS]], sig[y[k : k + PAIRS]]) >= similarity - ESTIMATE_MARGIN
                    if sets is not None:
                        for k in np.flatnonzero(ok):
                            ok[k] = jaccard_reaches(sets[x[k]], sets[y[k]], similarity)
                    return ok

            ids = b["id"].to_numpy()
            comp = linked(group, b["fp"].to_numpy().view(np.uint64), b["node"].to_numpy(), radius, alike, b["given"].to_numpy() if known else None)
            own = comp != np.arange(len(comp))
            yield pd.DataFrame({"src": ids[own], "dst": ids[comp[own]]})

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "id").mapInPandas(run, "src long, dst long").where("src <> dst")


def shard_components(rows: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """(key, id, fp[, sig[, grams]]) -> (id, component) of the links between rows of one key.

    With similarity, linked rows have an estimate no more than ESTIMATE_MARGIN below it; with grams also, their
    Jaccard similarity itself is that high.

    A key with more rows than a tree takes is linked in steps: its cells on their own, then whatever lies in different
    components still. No link is lost and no task gets the whole key.
    """
    most = SET_ROWS if "grams" in rows.columns else SHARD_ROWS
    large = cut(large_keys(rows, most), "hot-keys")
    if large.isEmpty():
        return components(search_links(rows.withColumns({"shard": F.col("key"), "node": F.lit(True)}), radius, similarity))
    hot, cool = rows.join(large, "key"), rows.join(large, "key", "left_anti")
    dealt = cells(hot).unionByName(cool.withColumns({"shard": F.col("key"), "node": F.lit(True)}))
    found = components(search_links(dealt, radius, similarity))
    met = crossings(hot, found, most)
    if met is None:
        return found
    known = found.select(F.col("id").alias("src"), F.col("component").alias("dst"))
    return components(known.unionByName(search_links(met, radius, similarity)))


# --- linking by fingerprint alone ---------------------------------------------------------------------------


def block_keys(fp: Column, radius: int) -> Column:
    """Keys of which two fingerprints within the radius share at least one.

    64 bits in radius + 1 blocks: one block is equal. The other bits again in radius + 1 blocks: again one
    is equal. The key is the pair, 28 bits of 64 at radius 3.
    """
    def split(bits: int) -> list[tuple[int, int]]:
        edges = [round(k * bits / (radius + 1)) for k in range(radius + 2)]
        return [(s, e - s) for s, e in zip(edges, edges[1:])]

    def take(x: Column, start: int, bits: int) -> Column:
        return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << bits) - 1))

    keys = []
    for s, w in split(64):
        low = take(fp, 0, s) if s else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, s + w), s)) if s + w < 64 else low
        for t, u in split(64 - w):
            keys.append(F.xxhash64(F.lit(len(keys)), take(fp, s, w), take(rest, t, u)))
    return F.array(*keys)


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints within radius bits.

    Equal fingerprints become one vertex before any search. A null text has fingerprint zero, and so has a
    text without words; they link like any other. A null doc_id keeps its fingerprint and gets its
    component's id, null if no row there has an id. Repeated rows return as often as they come. An empty table gives no
    rows.
    """
    fps = cut(fingerprints(docs, width), "fingerprints")
    vertices = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keyed = vertices.select(F.explode(block_keys(F.col("fp"), radius)).alias("key"), F.col("fp").alias("id"), "fp")
    comps = shard_components(keyed, radius)
    named = vertices.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- linking by fingerprint and similarity ------------------------------------------------------------------


def _mixers(n: int) -> np.ndarray:
    return (np.random.default_rng(64).integers(1 << 62, size=n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(hashes: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """MinHash of the shingle set under each mixer: the upper 32 bits of odd multiples."""
    least = np.full(len(mixers), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 4096):
        h = hashes[k : k + 4096]
        h = h ^ (h >> np.uint64(29))
        least = np.minimum(least, ((h[None, :] * mixers[:, None]) >> np.uint64(32)).astype(np.uint32).min(1))
    return least


def same_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity estimated from two packed signatures of four bits a hash."""
    eq = ((x ^ y) & 15 == 0).sum(1) + ((x ^ y) >> 4 == 0).sum(1)
    return (eq / (2 * x.shape[1]) - 1 / 16) * 16 / 15


def jaccard_reaches(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted unique arrays, have that Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(doc_id, component_id) of the documents that have an exact or near copy.

    At a similarity of 0.8 fingerprints differ in more bits than equal bit blocks can find. So a first pass takes
    MinHash bands as shards (a pair at 0.8 shares one with probability 0.99999), searches a shard's BK-tree of SimHash
    fingerprints, of each shingle once, to `radius`, and keeps hits by a generous estimate. A second pass searches
    the components of the first and links only pairs whose shingle sets have the similarity itself.
    Texts equal but for case and spacing are one vertex. Wordless and null texts are copies of each other.
    Rows without doc_id take no part. An empty table gives no rows.
    """
    mixers = _mixers(SIGNATURE)

    def packed(sig: np.ndarray) -> bytes:
        low = (sig & np.uint32(15)).astype(np.uint8)
        return (low[::2] | low[1::2] << 4).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                h = np.unique(shingle_hashes(t, width))
                sig = signature(h, mixers)
                words = (t or "").encode().lower().split()
                bands = sig[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
                keys = [xxhash.xxh64_intdigest(bytes([k]) + x.tobytes()) - (1 << 63) for k, x in enumerate(bands)] if len(h) else []
                out.append((i, xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), fingerprint(h), packed(sig), keys))
            yield pd.DataFrame(out, columns=["doc_id", "same", "fp", "sig", "keys"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grams = [np.unique(shingle_hashes(t, width)) for t in b["text"]]
            fps = [fingerprint(h) for h in grams]
            yield pd.DataFrame({"key": b["key"], "id": b["id"], "fp": fps, "sig": [packed(signature(h, mixers)) for h in grams], "grams": [h.tobytes() for h in grams]})

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(texts.mapInPandas(run, "doc_id long, same long, fp long, sig binary, keys array<long>"), "sketches")
    vertices = cut(rows.groupBy("same", "fp").agg(F.min_by(F.struct("doc_id", "sig", "keys"), "doc_id").alias("r")).select("same", "fp", "r.*"), "vertices")
    keyed = vertices.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "fp", "sig")
    near = shard_components(keyed, radius, similarity)
    found = texts.join(near, texts["doc_id"] == near["id"]).select(F.col("component").alias("key"), "id", "text")
    found = cut(found.mapInPandas(sets, "key long, id long, fp long, sig binary, grams binary"), "near-sets")
    comps = shard_components(found, radius, similarity)
    copies = rows.select("doc_id", "same", "fp").join(vertices.select("same", "fp", F.col("doc_id").alias("id")), ["same", "fp"])
    return (
        copies.join(comps, "id", "left")
        .select("doc_id", F.coalesce("component", "id").alias("component_id"), "component")
        .where("component is not null or doc_id <> component_id")
        .select("doc_id", "component_id")
    )


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rows that have a near copy with a smaller doc_id in their group; all columns stay.

    Rows that repeat a kept doc_id are the same document and stay; rows without doc_id stay.
    """
    gone = near_copies(docs, **settings).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
