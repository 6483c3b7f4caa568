"""Merkle manifest, vector codes and n-gram join beside plain Python, with edge cases and hot groups."""

from __future__ import annotations

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsbook.llm import merkle, ngramjoin, vectorcodes

# --- Merkle manifest ----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    def field(v) -> str:
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(hashes: list[str]) -> list[list[str]]:
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def climb(tree: list[list[str]], at: int, own: str) -> tuple[list[str], str]:
        siblings = []
        for level in tree[:-1]:
            first = at - at % 16
            run = level[first : first + 16]
            siblings += run[: at - first] + run[at - first + 1 :]
            own = h(*run[: at - first], own, *run[at - first + 1 :])
            at //= 16
        return siblings, own

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sources = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        head = "".join(map(field, (doc_id, source, lang, n)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        sources[source].append((doc_id is not None, doc_id or 0, h(head, field(text)), h(head, field(text.translate(lower) if hit and text is not None else text)), doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda x: x[:4])
    trees = {s: levels([x[2] for x in sources[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, changed, doc_id) in enumerate(sources[s]):
            low, fold = climb(trees[s], at, changed)
            high, fold = climb(top, k, fold)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(*low, *high), fold, fold == top[-1][0]))
    return out


@pytest.mark.parametrize("kind", ["mixed", "one source", "one row", "many sources", "nothing"])
def test_manifest_equals_the_plain_rule(spark, kind):
    r = random.Random(kind)
    n = {"mixed": 600, "one source": 273, "one row": 1, "many sources": 300, "nothing": 0}[kind]
    name = {"mixed": lambda k: r.choice([None, "", "a", "a", "a", "Ä", "z", f"s{r.randrange(4)}"]), "many sources": lambda k: f"s{k % 290}"}.get(kind, lambda k: "only")
    rows = [(r.choice([k, k, None, k // 2]), r.choice([None, "", "Some TEXT", "é" * 5, "X" * 5000]), r.choice([None, "en"]), name(k), r.choice([None, k])) for k in range(n)]
    rows += rows[: n // 20]  # repeated rows
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS tree", "2 AS place", "'x' AS hash", "'y' AS leaf")
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = merkle.manifest(docs).collect()
    assert sorted(map(tuple, got)) == sorted(plain_manifest([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]))
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 2


def test_the_row_limit_is_lifted_and_put_back(spark):
    spark.conf.set(merkle.ROW_LIMIT, "10")
    try:
        assert merkle.manifest(spark.createDataFrame([(k, "T", None, "s", k) for k in range(900)], DOCS)).count() == 900
        assert spark.conf.get(merkle.ROW_LIMIT) == "10"
    finally:
        spark.conf.unset(merkle.ROW_LIMIT)


# --- vector codes -------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows: list[tuple]) -> list[tuple]:
    kept = sorted((i, tuple(np.float32(x) for x in e), label) for i, e, label in rows if e and all(x is not None and np.isfinite(x) for x in e))
    x = np.floor(np.array([r[1] for r in kept], np.float64) * 256).astype(np.int64)
    width = x.shape[1] // 16
    codes, errors, books = [], np.zeros(len(kept), np.int64), []
    for p in range(16):
        part = x[:, p * width : (p + 1) * width]
        book = part[:64].copy()
        for k in range(3):
            far = ((part[:, None] - book[None]) ** 2).sum(2)
            at = far.argmin(1)
            if k < 2:
                for e in range(len(book)):
                    if (at == e).any():
                        book[e] = part[at == e].sum(0) // (at == e).sum()
        codes.append(at)
        errors += far.min(1)
        books.append(book)
    digest = hashlib.sha256(",".join(map(str, np.array(books).ravel().tolist())).encode()).hexdigest()
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors.tolist()):
        by_label[label] += e
    return sorted((i, "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), by_label[label], digest) for k, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("n", [1, 40, 700])
def test_codes_equal_plain_k_means(spark, n):
    """Few and many rows, equal vectors, negative sums, nulls and values that are no numbers, a label of most rows."""
    rng = np.random.default_rng(n)
    rows = [(k, (rng.normal(0, 1, 48) * (k % 3)).astype(np.float32).tolist(), None if k % 7 == 0 else 0 if k % 3 else k % 50) for k in range(n)]
    rows += [(n + k, rows[0][1], 3) for k in range(n // 4)]
    bad = [(-1, None, 1), (-2, [None] * 48, 1), (-3, [float("nan")] * 48, 1), (-4, [float("inf")] * 48, None), (-5, [], 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(3).selectExpr("*", "1 AS code", "2 AS error", "3 AS n", "4 AS ids")
    got = vectorcodes.compress(df)
    assert sorted(map(tuple, got.collect())) == plain_codes(rows)


def test_codes_of_all_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = sorted(map(tuple, vectorcodes.compress(table).collect()))
    assert got == plain_codes([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])


def test_codes_of_odd_tables(spark):
    assert vectorcodes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    mixed = [(1, [1.0] * 32, 1), (2, [1.0] * 16, 1), (3, [2.0] * 17, 1), (None, [3.0] * 32, 1), (4, [2.0] * 32, 1), (4, [2.0] * 32, 1)]
    got = vectorcodes.compress(spark.createDataFrame(mixed, VECTORS)).collect()
    assert sorted(map(str, (r["vec_id"] for r in got))) == ["1", "4", "4", "None"] and all(r["error"] == 0 for r in got)
    with pytest.raises(Exception, match="do not fit"):
        vectorcodes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], VECTORS)).collect()


def test_hilbert_curve_is_a_walk():
    """Neighbours on the curve are neighbours in space, and every cell has a place of its own."""
    for axes, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = vectorcodes.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_shortlists_lose_no_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-30, 30, (rng.integers(1, 150), 32))
    order, laid, low, high, sums = vectorcodes.blocks_of(rows)
    book = rng.integers(-30, 30, (rng.integers(1, 64), 2))
    for p in (0, 15):
        entry, far, _ = vectorcodes.nearest(laid[p], low[p], high[p], book)
        want = ((laid[p][:, None].astype(np.int64) - book[None]) ** 2).sum(2)
        assert (entry == want.argmin(1)).all() and (far == want.min(1)).all()
        count, total = vectorcodes.part_sums(laid[p], low[p], high[p], sums[p], book)
        assert (count == np.bincount(entry, minlength=len(book))).all()
        assert (total == np.stack([laid[p][entry == e].sum(0) for e in range(len(book))])).all()


# --- n-gram join --------------------------------------------------------------------------------------------


def plain_sets(rows: list[tuple]) -> list[tuple]:
    """(doc_id, set) of each row."""
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(b" ".join(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([b" ".join(w)] if w else [])))
    return out


def plain_join(rows: list[tuple]) -> list[tuple]:
    sets = plain_sets(rows)
    unique = [s for s in dict.fromkeys(s for _, s in sets) if s]
    root = list(range(len(unique)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for k, s in enumerate(unique):
        for j, n in Counter(j for g in s for j in lists[g]).items():
            if 100 * n >= 85 * (len(s) + len(unique[j]) - n):
                root[find(k)] = find(j)
        for g in s:
            lists[g].append(k)
    comp = {s: find(k) for k, s in enumerate(unique)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[comp[s]] = min(i, least.get(comp[s], i))
    return [(i, len(s), least.get(comp[s]) if s else i) for i, s in sets]


def near_copies(r: random.Random, groups: int, size: int, words: int) -> list[list[str]]:
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(900)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            out.append(own if r.random() < 0.7 else own[: -r.randrange(1, 9)])
    return out


def test_join_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, ngramjoin.join_components(docs).collect()))
    assert got == sorted(plain_join([tuple(r) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("limits", ["usual", "small"])
def test_join_of_near_copies_and_a_common_line(spark, monkeypatch, limits):
    """Groups of near copies; with small limits they are larger than a group, a shard and a leader's reach."""
    if limits == "small":
        for name, value in {"GROUP_ROWS": 6, "SHARD_ROWS": 5, "SMALL": 3, "LEADERS": 2, "HEAVY": 2, "CHUNK": 400, "MERGED": 10}.items():
            monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(5)
    line = "this line is in every one of the documents here".split()
    texts = [" ".join(w + line) for w in near_copies(r, 4, 45, 70)] + [" ".join(w) for w in near_copies(r, 25, 2, 120)]
    rows = [(k, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    got = ngramjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = plain_join(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and 20 < len({c for _, _, c in want}) < len(rows)


def test_join_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three four"), (7, "ONE two three four"), (None, "one two"), (None, "alone here"), (8, "a b c d e"), (8, "other text of the same id"), (8, "a b c d e")]
    rows += [(9, "É b c d"), (10, "é b c d"), (11, "x" * 100_000), (12, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS size", "3 AS shared", "4 AS key")
    got = ngramjoin.join_components(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_join(rows)))
    assert ngramjoin.join_components(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=25), max_size=9), st.integers(1, 6))
def test_merge_skip_counts_as_a_plain_count(lists, need):
    lists = [sorted(set(x)) for x in lists]
    count = Counter(v for x in lists for v in x)
    assert ngramjoin.merge_skip(lists, need) == sorted((v, n) for v, n in count.items() if n >= need)


def test_search_of_one_shard_with_small_limits(monkeypatch):
    """joined() itself, where the limits hold: leaders, counted merges and crossing searches lose no link."""
    r = random.Random(9)
    sets = [np.unique([hash(x) for x in w]) for w in near_copies(r, 3, 40, 60)]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    want = np.arange(len(sets))
    while True:
        before = want.copy()
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (size[a] + size[b] - both):
                    want[a] = want[b] = min(want[a], want[b])
        if (before == want).all():
            break
    assert 1 < len(set(want.tolist())) < len(sets)
    for limits in ({}, {"SMALL": 4, "LEADERS": 1}, {"SMALL": 4, "LEADERS": 3, "MERGED": 5}, {"SMALL": 4, "MU": 0.01, "MERGED": 10**9}, {"MERGED": 0, "MU": 50.0}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(ngramjoin, name, value)
            got = ngramjoin.joined(np.zeros(len(sets), np.int64), size, np.ones(len(sets), bool), sets)
            assert (got == want).all(), limits
            node = np.arange(len(sets)) % 2 == 0  # the others search, with what is linked already
            crossed = ngramjoin.joined(np.zeros(len(sets), np.int64), size, node, sets, given=np.where(node, got, -1 - np.arange(len(sets))))
            assert all(crossed[a] == crossed[b] for a in range(len(sets)) for b in range(len(sets)) if got[a] == got[b] and node[a] and node[b])
