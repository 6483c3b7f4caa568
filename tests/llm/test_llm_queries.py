"""The registered queries on the smallest tables: beside SQL where there is some, else beside plain Python."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from opsbook.llm import decontaminate, graph, packing, quality, simhash, tokenfiles
from opsbook.llm.queries import ORACLES, QUERIES

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()


def plain_ids(path: str, texts: list[str], end: int) -> list[np.ndarray]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4") for x in texts]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_op2(spark, sf_dir, docs):
    rows = QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    ids = dict(zip(docs.doc_id, plain_ids(packing.tokenizer().path, list(docs.text), 0)))
    want = {(i, p, s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes())) for i, x in ids.items() for p, s in enumerate(range(0, len(x), 2048))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    used: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= sum(map(len, ids.values())) / 2048 * 1.02 + 2


def test_op3(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_benchmark_decontamination"](spark, sf_dir).collect()}
    exact = {(i, b["item_id"]) for i, t in zip(docs.doc_id, docs.text) for b in items if b["text"] in t}
    assert exact <= rows
    own, texts, keys = [], [], []
    for i, t in zip(docs.doc_id, docs.text):
        for b in items[:15]:
            own.append(decontaminate.words_of(b["text"]).astype(np.int64))
            texts.append(decontaminate.words_of(t).astype(np.int64))
            keys.append((i, b["item_id"]))
    score = decontaminate.align(own, texts) / np.array([2 * len(x) for x in own])
    few = {b["item_id"] for b in items[:15]}
    assert {k for k, s in zip(keys, score) if s >= decontaminate.LEAST_SCORE} == {r for r in rows if r[1] in few}


def test_op4(spark, sf_dir, docs):
    fps = np.array([simhash.fingerprint(simhash.shingle_hashes(t, 3)) for t in docs.text], np.int64).view(np.uint64)
    a, b = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 3
    comp = graph.local_components(len(fps), a[near], b[near])
    ids = docs.doc_id.to_numpy()
    want = {(int(ids[k]), f"{int(fps[k]):016x}", int(ids[comp[k]])) for k in range(len(fps))}
    assert set(map(tuple, QUERIES["op4_simhash_neardup"](spark, sf_dir).collect())) == want


def test_op5_keeps_held_out_apart(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in docs.doc_id)
    right = [rows[i]["lang_pred"] == x for i, x in zip(docs.doc_id, docs.lang) if rows[i]["held_out"]]
    assert sum(right) / len(right) > 0.9


def test_op6(spark, sf_dir, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {tuple(r) for r in QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    assert rows == {(i, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in zip(docs.doc_id, docs.text)}


def test_op7(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, sf_dir).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        r, w = rows[i], t.split()
        grams: dict[tuple, list[int]] = {}
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k : k + 3]), []).append(k)
        hit = {k + d for at in grams.values() if len(at) > 1 for k in at for d in range(3)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
        long: dict[tuple, list[int]] = {}
        for k in range(len(w) - quality.REPEAT_WORDS + 1):
            long.setdefault(tuple(w[k : k + quality.REPEAT_WORDS]), []).append(k)
        assert r["covered_words"] == len({k + d for at in long.values() if len(at) > 1 for k in at for d in range(quality.REPEAT_WORDS)})
        longest, place = 0, {}  # by growing windows from the words that repeat at all
        for k in (k for at in long.values() if len(at) > 1 for k in at):
            place.setdefault(tuple(w[k : k + quality.REPEAT_WORDS]), []).append(k)
        for at in place.values():
            for x in range(len(at)):
                for y in at[x + 1 :]:
                    n = quality.REPEAT_WORDS
                    while y + n < len(w) and w[at[x] + n] == w[y + n]:
                        n += 1
                    longest = max(longest, n)
        assert r["longest_repeat"] == longest
        assert r["kept"] == (not r["base_failed"] and r["covered_words"] <= 0.3 * len(w) and longest <= 100)


def test_op8(spark, sf_dir, docs):
    rows = {tuple(r) for r in QUERIES["op8_token_files"](spark, sf_dir).collect()}
    want, start = set(), 0
    for i, x in zip(docs.doc_id, plain_ids(tokenfiles.tokenizer().path, list(docs.text), 2)):
        want.add((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert rows == want


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Each stage on what its predecessor kept: columns stay, decisions take effect, the rest is left alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas().set_index("doc_id")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            seen.append(docs.toPandas().set_index("doc_id"))
    start, good, single, cut, clean = seen
    measured = quality.measure(list(start.text))
    n = measured.n_words
    keep = ~((n < 50) | (100 * measured.n_repeat_words > 50 * n)) & (measured.covered_words <= 0.3 * n) & (measured.longest_repeat <= 100)
    assert set(good.index) == set(start.index[keep])
    assert len(single) < len(good) and (single.text == good.text[single.index]).all()

    def shingles(t: str) -> set:
        w = t.lower().split()
        return set(zip(*(w[k:] for k in range(5))))

    sets = {i: shingles(t) for i, t in good.text.items()}
    kept = list(single.index)
    for x, i in enumerate(kept):  # no two that stay are near copies, and what went had one
        for j in kept[x + 1 :]:
            assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    for i in set(good.index) - set(single.index):
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in good.index if j != i)
    changed = cut.text != single.text[cut.index]
    assert (cut.n_chars[changed] == cut.text[changed].str.len()).all() and (cut.text[changed].str.len() < single.text[cut.index][changed].str.len()).all()
    leaked = set(cut.index) - set(clean.index)
    items = [b["text"] for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {i for i, t in cut.text.items() if any(b in t for b in items)} <= leaked and (clean.text == cut.text[clean.index]).all()
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(clean.index) and packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert whole == sorted(map(tuple, packed[["doc_id", "piece", "length", "ids_crc32"]].itertuples(index=False)))
