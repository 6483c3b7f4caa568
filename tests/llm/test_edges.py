"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import pytest

from opsbook.llm import chat, decontaminate, language, packing, quality, simhash, substrings, tokencount, tokenfiles, warc

pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, fp long, digest long, component_id long, length int, task int, score double, id long, node boolean"
LONG = " ".join(f"w{k * k % 7919}" for k in range(60_000))
WORDS = " ".join(f"word{k}" for k in range(80))
ROWS = [
    (1, WORDS, "en"), (1, WORDS, "en"), (2, WORDS, None), (3, None, "en"), (4, "", "fr"), (5, LONG, "fr"), (None, "no id here", "en"), (None, None, None),
    (6, "   \n\t ", "de"), (7, "1234 5678", "de"), (8, "a", "en"), (9, "\x00   é日本 😀", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", 1, "k", 1, 2, 3, 4, 5, 0.5, 6, True) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, none):
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(ROWS)
    comp = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert comp[1] == comp[2] == 1 and comp[3] == comp[4] == comp[6] == 3
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4, 6)} == {"0" * 16}
    assert simhash.simhash_components(none).count() == 0


def test_near_copies(docs, none):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1) for r in kept.select("doc_id").collect())
    assert ids == [-1, -1, 1, 1, 3, 5, 7, 8, 9]
    assert simhash.drop_near_copies(none).count() == 0


def test_substrings(docs, none):
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] == WORDS and by[3]["text"] is None and by[4]["text"] == "" and by[5]["text"] == LONG
    assert by[2]["text"].strip() == "" and by[2]["__removed"]["origins"] == [1]
    assert by[2]["digest"] == 2 and by[2]["key"] == "k"
    assert substrings.remove_repeats(none).count() == 0


def test_leaks(spark, docs, none):
    items = spark.createDataFrame([(10, " ".join(f"word{k}" for k in range(20, 40)), 1), (10, " ".join(f"word{k}" for k in range(20, 40)), 1), (11, None, 1), (12, "", 1), (13, "a", 1), (None, WORDS, 1)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 10), (2, 10)}
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048
    assert [r["length"] for r in rows if r["doc_id"] == 3] == [1]
    assert packing.pack(none).count() == 0


def test_language(docs, none):
    rows = language.identify(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 6, 7)} == {"und"}
    assert language.identify(none).count() == 0
    nothing = language.identify(docs.where("lang is null")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_token_counts(docs, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = tokencount.token_counts(docs, path).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == sorted((len((t or "").encode()), len(sp.encode(t or ""))) for _, t, _ in ROWS)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)
    assert tokencount.token_counts(none, path).count() == 0


def test_quality(docs, none):
    rows = quality.quality(docs).collect()
    assert len(rows) == len(ROWS)
    q = {r["doc_id"]: r["__quality"] for r in rows}
    assert q[1]["kept"] and not q[3]["kept"] and q[3]["n_words"] == 0 and q[4]["base_failed"] and q[6]["word_chars"] == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality(none).count() == 0


def test_token_files(docs, none):
    rows = sorted(tokenfiles.token_files(docs).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ROWS)
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    for a, b in zip(rows, rows[1:]):
        assert b["start"] == a["start"] + a["n_tokens"]
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert tokenfiles.token_files(none).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn int, role string, text string, messages string, t int"
    rows = [(1, 1, "assistant", "<|end|>%3C", "x", 1), (1, 0, "user", None, "x", 1), (1, 1, "assistant", "<|end|>%3C", "x", 1), (2, None, None, "", "x", 1), (None, 0, "user", "u", "x", 1)]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 20 and got[2]["n_turns"] == 1 and got[None]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_warc(spark):
    schema = "page_id long, url string, html string, payload string, target int, sha1 string"
    rows = [(1, "u", "same", "p", 1, "s"), (2, None, "same", "p", 1, "s"), (2, "again", "same", "p", 1, "s"), (3, "u\r\nX: y", None, "p", 1, "s"), (4, "u", "", "p", 1, "s"), (None, "u", "same", "p", 1, "s"), (None, "u", "other", "p", 1, "s"), (5, "é", "x" * 3_000_000, "p", 1, "s")]
    got = warc.archive_pages(spark.createDataFrame(rows, schema)).collect()
    want = [
        (1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 4), (None, "response", None, 5), (5, "response", None, 3_000_000),
    ]
    assert sorted(str((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])) for r in got) == sorted(map(str, want))
    assert warc.archive_pages(spark.createDataFrame([], schema)).count() == 0
