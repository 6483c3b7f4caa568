"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, merkle, ngramjoin, packing, quality, simhash, substrings, tokencount, tokenfiles, vectorcodes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after dedup, and the documents that hold what was removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "text", F.col("__removed.bytes").alias("removed_bytes"), F.col("__removed.spans").alias("removed_spans"), F.col("__removed.origins").alias("repeat_of")
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__quality.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of other formats' control strings."""
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, 0 AS turn, 'user' AS role, '{probe}' AS text UNION ALL SELECT -7L, 1, 'assistant', '{probe}'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(rows))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_best_fit_packing, op3_benchmark_decontamination, op4_simhash_neardup, op5_language_id,
        op6_token_counts, op7_quality_rules, op8_token_files, op9_chat_format, op10_warc_archives, op11_merkle_manifest, op12_vector_codes, op13_ngram_join,
    )
}

ORACLES: dict[str, str] = {
    "op9_chat_format": """
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B') AS role_out,
         replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B') AS text_out
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(length('<|begin|>') + sum(length('<|turn|><|text|><|end|>') + length(role_out) + length(text_out)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op10_warc_archives": """
WITH keyed AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), lead AS (SELECT hex, max(page_id) AS first_id FROM keyed GROUP BY hex),
bits AS (SELECT hex, first_id, CAST(unhex(hex) AS BIT)::VARCHAR AS b FROM lead)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(b, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
         + 4 * CAST(substr(b, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
         + CAST(substr(b, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM keyed JOIN bits USING (hex)
""",
    "op11_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
           list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text) || ':' ||
         CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed
  FROM fields
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS total
  FROM leaves
), low AS (
  SELECT tree, 0 AS level, place, total, leaf AS hash FROM placed
  UNION ALL SELECT tree, level + 1, place // 16, (total + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)) FROM low WHERE total > 1 GROUP BY tree, level, place // 16, total
), subroots AS (SELECT tree, level, hash, count(*) OVER () AS total FROM low WHERE total = 1),
high AS (
  SELECT 0 AS level, tree AS place, total, hash FROM subroots
  UNION ALL SELECT level + 1, place // 16, (total + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)) FROM high WHERE total > 1 GROUP BY level, place // 16, total
), members AS (
  SELECT tree, level, place, hash, tree AS up_tree, level + 1 AS up_level, place // 16 AS up_place FROM low WHERE total > 1
  UNION ALL SELECT -1, level, place, hash, -1, level + 1, place // 16 FROM high WHERE total > 1 AND level > 0
  UNION ALL SELECT tree, level, 0, hash, -1, 1, tree // 16 FROM subroots WHERE total > 1
), nodes AS (
  SELECT a.tree, a.level, a.place, a.up_tree, a.up_level, a.up_place, coalesce(string_agg(b.hash, '' ORDER BY b.tree, b.place) FILTER (WHERE (b.tree, b.place) < (a.tree, a.place)), '') AS before,
         coalesce(string_agg(b.hash, '' ORDER BY b.tree, b.place) FILTER (WHERE (b.tree, b.place) > (a.tree, a.place)), '') AS after
  FROM members a JOIN members b USING (up_tree, up_level, up_place) GROUP BY ALL
), climb AS (
  SELECT tree AS of_tree, place AS of_place, tree, 0 AS level, place, changed AS fold, '' AS siblings FROM placed
  UNION ALL
  SELECT c.of_tree, c.of_place, n.up_tree, n.up_level, n.up_place, sha256(n.before || c.fold || n.after), c.siblings || n.before || n.after FROM climb c JOIN nodes n USING (tree, level, place)
), ends AS (SELECT of_tree, of_place, max_by(siblings, CASE WHEN tree = -1 THEN 1000 ELSE 0 END + level) AS siblings,
            max_by(fold, CASE WHEN tree = -1 THEN 1000 ELSE 0 END + level) AS folded_root FROM climb GROUP BY 1, 2),
root AS (SELECT hash AS root FROM high WHERE total = 1)
SELECT p.doc_id, p.leaf, s.hash AS subroot, root, sha256(e.siblings) AS proof_sha256, e.folded_root, e.folded_root = root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN ends e ON e.of_tree = p.tree AND e.of_place = p.place, root
""",
    "op12_vector_codes": """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT r, i // (len(embedding) // 16) AS p, i % (len(embedding) // 16) AS j, CAST(floor(256 * embedding[CAST(i + 1 AS BIGINT)]::DOUBLE) AS BIGINT) AS x
  FROM (SELECT r, embedding, unnest(range(len(embedding))) AS i FROM kept)
), b0 AS (SELECT p, r - 1 AS e, j, x FROM cells WHERE r <= 64),
a1 AS (
  SELECT r, p, min([d, e]) AS best FROM (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN b0 b USING (p, j) GROUP BY ALL) GROUP BY ALL
), b1 AS (
  SELECT o.p, o.e, o.j, coalesce(m.x, o.x) AS x FROM b0 o LEFT JOIN (
    SELECT c.p, a.best[2] AS e, c.j, CAST(floor(sum(c.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM cells c JOIN a1 a USING (r, p) GROUP BY ALL) m USING (p, e, j)
), a2 AS (
  SELECT r, p, min([d, e]) AS best FROM (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN b1 b USING (p, j) GROUP BY ALL) GROUP BY ALL
), b2 AS (
  SELECT o.p, o.e, o.j, coalesce(m.x, o.x) AS x FROM b1 o LEFT JOIN (
    SELECT c.p, a.best[2] AS e, c.j, CAST(floor(sum(c.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM cells c JOIN a2 a USING (r, p) GROUP BY ALL) m USING (p, e, j)
), a3 AS (
  SELECT r, p, min([d, e]) AS best FROM (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN b2 b USING (p, j) GROUP BY ALL) GROUP BY ALL
),
coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a3 GROUP BY r),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
""",
}
