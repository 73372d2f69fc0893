"""The operators' queries over the tables of a folder, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, compression_quality, fingerprints, media, minhash_dedup, source_mixing, substring_dedup, suffix_dedup, tool_calls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words_removed(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(tool_calls.from_conversations(_table(spark, sf_dir, "conversations")), tool_calls.ANSWER)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes_removed(_table(spark, sf_dir, "documents")).drop("kept")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixture(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_tool_calls": op2_tool_calls,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_compression_quality": op6_compression_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_media": op9_media,
    "op10_source_mixing": op10_source_mixing,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT b, m FROM r JOIN both_ways ON v = a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(m) AS m FROM r GROUP BY v) c ON c.v = d.doc_id
""",
    "op3_substring_dedup": rf"""
WITH w AS (
  SELECT doc_id, i, w FROM (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents)
), x AS (
  SELECT doc_id, i, w, string_agg(w, ' ') OVER f AS s, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), h AS (
  SELECT doc_id, i, w, n = 35 AND count(*) OVER (PARTITION BY CASE WHEN n = 35 THEN s ELSE doc_id || ' ' || i END) > 1 AS hit FROM x
), g AS (
  SELECT doc_id, i, w, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h
)
SELECT d.doc_id, count(g.w) AS n_words, count(g.w) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(g.w, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
""",
    "op2_tool_calls": """
WITH m AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'call-' || conv_id || '-' || turn WHEN 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id
  FROM conversations
), x AS (
  SELECT *, CASE WHEN kind = 'message' THEN NULL ELSE call_id IN (SELECT call_id FROM m GROUP BY call_id HAVING count(DISTINCT kind) = 2) END AS linked FROM m
)
SELECT conv_id, turn, kind, call_id, linked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  CASE WHEN kind = 'call' THEN length(text) BETWEEN 1 AND 4000 END AS valid,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"query":' || to_json(text) || ',"turn":' || turn || '},"id":"' || call_id || '","kind":"call","linked":' || linked || ',"name":"answer"}'
    WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || call_id || '","kind":"result","linked":' || linked || '}'
    ELSE '{"content":' || to_json(text) || ',"kind":"message"}' END AS json
FROM x
""",
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f
""",
    "op7_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM b
), k AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS k FROM s
), c AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS hit FROM k
), t AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -51) + 50 AS begins FROM c WHERE hit
), u AS (SELECT doc_id, i, sum(begins::int) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM t
), r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM u GROUP BY doc_id, span
), v AS (SELECT doc_id, h, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r JOIN b USING (doc_id)
), g AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM v GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN g USING (doc_id)
""",
}
