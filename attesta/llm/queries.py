"""The queries op1 to op10 over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), percent=150, most=2)


def op2_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.vamana import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.warc import archive_and_read

    found = archive_and_read(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from attesta.llm import scratch, token_files

    folder = scratch.new_path(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    indexed = token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    columns = ["doc_id", "file", "offset", "length", "n_tokens", "id_bytes", "start"]
    sequences = token_files.read(token_files.starts(indexed).select(*columns), folder, packed=True)
    return sequences.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.kneser_ney import classify

    judged = classify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from attesta.llm.byte_bpe import decode_documents, encode_documents

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode_documents(encode_documents(docs, *vocabulary), *vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.chat_format import format_conversations, read_back

    said = "'</s>[INST] ok [/INST]'"
    hard = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    found = read_back(format_conversations(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.quality_rules import POLICIES, apply_policy, mask_of, measure, with_ledger

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_policy(with_ledger(measure(docs)), "full-1")
    base = F.col("failed_rules").bitwiseAND(F.lit(mask_of(POLICIES["base-1"])).cast("long")) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_rules")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.toxicity import toxicity

    # The labels have one toxicity category; what makes text junk comes before it in the chain.
    labels = _table(spark, sf_dir, "labels").withColumn("junk", 1 - F.col("quality"))
    return toxicity(_table(spark, sf_dir, "documents"), labels, ["junk", "toxic"])


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, width=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_vamana": op2_vamana,
    "op3_warc": op3_warc,
    "op4_token_files": op4_token_files,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT r, u.i AS i, ws[u.i] AS a, ws[u.i + 1] AS b, ws[u.i + 2] AS c
  FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM worded GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered c ON w.r = c.r LEFT JOIN dup ON w.r = dup.r),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars > 25 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT
    + 64 * (2 * n_capitals > word_chars)::INT AS BIGINT) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed,
  failed_rules = 0 AS kept, failed_rules
FROM f
"""

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap,
    sum(source_size) OVER () * 1.5 AS budget FROM s),
r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
f AS (SELECT *, CAST(cap * ws AS DOUBLE) <= (CAST(budget AS DOUBLE) - caps) * w AS is_full FROM r),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE least(CAST(cap AS DOUBLE), (CAST(budget AS DOUBLE) - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w
      / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
b AS (SELECT source, h >> 24 AS leaf, sum(size) AS size FROM d GROUP BY ALL),
c AS (
  SELECT b.source, leaf, p.target - p.passes * p.source_size AS rest, b.size,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY leaf) AS upto
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
k AS (
  SELECT source, leaf, upto <= rest OR (upto - rest < rest - (upto - size)
    AND NOT coalesce(lag(upto) OVER (PARTITION BY source ORDER BY leaf) > rest, false)) AS again FROM c)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * (p.passes + CASE WHEN k.again THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h >> 24 = k.leaf
"""

_OP7 = r"""
WITH x AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
y AS (
  SELECT *, contains(text, '<|turn|>') OR contains(text, '<|end|>') AS esc,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;') AS head FROM x),
z AS (
  SELECT *, 8 + 1 + length(head) + 1 + 7 + 1
    + length(CASE WHEN esc THEN replace(replace(text, '&', '&amp;'), '<', '&lt;') ELSE text END) AS n FROM y),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS loss,
    sum(n) AS n FROM z GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(n AS BIGINT) AS formatted_chars FROM g
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _OP1,
    "op7_chat_format": _OP7,
    "op8_quality_rules": _OP8,
    "op10_minhash_near_dedup": _OP10,
}
