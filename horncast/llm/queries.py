"""The dealt operators as queries over the test tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, chat, common, decontaminate, language_id, mixing, near_dup, quality_crf, sharding, url_filter, warc

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIX_WEIGHTS, MIX_REPEATS = (5.0, 2.0, 1.0), 3
SHARDS = 16
QUALITY_CUT = 0.3


def op1_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.with_classes(docs).select("doc_id", "class_id", "class_rows", "class_texts")


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality_crf.held_out("doc_id", 5, 0))
    model = quality_crf.train(docs, labels, id_column="doc_id", text="text", label="quality")
    scored = quality_crf.score_texts(docs, model)
    predicted = F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0)
    return scored.select("doc_id", quality_crf.held_out("doc_id", 5, 0).alias("held_out"), "score", predicted.alias("predicted"), "n_lines")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.read_archive(spark, warc.write_archive(pages))
    return records.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


#: SHA-1 in base 32: each group of 10 hexadecimal digits is 40 bits, or 8 digits of 5 bits.
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * g}, 10))::UBIGINT >> {35 - 5 * i}) & 31)::INT, 1)" for g in range(4) for i in range(8)
)
OP3_SQL = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
heads AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM bodies),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS original FROM heads)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM firsts
"""


def op4_containment_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, common.read(spark, sf_dir, "benchmark"))


def op5_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality_crf.held_out("doc_id", 3, 1)
    model = language_id.train(docs.where(~held_out), text="text", lang="lang")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(
        docs.select("doc_id", "source", common.word_count(F.col("text")).alias("words")), F.col("words"), weights=MIX_WEIGHTS, max_repeats=MIX_REPEATS, shards=SHARDS
    )
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shard_taken")


def op7_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_tree.search(vectors, lambda i: i % 20 == 0, id_column="vec_id", vector="embedding", k=20)


def op8_typed_parts_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    formatted = chat.format_conversations(turns.unionByName(extra), chat.text_parts(F.col("text")))
    return chat.digests(formatted, "conv_id")


#: Control strings are found from their first character on; none begins inside another.
_CONTROL = r"\\|<(\||/?s>|/?unk>|/?pad>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|\[(/?INST\]|/?AVAILABLE_TOOLS\]|/?TOOL_RESULTS\]|TOOL_CALLS\])"
OP8_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(role, '\n'))
    + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + length('<|turn|>') + length('<|end|>') + 2 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op9_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return sharding.shard_interleaved(docs, SHARDS, carry=["doc_id", "source"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source"
    )


QUERIES = {
    "op1_probminhash_dedup": op1_probminhash_dedup,
    "op2_crf_quality": op2_crf_quality,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_containment_leaks": op4_containment_leaks,
    "op5_word_first_language": op5_word_first_language,
    "op6_sainte_lague_mix": op6_sainte_lague_mix,
    "op7_kmeans_tree_search": op7_kmeans_tree_search,
    "op8_typed_parts_chat": op8_typed_parts_chat,
    "op9_bloom_cascade_urls": op9_bloom_cascade_urls,
    "op10_stratified_shards": op10_stratified_shards,
}

ORACLES = {"op3_warc_revisits": OP3_SQL, "op8_typed_parts_chat": OP8_SQL, "op9_bloom_cascade_urls": OP9_SQL}
