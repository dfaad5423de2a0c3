"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.llm import conversation_repair, exact_dedup, language_id, line_dedup, mixing, packing, quality, secret_scan, simhash_dedup, token_counts, topk_search, warc, whitening
from softgrove.llm.common import read, scratch_path, written

#: Folder of the public tokenizer files; a parameter of the installation.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer_file(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "__language.*")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(read(spark, sf_dir, "documents"))
    n = {name: secret_scan.n_of(F.col("base"), kind).alias(f"n_{name}")
         for kind, name in enumerate(secret_scan.KINDS[:3])}
    return found.select(
        F.col("id").alias("doc_id"), n["assign"], n["access"], n["hex"],
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"), "n_live", "n_examples",
        secret_scan.verdicts(F.col("spans")).alias("verdicts"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line_no", "kept", F.col("first.id").alias("first_doc_id"),
                        F.col("first.line_no").alias("first_line_no"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return found.withColumnRenamed("id", "doc_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("keep_id").alias("component_id"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "bucket")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.records(read(spark, sf_dir, "pages")), path)
    taken = warc.captures(warc.read_archives(spark, path))
    page_id = F.regexp_extract(F.decode("metadata.block", "utf-8"), r"page-id: (-?\d+)", 1)
    taken = written(taken.select(
        F.when(page_id != "", page_id.cast("long")).alias("page_id"), "response.payload_bytes",
        "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.record_id").alias("own"),
        F.col("response.refers_to").alias("target")), "captures")
    first = taken.filter("record_type = 'response'").select(
        F.col("own").alias("target"), F.col("page_id").alias("refers_to")).distinct()
    return taken.join(first, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.assess(docs, model).select(
        "doc_id", *[F.col(f"__quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                               "n_repeat_words", "base_failed", "kept", "score")])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(read(spark, sf_dir, "conversations"))
    return conversation_repair.audited(damaged)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_topk_search": op11_topk_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM f
    """,
    "op10_mixing": r"""
        WITH d AS (
          SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                 CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS draw
          FROM documents),
        c AS (
          SELECT *, CASE WHEN size < 4 THEN size
                         ELSE 4 * length(bin(size)) + ((size >> (length(bin(size)) - 3)::INT) & 3) END AS class,
                 draw % greatest(1, (SELECT (count(*) + 19999) // 20000 FROM documents)) AS bucket
          FROM d),
        s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
        w AS (
          SELECT *, 2.0::DOUBLE * source_size AS cap,
                 CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight
          FROM s),
        f AS (
          SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                    <= weight * ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 1.5::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    AS is_full
          FROM w),
        t AS (
          SELECT skey, source_size, CASE WHEN is_full THEN cap ELSE
                 weight * ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 1.5::DOUBLE
                           - coalesce((SELECT sum(cap) FROM f WHERE is_full), 0))
                        / (SELECT sum(weight) FROM f WHERE NOT is_full) END AS target
          FROM f),
        r AS (
          SELECT c.doc_id, c.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 16777216) AS BIGINT) ELSE 0 END AS step,
                 CAST('0x' || substr(md5('7|offset|' || c.skey), 1, 8) AS BIGINT) % 16777216 AS start,
                 row_number() OVER (PARTITION BY c.skey ORDER BY class, bucket, size, draw, doc_id) AS k
          FROM c JOIN t ON c.skey = t.skey)
        SELECT doc_id, size, source_size, target,
               (((start + k * step) // 16777216) - ((start + (k - 1) * step) // 16777216)) * size AS taken
        FROM r
    """,
    "op11_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
