"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicweave.llm import (
    decontaminate,
    hamming,
    language,
    licenses,
    line_dedup,
    lm,
    merkle,
    pack_bfd,
    pack_genetic,
    sentencepieces,
    simhash,
    token_links,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_documents(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_documents(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bfd.digests(pack_bfd.stored_matrices(_table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.label_documents(_table(spark, sf_dir, "documents"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_genetic.pack_documents(_table(spark, sf_dir, "documents"))


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_simhash, op3_license_scan, op4_packed_matrices, op5_line_dedup, op6_warc_salvage,
        op7_genetic_packing, op8_hamming_search,
        op9_deleted_interpolation, op10_decontamination, op11_sentencepiece,
        op12_merkle_manifest, op13_token_links)}

ORACLES: dict[str, str] = {
    "op3_license_scan": licenses.oracle_sql(),
    "op6_warc_salvage": """
        WITH sized AS (
            SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages
        ), hexed AS (
            SELECT *, sha1(payload) AS h FROM sized
        )
        SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   (list_sum(list_transform(range(0, 5), lambda j: (instr('0123456789abcdef', substr(h, 1 + CAST((5 * i + j) // 4 AS INTEGER), 1)) - 1)
                        // CAST(2 ** (3 - (5 * i + j) % 4) AS BIGINT) % 2 * CAST(2 ** (4 - j) AS BIGINT)))) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM hexed
    """,
    "op8_hamming_search": """
        WITH pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.embedding, r.embedding),
                        lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
        )
        SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= 10
    """,
    "op12_merkle_manifest": merkle.oracle_sql(),
}
