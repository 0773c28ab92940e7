"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import packing, quality_llr, quotes, rff, shards, signature_tree, substrings, surrogates, templates, warc
from .common import table


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.score_documents(table(spark, sf_dir, "documents"), quality_llr.trusted(table(spark, sf_dir, "labels")))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.sql_columns(warc.round_trip(spark, table(spark, sf_dir, "pages")))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sql_columns(shards.shard_documents(table(spark, sf_dir, "documents")))


def op6_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.group(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_llr, op2_surrogates, op3_warc_dictionary, op4_quotation_links, op5_histogram_shards, op6_signature_tree, op7_packing,
        op8_rff_quality, op9_substring_dedup, op10_templates,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quotation_links": quotes.SQL,
        "op10_templates": templates.SQL,
        "op3_warc_dictionary": """
            WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
                 k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
            SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
                   CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
            FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000""",
    }
