"""From raw documents to packed sequences: classify, deduplicate, decontaminate, replace personal data, pack.

Every stage works on all rows that the one before it kept, and carries all columns (extra ones too, whatever their names). What each gives for odd rows is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import packing, queries, rff, signature_tree, surrogates, templates
from orrery.llm.common import spill, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score below 0.5) go.

    Null, empty and blank texts are scored by the figures of an empty text, and very long ones by those of the whole. Each row is scored by its text alone: repeated rows and
    equal texts share one decision, and rows with a null doc_id get one too. Where no label can be learned from every row scores 0.5 and stays. An empty table stays empty.
    """
    return rff.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: the one with the least doc_id.

    Null, empty and blank texts are no one's copies and stay, as do rows with a null doc_id. Rows that repeat the least doc_id of their group all stay (they are one
    document); of equal texts under different ids the least stays. Very long texts are compared whole. An empty table stays empty.
    """
    return signature_tree.keep_first(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go.

    Null and empty texts hold none, and rows with a null doc_id stay. All rows of a doc_id that holds an item go. Very long texts are searched whole. Null and empty items
    are in no document; with an empty benchmark, or no documents, nothing changes.
    """
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates, equal ones equal surrogates in all documents.

    No row goes. Null texts stay null, empty ones empty, and texts without entities as they are; doc_ids (null or repeated) play no part; equal texts get equal
    results. Very long texts are read whole. An empty table stays empty.
    """
    return surrogates.replace(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed: a row per piece.

    Null and empty texts are the end token alone; repeated rows are packed each; a null doc_id is carried into its pieces; long documents are cut into several
    sequences. An empty table gives no rows. Columns other than doc_id and text end here.
    """
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("personal_data", replace_personal_data), ("packing", pack)]

#: Hashing, models and tokenizers aren't expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
