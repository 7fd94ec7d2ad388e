"""From raw documents to packed training sequences: language ID, near and exact dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents, but for the last,
which returns packed pieces. It is written as Parquet and read again as the next one's docs.

Every stage takes rows with null or repeated ids as documents of their own, whole texts of any length, further columns
of any name (all but the last stage keep them), and an empty table (which it returns empty). A text that is null or has
no letter goes in the first stage; the later ones, given one, treat it as empty. Of equal rows the first in order of
(id, text) is the one that stays, null ids last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, packing, simhash, suffixes
from lodestone.llm.common import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, learned from this input's labels: documents that it rejects go. Null labels take the prediction.

    Without any label, documents whose text has a letter stay. Equal scores go to the language that sorts first.
    """
    return langid.keep_identified(docs, langid.train(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked documents the one with the least id stays.

    Empty and null texts have one fingerprint and are one group.
    """
    return simhash.keep_representatives(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: bytes of repeated 100-byte strings go, and documents of which nothing is left.

    A character that lost a byte goes whole; texts under 100 bytes, empty and null ones stay as they are.
    """
    return suffixes.dedup_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often as the mix takes them whole, each time a row, and one with the words of the blocks
    that are drawn besides.

    Documents without words are not taken. A null source is a source like any other.
    """
    return mixing.mix_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row a piece of at most 2048 tokens, with its sequence and place; an empty text is its end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The stages' models and sweeps can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
