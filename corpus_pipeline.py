"""The corpus pipeline: five stages over documents, each one operator of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read back as the next
stage's documents. All but the last return the columns of documents, whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import exact_dedup, langid, minhash_dedup, mixing, packing
from strophe.llm.common import crc_mod, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: no letters, or no language with a third of the words' weight.

    Null and empty texts have no letters. Where no row gives a language to learn from, nothing can be told
    apart and all rows stay. Whole texts are read, however long; repeated rows are decided alike, an empty table stays
    empty. Columns that begin with __strophe are ours.
    """
    learn = crc_mod("doc_id", 4) != 2
    if not langid.can_learn(docs, learn=learn):
        return docs
    found = langid.detect_language(docs, learn=learn, carry=True)
    return found.where((F.col("__strophe_lang") != "und") & (F.col("__strophe_score") >= 1 / 3)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of equal texts.

    White space runs count as one space, null as the empty text; of rows that tie one stays; whole texts are
    compared, however long.
    """
    return exact_dedup.exact_dedup_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five-word shingles, similarity 0.8).

    Null texts and texts without words stay; whole texts count, however long; of rows of equal ids and texts one
    stays; an empty table stays empty. Columns that begin with __strophe are ours.
    """
    return minhash_dedup.near_dedup_rows(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents to the production tree's target weights; a document may come once for each epoch.

    Null languages and sources are leaves of their own; an empty text costs one token; ids, texts and the
    seed alone decide the draw; an empty table stays empty.
    """
    return mixing.mix(docs, rows=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into training sequences: one row for each piece with its bin.

    A text beyond the largest size makes several pieces; a null or empty one has its end token; equal rows are
    packed each; an empty table gives no rows; extra columns aren't read.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_dedup", near), ("mixing", mixture), ("packing", packed)]

#: Learned language scores and token counts aren't expressible in SQL; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs)
    return docs
