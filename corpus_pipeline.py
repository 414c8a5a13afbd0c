"""A corpus pipeline of four stages: quality classifier, MinHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import minhash, packing, quality, queries, suffix_dedup
from sedimenta.llm.common import cut_lineage
from sedimenta.session import let_workers_import, table

#: SQL cannot express learned scores or signatures; the tests hold the rows against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality model, learned from the labels of these documents, does not reject.

    Null and empty texts are scored like any other; repeated rows stay or go together.
    """
    let_workers_import(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, cut=0.3).where("predicted = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the smallest doc_id.

    Documents without words and rows with null doc_ids stay; rows that share a doc_id are one document.
    """
    let_workers_import(spark)
    gone = minhash.near_duplicates(docs, threshold=0.8, size=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that occur earlier; cuts keep characters whole, n_chars follows.

    A document that is all repeats stays with an empty text; a null text becomes empty.
    """
    let_workers_import(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = suffix_dedup.remove_repeats(docs, length=100, columns=rest, with_text=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row per piece with its ids.

    Null and empty texts give the end id alone; repeated rows and null doc_ids are packed each for itself. Groups are
    drawn by the place of rows in the stage's table, so that two runs may cut documents otherwise.
    """
    let_workers_import(spark)
    return packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
