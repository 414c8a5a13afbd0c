"""What the training-data operators share: shared-folder tables and size-bounded block counts."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def scanned(docs: DataFrame) -> DataFrame:
    """docs as they are if they are read from files row by row, which gives the same rows in the same order whenever a
    lost task is run again; else (after a shuffle, a Python step or from memory) as a table of the shared folder.

    What numbers rows by their place in the scan needs this.
    """
    steps = {re.match(r"[\s:+*()\d-]*([A-Za-z]*)", line)[1] for line in docs._jdf.queryExecution().executedPlan().toString().strip().splitlines()}
    return docs if "FileScan" in steps and steps <= {"FileScan", "ColumnarToRow", "Project", "Filter"} else cut_lineage(docs, "scanned")


def row_key():
    """A number for each scanned row, the same whenever the same input split is scanned again.

    It spreads rows that share every value, which no hash of the values can do.
    """
    return F.xxhash64(F.monotonically_increasing_id())


def in_blocks(docs: DataFrame, block_bytes: int, *columns: str) -> tuple[DataFrame, int]:
    """doc_id, text, row (a number of its own) and `columns` of documents, hashed to blocks of about block_bytes of text; and how many blocks.

    Repeated rows, null ids and a repeated id spread over all blocks alike.
    """
    docs = scanned(docs.select("doc_id", "text", *columns))
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    rows = docs.select(F.col("doc_id").cast("long"), "text", *columns, F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(row), {blocks}) as int)")), blocks


def in_runs(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """doc_id and text of documents in blocks of consecutive scanned rows, of about block_bytes of text; and how many blocks.

    A pass over the scan sees whole blocks without a shuffle.
    """
    docs = scanned(docs.select("doc_id", "text"))
    total, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    run = max(1, int(block_bytes * n / max(total or 0, 1)))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    # a row number is its partition above 33 bits and its place in the partition below
    block = F.expr(f"shiftleft(shiftright(row, 33), 33) + cast((row & {(1 << 33) - 1}L) div {run} as bigint)")
    return rows.withColumn("block", block).drop("row"), max(1, -(-(total or 0) // block_bytes))
