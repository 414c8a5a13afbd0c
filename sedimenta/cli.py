"""Command line over folders of JSON-lines artifacts (seq long, type_id, source_url, body): python -m sedimenta.cli evaluate|refine|merge|index IN OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, indexing, refine_fold, refinement

SCHEMA = "seq long, type_id string, source_url string, body string"


def evaluate(rows: DataFrame) -> DataFrame:
    """The quality report by type."""
    return evaluation.quality_report(rows, "type_id")


def refine(rows: DataFrame) -> DataFrame:
    """What becomes of each artifact, type by type."""
    parts = [refinement.decisions(rows.where(F.col("type_id") == t), t).withColumn("type_id", F.lit(t)) for t in refinement.KEY_FIELDS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge(rows: DataFrame) -> DataFrame:
    """The knowledge that the artifacts leave, merged in order, by type and file name."""
    return refine_fold.file_names(refine_fold.refine(rows)[1])


def index(rows: DataFrame) -> DataFrame:
    """Chunks of all artifacts."""
    return indexing.chunks(rows.withColumn("stem", F.concat_ws("_", F.substring_index("type_id", ".", -1), "seq")))


COMMANDS = {"evaluate": evaluate, "refine": refine, "merge": merge, "index": index}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("source")
    parser.add_argument("target")
    said = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    COMMANDS[said.command](spark.read.schema(SCHEMA).json(said.source)).write.json(said.target)


if __name__ == "__main__":
    main()
