"""Artifacts as files of their own: whole JSON files in folders Y/m/d/H_M/domain/slug, each folder with side files.

A scan of a day lists that day's folder alone, one of a time opens only files whose path below the root holds it. Files
are read whole, several lines or one; those that are no JSON are rows of a table of their own. Spark packs files into
tasks by bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexing import type_by_name
from ..session import let_workers_import, path_exists, shared_folder, table

#: Files beside artifacts that a scan leaves out, fixed values.
SIDE_FILES = ["metadata.json", "parsed.json", "trace.json", "metrics.json", "errors.json"]
FILES = "path string, value string, modified timestamp"


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def write_files(rows: DataFrame, root: str) -> int:
    """Write rows(path, content) below root, each as a file under its name once it is whole; how many. A task that runs again writes the same files again."""
    let_workers_import(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(_local(root))
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                goal = f"{base}/{path}"
                system.create_dir(os.path.dirname(goal), recursive=True)
                draft = f"{goal}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(content.encode())
                system.move(draft, goal)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    kept = rows.select("path", F.col("content").cast("string").alias("content")).where("path is not null and content is not null")
    return kept.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def json_files(spark: SparkSession, root: str, date: str | None = None, time: str | None = None) -> DataFrame:
    """path (below the root), value and modified of the JSON files of a folder tree; date: Y-m-d or Y/m/d, time: H_M or H:M. None if the folder is missing."""
    root = _local(root).rstrip("/")
    start = f"{root}/{date.replace('-', '/')}" if date else root
    if not path_exists(spark, start):
        return spark.createDataFrame([], FILES)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(start, wholetext=True)
    if time:
        rows = rows.where(F.contains(F.expr(f"substring_index(_metadata.file_path, '{root}/', -1)"), F.lit(time.replace(":", "_"))))
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(F.substring_index(plain, f"{root}/", -1).alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def _name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def _is_json() -> Column:
    return F.try_parse_json("value").isNotNull() & (F.trim("value") != "")


def source_urls(files: DataFrame) -> DataFrame:
    """folder and source_url: `url` of the folder's metadata.json, or without a readable one `source_url`, else `url`, of its parsed.json; empty if they hold none."""
    side = files.where(_name().isin("metadata.json", "parsed.json") & _is_json() & F.startswith(F.ltrim("value"), F.lit("{")))
    url = F.when(_name() == "metadata.json", F.get_json_object("value", "$.url")).otherwise(F.coalesce(F.get_json_object("value", "$.source_url"), F.get_json_object("value", "$.url")))
    at = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))")
    return side.groupBy(at.alias("folder")).agg(F.min_by(F.coalesce(url, F.lit("")), _name()).alias("source_url"))


def scan_artifacts(spark: SparkSession, root: str, date: str | None = None, time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts (path, type_id by the file's name, source_url by the side files, body, created_at), and the files (path, value) that are no JSON.

    Side files and files whose name begins with no known type are neither.
    """
    files = json_files(spark, root, date, time)
    own = files.where(~_name().isin(SIDE_FILES))
    typed = own.withColumn("type_id", type_by_name(_name())).where(_is_json() & F.col("type_id").isNotNull())
    typed = typed.withColumn("folder", F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))"))
    named = typed.join(source_urls(files), "folder", "left")
    found = named.select("path", "type_id", F.coalesce("source_url", F.lit("")).alias("source_url"), F.col("value").alias("body"), F.col("modified").alias("created_at"))
    return found, own.where(~F.coalesce(_is_json(), F.lit(False))).select("path", "value")


def s02_artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events by day, hour and type written as artifacts with metadata beside them, those of error events cut short; a scan of all of them, and the files it put aside."""
    root = f"{shared_folder(spark)}/artifact-files-{uuid.uuid4().hex}"
    hours = table(spark, sf_dir, "events").where("ts is not null").groupBy(F.date_format("ts", "yyyy/MM/dd/HH_'00'").alias("at"), F.coalesce("event_type", F.lit("none")).alias("event_type")).agg(F.count("*").alias("n"))
    folder = F.concat_ws("/", "at", F.concat(F.lit("events."), "event_type"), F.lit("hour"))
    body = F.concat(F.lit('{\n "n": '), "n", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.lit("\n}")))
    write_files(hours.select(F.concat(folder, F.lit("/domain_events_hour.json")).alias("path"), body.alias("content")), root)
    write_files(hours.select(F.concat(folder, F.lit("/metadata.json")).alias("path"), F.concat(F.lit('{"url": "https://events.'), "event_type", F.lit('"}')).alias("content")), root)
    found, bad = scan_artifacts(spark, root)
    good = found.select("path", "type_id", "source_url", F.get_json_object("body", "$.n").cast("long").alias("n"))
    return good.unionByName(bad.select("path"), allowMissingColumns=True)


QUERIES = {"s02_artifact_files": s02_artifact_files}
ORACLES = {
    "s02_artifact_files": """WITH h AS (SELECT strftime(ts, '%Y/%m/%d/%H_00') AS hour_at, coalesce(event_type, 'none') AS e, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
      SELECT hour_at || '/events.' || e || '/hour/domain_events_hour.json' AS path, CASE WHEN e <> 'error' THEN 'domain' END AS type_id, CASE WHEN e <> 'error' THEN 'https://events.' || e END AS source_url, CASE WHEN e <> 'error' THEN n END AS n FROM h""",
}
