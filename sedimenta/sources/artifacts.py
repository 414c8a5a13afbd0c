"""Artifact tables, URL lists and search results as sources and sinks of plain Spark readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.urls import domain
from ..session import path_exists, shared_folder, table

#: Result lists and fields of search responses in the order in which they are looked for, fixed values.
RESULT_KEYS = ["organic_results", "web_results", "news_results", "related_questions"]
RESULT_FIELDS = {"url": ["link", "url", "displayed_link"], "title": ["title", "name"], "snippet": ["snippet", "description", "content"], "position": ["position", "rank"]}
#: The folder columns that a scan can be narrowed by.
FOLDERS = ["domain"]


def write_artifacts(rows: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines in a folder per domain; one task writes few folders, and a large domain is written by many tasks.

    The rows keep their partitions: no shuffle by domain, which may hold a third of all rows.
    """
    rows.write.mode(mode).partitionBy(*FOLDERS).json(path)


def scan_artifacts(spark: SparkSession, path: str, schema: StructType, broken: str = "_broken") -> DataFrame:
    """Artifacts of a folder tree; lines that are not JSON of the schema are left out, side files by their ending."""
    reader = spark.read.schema(schema.add(broken, StringType())).option("columnNameOfCorruptRecord", broken).option("pathGlobFilter", "*.json")
    return reader.json(path).where(F.col(broken).isNull()).drop(broken)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, without blank lines and those that start with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where("url <> '' and not startswith(url, '#')")


def search_items(responses: DataFrame, column: str = "raw", keys: list[str] = RESULT_KEYS, fields: dict[str, list[str]] = RESULT_FIELDS) -> DataFrame:
    """One row per result of JSON search responses: the first key that holds results counts, and of each field
    the first name that is not empty; a single object is a list of one; results without a URL are left out.
    Columns that are named as a field are replaced."""
    lists = [F.get_json_object(column, f"$.{k}") for k in keys]
    first = F.coalesce(*(F.when(~x.isin("", "[]", "{}", "0", "false"), x) for x in lists))
    listed = F.when(first.startswith("["), first).otherwise(F.concat(F.lit("["), first, F.lit("]")))
    items = responses.select("*", F.posexplode(F.from_json(listed, "array<string>")).alias("place", "item"))
    values = {f: F.coalesce(*(F.nullif(F.nullif(F.get_json_object("item", f"$.{n}"), F.lit("")), F.lit("0")) for n in names)) for f, names in fields.items()}
    values["position"] = values["position"].cast("int")
    return items.select(*(c for c in responses.columns if c not in fields), "place", *(c.alias(f) for f, c in values.items())).where("url is not null").drop(column)


def recovered_json(text: str):
    """JSON of a model's reply: the whole reply, else a fenced block, else what stands between the outer braces; null if none parses."""
    x = F.col(text)
    tries = [x, F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(x, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & (F.trim(t) != ""), F.btrim(t, F.lit(" \t\r\n"))) for t in tries))


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the Parquet table at path does not hold yet, the first of each key; one writer at a time."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(rows.columns)
    fresh.write.mode("append").parquet(path)


def k01_artifact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as artifacts by domain and scanned again; per domain how many and how long."""
    path = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html", domain().alias("domain"))
    write_artifacts(rows, path)
    schema = StructType().add("page_id", "long").add("url", "string").add("html", "string").add("domain", "string")
    back = scan_artifacts(spark, path, schema)
    return back.groupBy("domain").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"), F.max("page_id").alias("last_page"))


def k09_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then documents again with the benchmark's texts, appended to one table by content: each text once."""
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("id"))
    append_new(docs, path, "id")
    append_new(docs.unionByName(table(spark, sf_dir, "benchmark").select(F.md5("text").alias("id"))), path, "id")
    return spark.read.parquet(path)


def l05_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events put in words, a fence or nothing, as model replies come, and recovered."""
    reply = "case event_type when 'click' then props when 'error' then concat('Here it is:\\n```json\\n', props, '\\n```') else concat('Result ', props, ' done') end"
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(reply).alias("reply"))
    return rows.select("event_id", recovered_json("reply").alias("json"))


QUERIES = {q.__name__: q for q in (k01_artifact_table, k09_append, l05_recovered)}
ORACLES = {
    "k01_artifact_table": "SELECT coalesce(nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), 'unknown') AS domain, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars, max(page_id) AS last_page FROM pages GROUP BY 1",
    "k09_append": "SELECT md5(text) AS id FROM documents UNION SELECT md5(text) FROM benchmark",
    "l05_recovered": "SELECT event_id, props AS json FROM events",
}
