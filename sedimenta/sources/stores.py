"""Stores that crawls, knowledge bases and indexes keep: scans with filters, writers, collections, listings and reports.

Each is a plain Spark table (JSON lines or Parquet) in folders by key; a query writes one in the shared folder
and reads it back, so that the row count of both sides is at stake. Folders that no file name or folder rule
lets through are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import CLEAN_SQL, clean_text
from ..functions.urls import NORMALIZED_SQL, domain, normalized
from ..operators.evaluation import _ITEMS_SQL, quality_report
from ..operators.structure import TYPE_COLLECTIONS
from ..session import path_exists, shared_folder, table, written
from .artifacts import append_new, read_url_list
from .pages import ARTIFACT_TYPES, CONCEPTS_SQL, artifacts
from .versions import VersionedTable, delete_folders

#: Files beside artifacts that scans leave out, and folders that an index leaves out: fixed values.
SIDE_FILES = ["metadata", "raw", "parsed", "trace", "candidates", "report"]
SIDE_FOLDERS = ["artifacts", "vector_store"]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scan_knowledge(spark: SparkSession, path: str, schema: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines of a folder tree as `schema` with file_path; side files and side folders are left out, and lines that are no objects; `folders`: columns of key=value folders."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", str(not folders).lower()).option("pathGlobFilter", "*.{json,json.gz}").json(path)
    rows = rows.withColumn("file_path", F.col("_metadata.file_path"))
    inside = F.split("file_path", "/")
    kept = ~F.exists(inside, lambda x: x.isin([*SIDE_FOLDERS, *(f"{f}.json{end}" for f in SIDE_FILES for end in ("", ".gz"))]))
    return rows.where(kept & F.col("_broken").isNull()).drop("_broken")


def write_by_type(rows: DataFrame, path: str) -> None:
    """JSON lines of rows(type_id, ...) in a folder for each type, packed, since bodies are much longer than the rows they are made of.

    A type that the engine knows is written by itself, which sorts nothing; other types are dealt out by Spark.
    """
    for name in ARTIFACT_TYPES:
        rows.where(F.col("type_id") == name).drop("type_id").write.option("compression", "gzip").json(f"{path}/type_id={name}")
    rows.where(~F.col("type_id").isin(*ARTIFACT_TYPES) | F.col("type_id").isNull()).write.mode("append").partitionBy("type_id").option("compression", "gzip").json(path)


def collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A vector collection: what its Parquet folder holds, or an empty table of its schema before the first write."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def s01_parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages (K04) written as JSON in folders by host and scanned with a pattern; values that are no objects are left out."""
    path = new_folder(spark, "parsed")
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"), clean_text().alias("clean_text"), domain().alias("host"))
    rows.write.json(f"{path}/pages")
    table(spark, sf_dir, "region").select(F.lit("[1]").alias("value")).write.mode("append").option("compression", "none").text(f"{path}/others")
    back = scan_knowledge(spark, f"{path}/*", "page_id long, source_url string, clean_text string, host string")
    return back.select("page_id", "source_url", F.length("clean_text").alias("chars"))


def s02_artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts in folders by day and hour: a scan of one day and of hours that begin with 1 reads those folders alone; unknown types are dropped."""
    path = new_folder(spark, "artifacts-by-time")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour"))
    rows.write.partitionBy("day", "hour").json(f"{path}/by-time")
    back = scan_knowledge(spark, f"{path}/by-time", "event_id long, event_type string, day string, hour string", ("day", "hour"))
    return back.where("day = '2024-01-15' and startswith(hour, '1') and event_type in ('click', 'view', 'purchase')").select("event_id", "event_type", "day", "hour")


def s03_load_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge by type in folders (K08), of which a load of one type reads its own folder alone."""
    path = new_folder(spark, "knowledge")
    write_by_type(artifacts(spark, sf_dir), path)
    back = scan_knowledge(spark, path, "seq long, body string, type_id string", ("type_id",)).where("type_id = 'domain'")
    return back.select("seq", "type_id", F.length("body").alias("chars"), (F.col("file_path") != "").alias("has_path"))


def s04_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge folder with artifacts and a vector store beside it: a scan of the tree sees the knowledge alone."""
    path = new_folder(spark, "tree")
    rows = table(spark, sf_dir, "pages").select("page_id")
    rows.where("page_id % 3 = 0").write.json(f"{path}/concepts")
    rows.where("page_id % 3 = 1").write.json(f"{path}/rules/deep")
    rows.where("page_id % 3 = 2").write.json(f"{path}/vector_store")
    back = scan_knowledge(spark, path, "page_id long")
    return back.select("page_id", F.regexp_extract("file_path", "/tree-[0-9a-f]+/([a-z]+)/", 1).alias("folder"))


def s05_evaluation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts written by type and scanned again for the quality report (A05: by type and in all)."""
    path = new_folder(spark, "corpus")
    artifacts(spark, sf_dir).where("type_id in ('domain', 'mappings', 'diagrams.dfd.templates')").write.partitionBy("type_id").json(path)
    back = scan_knowledge(spark, path, "seq long, body string, type_id string", ("type_id",))
    return quality_report(back, "type_id").select("type_id", "items", "missing_rate", "low_info_rate")


def s07_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in a collection for each label (K09), opened again; one that does not exist yet is empty (get or create)."""
    path = new_folder(spark, "collections")
    schema = "vec_id long, embedding array<float>, collection int"
    none = collection(spark, path, schema)
    none.unionByName(table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", "embedding", F.col("label").alias("collection"))).write.partitionBy("collection").parquet(path)
    return collection(spark, path, schema).groupBy("collection").agg(F.count("*").alias("vectors"), F.max("vec_id").alias("last"))


#: Columns of the caches of URLs and of contents.
URL_CACHE = "url_hash string, url string, normalized_url string, content_hash string, first_page long"
CONTENT_CACHE = "content_hash string, url string, first_page long"


def s06_cache_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches of URLs and contents: opened empty, filled with the pages, filled once more (which adds nothing), and read; rows and keys of each."""
    paths = {k: new_folder(spark, f"{k}-cache") for k in ("url", "content")}
    opened = {k: collection(spark, paths[k], schema) for k, schema in (("url", URL_CACHE), ("content", CONTENT_CACHE))}
    pages = table(spark, sf_dir, "pages").select("page_id", "url", normalized().alias("normalized_url"), F.md5(clean_text()).alias("content_hash"))
    first = lambda key: pages.where(f"{key} is not null").groupBy(key).agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("first_page"))
    urls = pages.where("normalized_url is not null").groupBy("normalized_url").agg(F.min_by("url", "page_id").alias("url"), F.min_by("content_hash", "page_id").alias("content_hash"), F.min("page_id").alias("first_page"))
    urls = urls.select(F.sha2("normalized_url", 256).alias("url_hash"), "url", "normalized_url", "content_hash", "first_page")
    for _ in range(2):
        append_new(opened["url"].unionByName(urls), paths["url"], "url_hash")
        append_new(opened["content"].unionByName(first("content_hash").select("content_hash", "url", "first_page")), paths["content"], "content_hash")
    count = lambda k, schema, key: collection(spark, paths[k], schema).agg(F.lit(k).alias("cache"), F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.max("first_page").alias("last"))
    return count("url", URL_CACHE, "url_hash").unionByName(count("content", CONTENT_CACHE, "content_hash"))


def k10_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections after one of them is cleared: its folder is replaced by an empty one, the others stay."""
    path = new_folder(spark, "cleared")
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", F.col("label").alias("collection"))
    rows.write.partitionBy("collection").parquet(path)
    rows.limit(0).select("vec_id").write.mode("overwrite").parquet(f"{path}/collection=3")
    return spark.read.schema("vec_id long, collection int").parquet(path).groupBy("collection").agg(F.count("*").alias("vectors"))


def s09_url_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL index: a key of 12 digits for each URL with its first page, written and looked up for every page (S06 as a table, no index needed)."""
    path = new_folder(spark, "url-index")
    key = F.expr("substring(md5(lower(rtrim('/', url))), 1, 12)")
    pages = table(spark, sf_dir, "pages").select("page_id", key.alias("key"))
    pages.groupBy("key").agg(F.min("page_id").alias("first_page_id")).write.parquet(path)
    return pages.join(spark.read.schema("key string, first_page_id long").parquet(path), "key", "left").select("page_id", "key", "first_page_id")


def s10_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages as a text file with comments and blank lines, read as a list."""
    path = new_folder(spark, "url-list")
    table(spark, sf_dir, "pages").where("url is not null").select(F.explode(F.array(F.lit("# comment"), F.lit("  "), F.concat(F.lit(" "), "url"))).alias("value")).write.text(path)
    return read_url_list(spark, path)


def s16_saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest saved events with their rank (O07, O08): a top-k report."""
    newest = table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return newest.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("saved"))


def k07_category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each category of artifacts and a summary of each: items and the fields that its bodies have."""
    path = new_folder(spark, "categories")
    rows = artifacts(spark, sf_dir).where("type_id in ('domain', 'schema', 'theory')")
    rows.write.partitionBy("type_id").json(path)
    back = scan_knowledge(spark, path, "seq long, body string, type_id string", ("type_id",))
    fields = back.select("type_id", "seq", F.explode(F.expr("json_object_keys(body)")).alias("field"))
    return fields.groupBy("type_id").agg(F.count_distinct("seq").alias("files"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def k13_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of one row as a JSON file, read back."""
    path = new_folder(spark, "report")
    docs = table(spark, sf_dir, "documents")
    docs.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources")).coalesce(1).write.json(path)
    return spark.read.schema("docs long, chars long, sources long").json(path)


def k12_page_folders(spark: SparkSession, sf_dir: str, days: int = 10) -> DataFrame:
    """Saved events in folders by day, of which those older than ten days from the newest are deleted: the folders that stay."""
    path = new_folder(spark, "saved")
    events = table(spark, sf_dir, "events").where("ts is not null")
    events.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day")).write.partitionBy("day").parquet(path)
    newest = events.agg(F.date_format(F.date_sub(F.max(F.to_date("ts")), days), "yyyyMMdd")).first()[0]
    delete_folders(spark, path, lambda name: name.startswith("day=") and newest is not None and name[4:] < newest)
    return spark.read.schema("event_id long, day string").parquet(path).groupBy("day").agg(F.count("*").alias("events"))


def t03_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement of one day of artifacts: events in folders by day, of which one is read; counts by type."""
    path = new_folder(spark, "days")
    table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).write.partitionBy("day").json(path)
    back = spark.read.schema("event_id long, event_type string, day string").json(path).where("day = '2024-01-15'")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


#: Repeated bodies whose keys are sent to all tasks; with more of them all bodies are exchanged.
REPEATED = 200_000
REFINED = "type_id string, slug string, body string, sources long, saved_to string"


def refine_run(found: DataFrame, saved: VersionedTable, dry_run: bool = False) -> DataFrame:
    """Save the distinct bodies of artifacts(type_id, seq, body) with how many artifacts they come from, beside those that were saved before, whose sources add up.

    Returns the refined rows; a dry run computes them and publishes nothing. Types without a collection are saved with none.
    """
    where = F.create_map(*(F.lit(x) for pair in TYPE_COLLECTIONS.items() for x in pair))
    new = found.select("type_id", F.md5("body").alias("slug"), "body", F.lit(1).cast("long").alias("sources"), where[F.col("type_id")].alias("saved_to"))

    def merged(old: DataFrame) -> DataFrame:
        """Only bodies that come more than once are exchanged, the others are written where they are read: bodies are much longer than the rows they are made of."""
        both = old.unionByName(new).select(*(c.strip().split()[0] for c in REFINED.split(",")))
        once = lambda rows: rows.groupBy("type_id", "slug").agg(F.first("body").alias("body"), F.sum("sources").alias("sources"), F.first("saved_to").alias("saved_to")).select(both.columns)
        repeated = written(both.groupBy("type_id", "slug").agg(F.count("*").alias("n")).where("n > 1").select(F.col("type_id").alias("_type"), F.col("slug").alias("_slug"), F.lit(True).alias("_again")), "repeated")
        if repeated.count() > REPEATED:
            return once(both)
        marked = both.join(F.broadcast(repeated), F.col("type_id").eqNullSafe(F.col("_type")) & F.col("slug").eqNullSafe(F.col("_slug")), "left")
        return marked.where("_again is null").select(both.columns).unionByName(once(marked.where("_again").select(both.columns)))

    if dry_run:
        return merged(saved.read())
    return saved.read(saved.update(merged))


def r06_refine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refinement run that is saved and read back: artifacts by type, each distinct body once, and where they are saved."""
    saved = refine_run(artifacts(spark, sf_dir), VersionedTable(spark, new_folder(spark, "refined"), REFINED))
    return saved.groupBy("type_id").agg(F.sum("sources").alias("found"), F.count("slug").alias("distinct"), F.first("saved_to").alias("saved_to")).select("type_id", "found", "distinct", "saved_to")


QUERIES = {
    q.__name__: q
    for q in (s01_parsed_pages, s02_artifact_scan, s03_load_type, s04_index_scan, s05_evaluation_scan, s06_cache_tables, s07_collections, s09_url_index, s10_url_list, s16_saved_pages, k07_category_files, k10_clear, k12_page_folders, k13_report, t03_incremental, r06_refine_run)
}
ORACLES = {
    "s01_parsed_pages": f"SELECT page_id, url AS source_url, CAST(length({CLEAN_SQL}) AS INTEGER) AS chars FROM pages",
    "s02_artifact_scan": "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND hour(ts) BETWEEN 10 AND 19 AND event_type IN ('click', 'view', 'purchase')",
    "s03_load_type": """SELECT c_custkey AS seq, 'domain' AS type_id, CAST(length('{"domain_id":"d_' || c_custkey || '","name":"' || c_name || '","description":"' || c_mktsegment || '","terms":[{"term":"' || c_mktsegment || '"}],"rules":[{"rule_id":"r_' || c_nationkey || '","description":""}],"models":[{"entity":"' || c_name
      || '","attributes":["' || c_nationkey || '"]}]}') AS INTEGER) AS chars, true AS has_path FROM customer""",
    "s04_index_scan": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'concepts' ELSE 'rules' END AS folder FROM pages WHERE page_id % 3 < 2",
    "s05_evaluation_scan": _ITEMS_SQL + " SELECT t AS type_id, count(*) AS items, round(sum(missing) / sum(required), 4) AS missing_rate, round(sum(low_info) / sum(text_fields), 4) AS low_info_rate FROM e WHERE t IN ('domain', 'mappings', 'diagrams.dfd.templates') GROUP BY 1",
    "s06_cache_tables": NORMALIZED_SQL + f""", u AS (SELECT normalized_url, min(page_id) AS f FROM n WHERE normalized_url IS NOT NULL GROUP BY 1), t AS (SELECT md5({CLEAN_SQL}) AS h, min(page_id) AS f FROM pages GROUP BY 1)
      SELECT 'url' AS cache, count(*) AS rows, count(*) AS keys, max(f) AS last FROM u UNION ALL SELECT 'content', count(*), count(*), max(f) FROM t""",
    "s07_collections": "SELECT label AS collection, count(*) AS vectors, max(vec_id) AS last FROM embeddings WHERE label IS NOT NULL GROUP BY 1",
    "k10_clear": "SELECT label AS collection, count(*) AS vectors FROM embeddings WHERE label IS NOT NULL AND label <> 3 GROUP BY 1",
    "s09_url_index": "SELECT page_id, md5(lower(rtrim(url, '/')))[1:12] AS key, min(page_id) OVER (PARTITION BY md5(lower(rtrim(url, '/')))[1:12]) AS first_page_id FROM pages",
    "s10_url_list": "SELECT trim(url) AS url FROM pages WHERE url IS NOT NULL",
    "s16_saved_pages": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "k07_category_files": """SELECT 'domain' AS type_id, count(*) AS files, 'description,domain_id,models,name,rules,terms' AS fields FROM customer UNION ALL SELECT 'schema', count(DISTINCT doc_id), 'title' FROM labels UNION ALL SELECT 'theory', count(DISTINCT doc_id), 'concepts,principles' FROM documents""",
    "k13_report": "SELECT count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents",
    "k12_page_folders": "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS events FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - INTERVAL 10 DAYS GROUP BY 1",
    "t03_incremental": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1",
    "r06_refine_run": "WITH " + CONCEPTS_SQL + """ SELECT 'diagrams.dfd.concepts' AS type_id, count(*) AS found, count(*) AS distinct, 'se_kb_dfd_concepts' AS saved_to FROM a
      UNION ALL SELECT 'diagrams.dfd.rules', count(*), count(DISTINCT hash(turn, role, text)), 'se_kb_dfd_rules' FROM conversations UNION ALL SELECT 'diagrams.dfd.examples', count(*), count(DISTINCT hash(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)), 'se_kb_dfd_examples' FROM lineitem
      UNION ALL SELECT 'diagrams.dfd.levels', count(*), count(*), 'se_kb_dfd_levels' FROM supplier UNION ALL SELECT 'diagrams.dfd.templates', count(*), count(*), 'se_kb_dfd_templates' FROM part UNION ALL SELECT 'diagrams.dfd.validation', count(*), count(*), 'se_kb_dfd_rules' FROM pages
      UNION ALL SELECT 'theory', count(*), count(*), 'se_kb_theory' FROM documents UNION ALL SELECT 'domain', count(*), count(*), 'se_kb_domain' FROM customer UNION ALL SELECT 'mappings', count(*), count(*), 'se_kb_theory' FROM nation UNION ALL SELECT 'schema', count(*), count(DISTINCT doc_id), 'se_kb_theory' FROM labels""",
}
