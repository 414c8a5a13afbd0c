"""Keyword signals, sentence candidates, text predicates, summaries and event windows as column expressions.

A null text is no HTML and low in information, and has null counts of cues and lines; events without a time are in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .corpus import LOW_INFO

#: Cue words of each knowledge type, fixed values; case counts.
SIGNALS = {
    "dfd": ["数据流", "处理", "流程", "外部实体", "数据存储", "data flow", "process", "DFD"],
    "concepts": ["概念", "定义", "是指", "表示", "definition", "concept"],
    "rules": ["规则", "必须", "应该", "限制", "约束", "rule"],
}
#: Cue words of rule sentences and what marks a URL line, fixed values.
RULE_CUES = ["规则", "必须", "应该", "限制", "约束", "如果", "当", "则", "rule"]
URL_STARTS = ["http://", "https://", "ftp://", "www."]
URL_MARKS = ["http://", "https://", "www.", ".com", ".net", ".org", ".cn"]
TAG_OR_ENTITY = "<[^>]+>|&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;|&#x[0-9a-fA-F]+;"
_BLANKS = " \t\n\r\f\x0b"
_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def a01_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"))


def a06_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the whole corpus; zeros and nulls for an empty one."""
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.sum(F.char_length("text")).alias("chars"), F.max(F.char_length("text")).alias("longest"))


def keyword_signals(rows: DataFrame) -> DataFrame:
    """rows(text) with the occurrences of each type's cues and the types that have any, most first."""
    count = {k: sum((F.regexp_count("text", F.lit(w)) for w in words), F.lit(0)).cast("long") for k, words in SIGNALS.items()}
    found = ", ".join(f"struct(-{k} as n, {i} as i, '{k}' as k)" for i, k in enumerate(SIGNALS))
    types = F.expr(f"coalesce(nullif(array_join(transform(array_sort(filter(array({found}), x -> x.n < 0)), x -> x.k), ','), ''), 'concepts,rules')")
    return rows.withColumns(count).withColumn("types", types)


def a09_keyword_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each type's cues, and the types that have any, most first."""
    return keyword_signals(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def sentence_candidates(rows: DataFrame) -> DataFrame:
    """rows(text) with the numbers of sentences of more than 10 characters that hold a concept or rule cue, and the scores they give."""
    blanks = r" \\t\\n\\r\\f\\x0B"
    sentences = rf"filter(transform(split(text, '[。.!?\\n]'), s -> regexp_replace(s, '^[{blanks}]+|[{blanks}]+$', '')), s -> length(s) > 10)"
    n = {f"{k}_candidates": F.expr(f"size(filter({sentences}, s -> s rlike '{'|'.join(cues)}'))") for k, cues in (("concept", SIGNALS["concepts"]), ("rule", RULE_CUES))}
    return rows.withColumns(n).withColumns({f"{k}_score": F.least(F.lit(1.0), F.col(f"{k}_candidates") / per) for k, per in (("concept", 5.0), ("rule", 6.0))})


def e15_sentence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of more than 10 characters with a concept or rule cue, and the scores they give."""
    return sentence_candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def h08_is_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").rlike(TAG_OR_ENTITY), F.lit(False)).alias("is_html"))


def h27_outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings as indented lines between two markers; an empty text where there are none."""
    line = "concat(repeat('  ', cast(substring(h, 3, 1) as int) - 1), repeat('#', cast(substring(h, 3, 1) as int)), ' ', trim(regexp_replace(h, '<[^>]+>', '')))"
    lines = rf"transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>', 0), h -> {line})"
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(lines).alias("lines"))
    return rows.select("page_id", F.expr("if(size(lines) > 0, concat('=== 文档结构 ===\\n', array_join(lines, '\\n'), '\\n=== 正文内容 ==='), '')").alias("outline"))


def h33_strip_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without Markdown images, with two line ends in a row at most."""
    bare = F.regexp_replace("text", r"!\[[^\]]*\]\([^)]+\)", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.btrim(F.regexp_replace(bare, "\n{3,}", "\n\n"), F.lit(_BLANKS)).alias("markdown"))


def p13_low_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return docs.select("doc_id", F.expr(LOW_INFO.format(contains="contains")).alias("low_info"))


def p17_url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are little more than URLs."""
    starts = " or ".join(f"startswith(s, '{x}')" for x in URL_STARTS)
    marks = " + ".join(f"if(contains(s, '{x}'), 1, 0)" for x in URL_MARKS)
    url_line = f"(({starts}) and length(s) < 200 and length(s) - length(replace(s, ' ', '')) < 3) or (({marks}) >= 2 and length(s) < 100)"
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(rf"size(filter(transform(split(text, '\\n'), s -> trim(s)), s -> {url_line}))").alias("url_lines"))


def w05_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, ties by event_id; a maximum, which is taken before the shuffle too."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type")


def x03_url_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs of the page table and of the texts."""
    in_texts = table(spark, sf_dir, "documents").select(F.explode(F.expr(r"""regexp_extract_all(text, 'https?://[^ \\t\\r\\n<>"]+', 0)""")).alias("url"))
    return table(spark, sf_dir, "pages").select("url").unionByName(in_texts).distinct()


def t06_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def t06_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than two hours apart."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", "largest")


def u08_content_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page title in a-z, 0-9 and single _, of 30 characters at most; null if under 5 are left."""
    title = F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    slug = F.btrim(F.regexp_replace(F.regexp_replace(title, "[^a-z0-9_]", "_"), "_+", "_"), F.lit("_"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.length(slug) >= 5, F.substring(slug, 1, 30)).alias("slug"))


def a22_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label and in all; the total's row has is_total."""
    counts = table(spark, sf_dir, "embeddings").rollup("label").agg(F.count("*").alias("vectors"), F.grouping("label").alias("g"))
    return counts.select("label", "vectors", (F.col("g") == 1).alias("is_total"))


def s18_date_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def k12_retention(spark: SparkSession, sf_dir: str, days: int = 15) -> DataFrame:
    """Events of the last `days` days, counted back from the newest one."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))  # one row
    kept = events.join(F.broadcast(newest), F.expr(f"ts >= newest - interval {days} days"))
    return kept.select("event_id", "user_id", "event_type")


_COUNTS_SQL = ", ".join(
    "CAST(" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words) + f" AS BIGINT) AS {k}" for k, words in SIGNALS.items()
)
_FOUND_SQL = ", ".join(f"{{'n': -{k}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(SIGNALS))
_SENTENCES_SQL = rf"list_filter(list_transform(regexp_split_to_array(text, '[。.!?\n]'), lambda s: trim(s, {_BLANKS_SQL})), lambda s: length(s) > 10)"
_URL_LINE_SQL = (
    "((" + " OR ".join(f"starts_with(s, '{x}')" for x in URL_STARTS) + ") AND length(s) < 200 AND length(s) - length(replace(s, ' ', '')) < 3) OR (("
    + " + ".join(f"CASE WHEN contains(s, '{x}') THEN 1 ELSE 0 END" for x in URL_MARKS) + ") >= 2 AND length(s) < 100)"
)
_BUCKET_SQL = "time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01')"
QUERIES = {
    q.__name__: q
    for q in (a01_type_counts, a06_corpus_summary, a09_keyword_signals, e15_sentence_candidates, h08_is_html, h27_outline_text, h33_strip_images, p13_low_info,
              p17_url_lines, w05_keep_last, x03_url_union, t06_sliding_windows, t06_session_windows,
              u08_content_slug, a22_store_stats, s18_date_listing, k12_retention)
}
ORACLES = {
    "a01_type_counts": "SELECT source, count(*) AS docs FROM documents GROUP BY source",
    "a06_corpus_summary": "SELECT count(*) AS docs, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INTEGER) AS longest FROM documents",
    "a09_keyword_signals": f"""WITH c AS (SELECT doc_id, {_COUNTS_SQL} FROM documents)
      SELECT *, coalesce(nullif(array_to_string(list_transform(list_sort(list_filter([{_FOUND_SQL}], lambda x: x.n < 0)), lambda x: x.k), ','), ''), 'concepts,rules') AS types FROM c""",
    "e15_sentence_candidates": f"""WITH s AS (SELECT doc_id, {_SENTENCES_SQL} AS s FROM documents), n AS (SELECT doc_id,
      CAST(len(list_filter(s, lambda x: regexp_matches(x, '{"|".join(SIGNALS["concepts"])}'))) AS INTEGER) AS concept_candidates,
      CAST(len(list_filter(s, lambda x: regexp_matches(x, '{"|".join(RULE_CUES)}'))) AS INTEGER) AS rule_candidates FROM s)
      SELECT *, least(1.0::DOUBLE, concept_candidates / 5.0::DOUBLE) AS concept_score, least(1.0::DOUBLE, rule_candidates / 6.0::DOUBLE) AS rule_score FROM n""",
    "h08_is_html": f"SELECT doc_id, coalesce(regexp_matches(text, '{TAG_OR_ENTITY}'), false) AS is_html FROM documents",
    "h27_outline_text": r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>'),
        lambda h: repeat('  ', CAST(h[3:3] AS INTEGER) - 1) || repeat('#', CAST(h[3:3] AS INTEGER)) || ' ' || trim(regexp_replace(h, '<[^>]+>', '', 'g'))) AS lines FROM pages)
      SELECT page_id, CASE WHEN len(lines) > 0 THEN '=== 文档结构 ===' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || '=== 正文内容 ===' ELSE '' END AS outline FROM l""",
    "h33_strip_images": rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS_SQL}) AS markdown FROM documents",
    "p13_low_info": f"SELECT doc_id, {LOW_INFO.format(contains='contains')} AS low_info FROM (SELECT doc_id, text AS t FROM documents)",
    "p17_url_lines": f"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: {_URL_LINE_SQL})) AS INTEGER) AS url_lines FROM documents",
    "w05_keep_last": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "x03_url_union": r"""SELECT url FROM pages UNION SELECT unnest(regexp_extract_all(text, 'https?://[^ \t\r\n<>"]+')) FROM documents""",
    "t06_sliding_windows": f"""WITH w AS (SELECT {_BUCKET_SQL} AS b, event_type FROM events UNION ALL SELECT {_BUCKET_SQL} - INTERVAL 3 HOURS, event_type FROM events)
      SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
    "t06_session_windows": """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
      s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM p)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, max(value) AS largest FROM s GROUP BY user_id, session""",
    "u08_content_slug": r"""WITH s AS (SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM pages)
      SELECT page_id, CASE WHEN length(s) >= 5 THEN s[1:30] END AS slug FROM s""",
    "a22_store_stats": "SELECT label, count(*) AS vectors, grouping(label) = 1 AS is_total FROM embeddings GROUP BY ROLLUP (label)",
    "s18_date_listing": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "k12_retention": "SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 DAYS",
}
