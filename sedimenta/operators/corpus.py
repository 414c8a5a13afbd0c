"""Content identity, corpus reports and grouped rates over documents, labels and events.

A null text has a null hash and fingerprint, equals no other, is no valid text and low in information; null keys of a
report are a group of their own; events without a time are in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: Placeholder texts that make an item low in information, fixed values.
PLACEHOLDERS = ["暂无", "未知", "未提供", "无", "空", "n/a", "none", "null"]
LOW_INFO = " OR ".join(["t IS NULL", "length(trim(t)) < 12", *(f"{{contains}}(lower(t), '{p}')" for p in PLACEHOLDERS)])


def content_hash(text: str = "text"):
    """sha256 of a text without punctuation and with single spaces; letter case counts."""
    spaced = F.regexp_replace(F.trim(F.col(text)), r"[ \t\n\r\f\x0B]+", " ")
    return F.sha2(F.regexp_replace(spaced, r"[^\p{L}\p{N}_ ]", ""), 256)


_HASH_SQL = r"sha256(regexp_replace(regexp_replace(trim(text), '[ \t\n\r\f\x0B]+', ' ', 'g'), '[^\p{L}\p{N}_ ]', '', 'g'))"


def d02_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash().alias("content_hash"))


def d03_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 words of three letters or more, in lower case."""
    words = r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}', 0)"
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"array_join(slice({words}, 1, 200), ' ')").alias("fingerprint"))


def d04_exact_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first one of equal content; a null text equals none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash().alias("h"))
    first = docs.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"))
    rows = docs.join(first, "h", "left").select("doc_id", F.coalesce("first_doc_id", "doc_id").alias("first_doc_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    return rows.withColumn("is_duplicate", F.col("doc_id") != F.col("first_doc_id"))


def a04_quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-information, too-short and duplicate rates by language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("t"))
    n = F.count("*")
    return docs.groupBy("lang").agg(
        n.alias("items"),
        F.round(F.count_if(F.expr(LOW_INFO.format(contains="contains"))) / n, 4).alias("low_info_rate"),
        F.round(F.count_if(F.expr("length(t) < 30")) / n, 4).alias("indexable_fail_rate"),
        F.round((n - F.count_distinct(F.md5("t"))) / n, 4).alias("duplicate_rate"),
    )


def a05_grain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts for each language and source, each language and the corpus in one aggregation."""
    docs = table(spark, sf_dir, "documents")
    return docs.rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def a08_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang").join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("labelled"), F.round(F.avg("quality"), 4).alias("quality_rate"), F.round(F.avg("toxic"), 4).alias("toxic_rate"))


def a23_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", reliability("text").alias("reliability"))


def reliability(text: str):
    """0.5, more for length and for each group of cue words, at most 1; 0.5 for null."""
    length = f"case when length({text}) > 1000 then 2 when length({text}) > 500 then 1 else 0 end"
    cues = " + ".join(f"if(coalesce({text} rlike '{c}', false), 1, 0)" for c in CUES)
    return F.expr(f"round(least(1.0D, 0.5D + ({length} + {cues}) / 10.0D), 2)")


#: Groups of words that show structure, fixed values.
CUES = ["步骤|流程", "示例|例子", "规则|约束"]


def valid_text(text: str):
    """Whether a text of 5 characters or more holds no NUL, ÿ or þ, and a letter or for the half printable characters; false for null."""
    seen = rf"length(regexp_replace({text}, r'[^\x09-\x0D\x20-\x7E\x{{80}}-\x{{10FFFF}}]', '')) * 2 >= length({text})"
    return F.expr(rf"coalesce(length({text}) >= 5 and not {text} rlike r'[\x00ÿþ]' and ({text} rlike r'\p{{L}}' or {seen}), false)")


def p15_valid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", valid_text("text").alias("valid"))


def o01_longest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source, ties by doc_id."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return docs.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def p07_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as Markdown."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.expr("array_join(transform(t, x -> concat('## ', x.role, '\\n', x.text)), '\\n\\n')").alias("markdown"))


def w01_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sentences of conversations, after dropping short ones."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.expr(r"filter(transform(split(text, '[.!?\\n]'), s -> trim(s)), s -> length(s) > 15)")).alias("pos", "sentence"))
    return rows.select("conv_id", "turn", F.format_string("concept_%03d", F.col("pos") + 1).alias("id"), "sentence")


def w07_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that fit a budget of 4000 characters, from the first on."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.char_length("text")).over(w).alias("used"))
    return rows.where("used <= 4000")


def p02_dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def t01_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in tumbling windows of six hours."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


QUERIES = {
    q.__name__: q
    for q in (d02_content_hash, d03_fingerprint, d04_exact_content, a04_quality_rates, a05_grain_report, a08_label_rates, a23_reliability, p15_valid_text,
              o01_longest_per_source, p07_transcript, w01_sequential_ids, w07_context_budget, p02_dotted_path, t01_event_windows)
}
RELIABLE_SQL = """round(least(1.0::DOUBLE, 0.5::DOUBLE + (CASE WHEN length(text) > 1000 THEN 2 WHEN length(text) > 500 THEN 1 ELSE 0 END + CASE WHEN contains(text, '步骤') OR contains(text, '流程') THEN 1 ELSE 0 END
  + CASE WHEN contains(text, '示例') OR contains(text, '例子') THEN 1 ELSE 0 END + CASE WHEN contains(text, '规则') OR contains(text, '约束') THEN 1 ELSE 0 END) / 10.0::DOUBLE), 2)"""
ORACLES = {
    "d02_content_hash": f"SELECT doc_id, {_HASH_SQL} AS content_hash FROM documents",
    "d03_fingerprint": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')[1:200], ' ') AS fingerprint FROM documents",
    "d04_exact_content": f"""WITH d AS (SELECT doc_id, {_HASH_SQL} AS h FROM documents), f AS (SELECT *, CASE WHEN h IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY h) END AS first_doc_id, CASE WHEN h IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY h) END AS copies FROM d)
      SELECT doc_id, first_doc_id, copies, doc_id <> first_doc_id AS is_duplicate FROM f""",
    "a04_quality_rates": f"""SELECT lang, count(*) AS items, round(count(*) FILTER ({LOW_INFO.format(contains="contains")}) / count(*), 4) AS low_info_rate,
      round(count(*) FILTER (length(t) < 30) / count(*), 4) AS indexable_fail_rate, round((count(*) - count(DISTINCT t)) / count(*), 4) AS duplicate_rate FROM (SELECT lang, text AS t FROM documents) GROUP BY lang""",
    "a05_grain_report": "SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY ROLLUP (lang, source)",
    "a08_label_rates": "SELECT lang, count(*) AS labelled, round(avg(quality), 4) AS quality_rate, round(avg(toxic), 4) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "a23_reliability": f"SELECT doc_id, {RELIABLE_SQL} AS reliability FROM documents",
    "p15_valid_text": r"""SELECT doc_id, coalesce(length(text) >= 5 AND NOT contains(text, chr(0)) AND NOT contains(text, 'ÿ') AND NOT contains(text, 'þ')
      AND (regexp_matches(text, '\p{L}') OR length(regexp_replace(text, '[^\x09-\x0D\x20-\x7E\x{80}-\x{10FFFF}]', '', 'g')) * 2 >= length(text)), false) AS valid FROM documents""",
    "o01_longest_per_source": "SELECT * FROM (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 3",
    "p07_transcript": "SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id",
    "w01_sequential_ids": r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda s: trim(s)), lambda s: length(s) > 15) AS a FROM conversations),
      e AS (SELECT conv_id, turn, unnest(a) AS sentence, unnest(range(1, len(a) + 1)) AS i FROM s) SELECT conv_id, turn, printf('concept_%03d', i) AS id, sentence FROM e""",
    "w07_context_budget": "SELECT * FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 4000",
    "p02_dotted_path": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "t01_event_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
