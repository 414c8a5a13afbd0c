"""Flows from end to end: cleanup of pages, exports of artifacts with scores and acceptance, two-stage extraction, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialects import duck_sql, spark_sql
from ..session import table
from ..sources.pages import CONCEPTS_SQL, artifacts
from .evaluation import first_list, text_of, validated
from .scoring import knowledge_score
from .signals import ORACLES as SIGNAL_SQL
from .signals import keyword_signals, sentence_candidates

#: Least scores that the second export accepts as a function and from the command line: fixed values.
ACCEPTED, ACCEPTED_CLI = 0.5, 0.4


def p05_first_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the first of several lists of each artifact, be it empty; none without a list."""
    rows = artifacts(spark, sf_dir).where("type_id in ('diagrams.dfd.concepts', 'theory', 'schema', 'diagrams.dfd.levels')")
    return rows.select("type_id", "seq", F.expr(f"size({first_list('body', ['meta.none', 'elements', 'concepts', 'decomposition_rules'])})").alias("n"))


def p14_text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a list, of a text, and of what is neither, of each domain artifact."""
    rows = artifacts(spark, sf_dir).where("type_id = 'domain'")
    value = lambda p: F.expr(text_of(f"get_json_object(body, '$.{p}')"))
    return rows.select("seq", value("models[0].attributes").alias("attributes"), value("name").alias("name"), value("terms[0]").alias("term"), value("none").alias("none"))


def exported(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """type_id, seq, valid (null without a schema), score and accepted of concept, rule and domain artifacts: valid and of a score of `least` or more."""
    rows = validated(artifacts(spark, sf_dir).where("type_id in ('diagrams.dfd.concepts', 'diagrams.dfd.rules', 'domain')"))
    n = F.expr(f"size({first_list('body', ['elements', 'rules', 'terms'])})")
    kind = F.substring_index("type_id", ".", -1)
    scored = rows.select("type_id", "seq", (F.size("errors") == 0).alias("valid"), F.round(knowledge_score(kind, n), 4).alias("score"))
    return scored.withColumn("accepted", F.col("valid") & (F.col("score") >= least))


def r07_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first export over documents: signals, candidates of concepts and rules, the larger score of both, and whether it is kept."""
    rows = sentence_candidates(keyword_signals(table(spark, sf_dir, "documents").select("doc_id", "text")))
    score = F.greatest("concept_score", "rule_score")
    return rows.select("doc_id", "types", F.round(score, 4).alias("score"), (score >= ACCEPTED).alias("kept"))


def r08_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second export: artifacts validated, scored and accepted."""
    return exported(spark, sf_dir, ACCEPTED)


def r09_two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages for each document: routed types, then how many pieces each type's extraction finds, with the tokens (a quarter of the characters, up) that both read."""
    tokens = F.expr("cast(ceil(length(coalesce(text, '')) / 4.0) as long)").alias("tokens")
    found = sentence_candidates(keyword_signals(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows = found.select("doc_id", F.explode(F.split("types", ",")).alias("type_id"), "concept_candidates", "rule_candidates", tokens)
    return rows.select("doc_id", "type_id", F.expr("case type_id when 'concepts' then concept_candidates when 'rules' then rule_candidates else 0 end").alias("pieces"), "tokens")


def a14_diagram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First score of orders as diagrams and of concepts and rules: three tenths for processes and flows, two for stores and entities, a twentieth for each of five."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("p"), F.count_if(F.col("l_quantity") > 20).alias("f"), F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count_distinct("l_suppkey").alias("e"))
    has = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0.0)
    score = has("p", 0.3) + has("f", 0.3) + has("s", 0.2) + has("e", 0.2) + F.least("p", F.lit(5)) * 0.05 + F.least("f", F.lit(5)) * 0.05
    return n.select("l_orderkey", F.round(F.least(F.lit(1.0), score), 4).alias("score"))


def v10_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries of user turns without a model to ask: the turn itself, general, of weight 10."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.lit("general").alias("intent"), F.lit(10).alias("weight"))


def p03_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of each artifact: how many fields it has, and of the first three their name and kind, of lists with their length."""
    rows = artifacts(spark, sf_dir).where("type_id in ('diagrams.dfd.concepts', 'domain', 'theory')").select("type_id", "seq", "body", F.expr("json_object_keys(body)").alias("k"))
    value = "get_json_object(body, concat('$.', x))"
    kind = f"concat(x, ':', case when startswith({value}, '[') then concat('list', size(from_json({value}, 'array<string>'))) when startswith({value}, '{{') then 'dict' else 'text' end)"
    return rows.select("type_id", "seq", F.size("k").alias("fields"), F.expr(f"array_join(transform(slice(k, 1, 3), x -> {kind}), ',')").alias("profile"))


def simhash(docs: DataFrame, most: int = 1000) -> DataFrame:
    """doc_id and simhash (16 hex digits) of documents(doc_id, text): each of the first `most` distinct words of two letters or more votes with the bits of its md5; texts without words have none."""
    words = F.expr(rf"explode(slice(array_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0)), 1, {most}))")
    rows = docs.select("doc_id", words.alias("w")).select("doc_id", *(F.expr(f"cast(conv(substring(md5(w), {at}, 8), 16, 10) as bigint)").alias(h) for h, at in (("a", 1), ("b", 9))))
    votes = rows.groupBy("doc_id").agg(*(F.sum(F.expr(f"(shiftright({h}, {k}) & 1) * 2 - 1")).alias(f"{h}{k}") for h in "ab" for k in range(32)))
    half = lambda h: "lpad(lower(hex(" + " + ".join(f"if({h}{k} > 0, {1 << k}L, 0L)" for k in range(32)) + ")), 8, '0')"
    return votes.select("doc_id", F.expr(f"concat({half('a')}, {half('b')})").alias("simhash"))


def d10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (p05_first_lists, p14_text_values, r07_export, r08_export, r09_two_stages, a14_diagram_score, v10_decomposed, p03_structure, d10_simhash)}
_SIGNALS, _PIECES = SIGNAL_SQL["a09_keyword_signals"], SIGNAL_SQL["e15_sentence_candidates"]
_BY_ROW = lambda sql: sql.replace("SELECT doc_id,", "SELECT r, doc_id,").replace("FROM documents", "FROM keyed")
_KEYED = f"keyed AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM documents), a AS ({_BY_ROW(_SIGNALS)}), b AS ({_BY_ROW(_PIECES)})"
ORACLES = {
    "p05_first_lists": "WITH " + CONCEPTS_SQL + " SELECT 'diagrams.dfd.concepts' AS type_id, seq, CAST(len(ids) AS INTEGER) AS n FROM a UNION ALL SELECT 'theory', doc_id, 1 FROM documents UNION ALL SELECT 'schema', doc_id, 0 FROM labels UNION ALL SELECT 'diagrams.dfd.levels', s_suppkey, 1 FROM supplier",
    "p14_text_values": "SELECT c_custkey AS seq, CAST(c_nationkey AS VARCHAR) AS attributes, c_name AS name, '' AS term, '' AS none FROM customer",
    "r07_export": f"WITH {_KEYED} SELECT a.doc_id, types, round(greatest(concept_score, rule_score), 4) AS score, greatest(concept_score, rule_score) >= 0.5 AS kept FROM a JOIN b USING (r)",
    "r08_export": "WITH " + CONCEPTS_SQL + """, r AS (SELECT 'diagrams.dfd.concepts' AS type_id, seq, len(ids) >= 4 AND seq >= 10 AS valid, CASE WHEN len(ids) > 0 THEN least(1.0::DOUBLE, len(ids) / 5.0::DOUBLE) ELSE 0.2::DOUBLE END AS score FROM a
      UNION ALL SELECT 'diagrams.dfd.rules', conv_id * 1000 + turn, true, 0.25::DOUBLE FROM conversations UNION ALL SELECT 'domain', c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), 0.5::DOUBLE FROM customer)
      SELECT type_id, seq, valid, round(score, 4) AS score, valid AND score >= 0.5 AS accepted FROM r""",
    "r09_two_stages": f"""WITH {_KEYED}, t AS (SELECT r, unnest(string_split(types, ',')) AS type_id FROM a)
      SELECT keyed.doc_id, type_id, CASE type_id WHEN 'concepts' THEN concept_candidates WHEN 'rules' THEN rule_candidates ELSE 0 END AS pieces, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM t JOIN b USING (r) JOIN keyed USING (r)""",
    "a14_diagram_score": """WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS p, count(*) FILTER (l_quantity > 20) AS f, count(*) FILTER (l_returnflag = 'R') AS s, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1)
      SELECT l_orderkey, round(least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN f > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN s > 0 THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE + least(p, 5) * 0.05::DOUBLE + least(f, 5) * 0.05::DOUBLE), 4) AS score FROM n""",
    "p03_structure": "WITH " + CONCEPTS_SQL + """ SELECT 'diagrams.dfd.concepts' AS type_id, seq, 4 AS fields, 'content_slug:text,description:text,elements:list' || len(ids) AS profile FROM a
      UNION ALL SELECT 'domain', c_custkey, 6, 'domain_id:text,name:text,description:text' FROM customer UNION ALL SELECT 'theory', doc_id, 2, 'concepts:list1,principles:list1' FROM documents""",
    "d10_simhash": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents), f AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:1000] AS w FROM w), u AS (SELECT doc_id, unnest(w) AS w FROM f),
      h AS (SELECT doc_id, CAST('0x' || md5(w)[1:8] AS BIGINT) AS a, CAST('0x' || md5(w)[9:16] AS BIGINT) AS b FROM u)
      SELECT doc_id, """ + " || ".join("lpad(lower(to_hex(" + " + ".join(f"CASE WHEN sum((({h} >> {k}) & 1) * 2 - 1) > 0 THEN {1 << k} ELSE 0 END" for k in range(32)) + ")), 8, '0')" for h in "ab") + " AS simhash FROM h GROUP BY 1",
    "v10_decomposed": "SELECT conv_id, turn, text AS query, 'general' AS intent, 10 AS weight FROM conversations WHERE role = 'user'",
}
