"""Scores of texts and artifacts by cue words and element counts, candidate and type filters, registry joins.

Null texts hold no cue. Occurrences are counted without overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources.pages import artifacts

#: Cue words of data-flow elements, words of data-flow diagrams, and words of concepts and rules: fixed values.
CUES = {
    "process": ["处理", "校验", "计算", "生成", "更新", "解析"],
    "data_flow": ["请求", "响应", "消息", "数据", "参数", "结果"],
    "data_store": ["记录", "表", "档案", "数据库", "清单", "库存"],
    "external_entity": ["用户", "管理员", "第三方系统", "客户端", "供应商"],
}
DIAGRAM_WORDS = ["数据流图", "DFD", "Data Flow", "顶层图", "0层", "1层", "外部实体", "数据存储", "加工", "处理过程"]
CONCEPT_WORDS = ["概念", "定义", "是指", "表示", "即", "所谓", "术语", "含义"]
RULE_WORDS = ["规则", "必须", "应当", "不得", "如果", "则", "要求", "约束", "限制", "规范", "注意", "警告"]
#: Types that a preselector may name, and a stand-in registry of routed types: enabled, least confidence, schema, tier.
CANDIDATE_TYPES = ["dfd", "concept", "rule", "unknown"]
REGISTRY = {"click": (True, 0.3, "click.schema.json", "simple"), "view": (True, 0.5, "view.schema.json", "simple"), "purchase": (True, 0.1, None, "complex"), "error": (False, 0.0, "error.schema.json", "complex")}


def occurrences(text: str, words: list[str]) -> Column:
    """How often the words occur in a text, all together; 0 for null."""
    return F.coalesce(sum((F.regexp_count(text, F.lit(w)) for w in words), F.lit(0)), F.lit(0))


def cue_counts(text: str) -> dict[str, Column]:
    return {k: occurrences(text, words) for k, words in CUES.items()}


def cue_score(weights: dict[str, float]) -> Column:
    """A tenth of the weighted sum of count columns, 1 at most."""
    return F.least(F.lit(1.0), sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / 10.0)


def a10_cue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow score of each document and whether it is a candidate at all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in cue_counts("text").items()))
    found = sum((F.col(k) for k in CUES), F.lit(0))
    return rows.select("doc_id", found.alias("signals"), F.round(cue_score({"process": 0.4, "data_flow": 0.3, "data_store": 0.2, "external_entity": 0.1}), 4).alias("score"), (found > 0).alias("is_candidate"))


def a11_diagram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow score with words of diagrams, which raise it to 0.7 from three on; 0.1 at least."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in cue_counts("text").items()), occurrences("text", DIAGRAM_WORDS).alias("diagram"))
    score = F.greatest(F.lit(0.1), cue_score({"process": 0.3, "data_flow": 0.25, "data_store": 0.2, "external_entity": 0.1, "diagram": 0.5}))
    return rows.select("doc_id", "diagram", F.round(F.when(F.col("diagram") >= 3, F.greatest(score, F.lit(0.7))).otherwise(score), 4).alias("score"))


def a12_keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept and rule scores: four fifths of the share of 8 and 10 hits, 0.1 at least."""
    score = lambda words, full: F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), occurrences("text", words) / full) * 0.8), 4)
    return table(spark, sf_dir, "documents").select("doc_id", score(CONCEPT_WORDS, 8.0).alias("concept_score"), score(RULE_WORDS, 10.0).alias("rule_score"))


def candidates(rows: DataFrame, text: str, kind: str) -> DataFrame:
    """Rows whose trimmed text has 30 characters or more, with type (unknown if it is none of the known) and confidence (0.8, of unknown ones 0.5)."""
    named = F.lower(F.coalesce(F.col(kind), F.lit("unknown")))
    known = F.when(named.isin(CANDIDATE_TYPES), named).otherwise("unknown")
    return rows.withColumn(text, F.trim(text)).where(F.length(text) >= 30).withColumn("type", known).withColumn("confidence", F.when(known != "unknown", 0.8).otherwise(0.5))


def _turn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case role when 'user' then 'DFD' when 'assistant' then 'concept' else role end")
    return candidates(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("kind")), "text", "kind")


def p23_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as preselected pieces with type and confidence."""
    return _turn_candidates(spark, sf_dir).select("conv_id", "turn", "type", "confidence")


def p24_target_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the concept type or of none known."""
    return _turn_candidates(spark, sf_dir).where(F.col("type").isin("concept", "unknown")).select("conv_id", "turn", "type")


def a13_preselector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth for each piece of the concept type, 1 at most, 0.1 without any, of each conversation with pieces."""
    exact = F.count_if(F.col("type") == "concept")
    return _turn_candidates(spark, sf_dir).groupBy("conv_id").agg(F.when(exact > 0, F.least(F.lit(1.0), exact / 5.0)).otherwise(0.1).alias("score"))


def a15_artifact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diagrams: parts as processes, two flows a line, returned lines as stores, suppliers as entities."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_distinct("l_partkey").alias("processes"), (2 * F.count("*")).alias("flows"), F.count_if(F.col("l_returnflag") == "R").alias("stores"), F.count_distinct("l_suppkey").alias("entities")
    )
    return n.select("l_orderkey", F.round(diagram_score("processes", "flows", "stores", "entities"), 4).alias("score"))


def diagram_score(processes: str, flows: str, stores: str, entities: str) -> Column:
    """Score of a data-flow diagram by its element counts: 0.5 at least with processes, else 0.2."""
    has = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0.0)
    some = lambda c: F.least(F.col(c), F.lit(5)) * 0.04
    score = F.least(F.lit(1.0), has(processes, 0.25) + has(flows, 0.25) + has(stores, 0.15) + has(entities, 0.15) + some(processes) + some(flows))
    return F.greatest(score, F.when(F.col(processes) > 0, 0.5).otherwise(0.2))


def knowledge_score(kind: Column, n: Column) -> Column:
    """Score of other artifacts by their number of items: concepts of 5, rules of 4, patterns of 3, transformations of 2, validations of 5; 0.2 without any, 0.5 for other kinds."""
    full = F.when(kind == "concepts", 5.0).when(kind == "rules", 4.0).when(kind == "patterns", 3.0).when(kind == "transformations", 2.0).when(kind == "validation", 5.0)
    return F.when(full.isNull(), 0.5).when(n > 0, F.least(F.lit(1.0), n / full)).otherwise(0.2)


def a15_knowledge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept and validation artifacts and others by their items."""
    rows = artifacts(spark, sf_dir).where("type_id in ('diagrams.dfd.concepts', 'diagrams.dfd.validation', 'schema')")
    n = "coalesce(size(from_json(coalesce(get_json_object(body, '$.elements'), get_json_object(body, '$.validation_rules')), 'array<string>')), 0)"
    kind = F.substring_index("type_id", ".", -1)
    return rows.select("type_id", "seq", F.round(knowledge_score(kind, F.greatest(F.expr(n), F.lit(0))), 4).alias("score"))


def registry(spark: SparkSession) -> DataFrame:
    """Routed types: type_id, enabled, least, schema, tier."""
    return spark.createDataFrame([(k, *v) for k, v in REGISTRY.items()], "type_id string, enabled boolean, least double, schema string, tier string")


def p22_routed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as routed types, a hundredth of the value as confidence (0.5 without one): those registered, enabled and sure enough."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type_id"), F.coalesce(F.col("value") / 100, F.lit(0.5)).alias("confidence"))
    return rows.join(F.broadcast(registry(spark)), "type_id").where("enabled and confidence >= least").select("event_id", "type_id", F.round("confidence", 4).alias("confidence"))


def j11_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema and tier of each event's type, null for types that are not registered; the registry has a row for each type."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type_id"))
    return rows.join(F.broadcast(registry(spark)), "type_id", "left").select("event_id", "type_id", "schema", F.coalesce("tier", F.lit("complex")).alias("tier"))


def j16_stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's routed roles with how much was extracted for them and whether a label of the same number calls it good."""
    turns = table(spark, sf_dir, "conversations")
    routed = turns.where("role is not null").select("conv_id", F.col("role").alias("type_id")).distinct()
    extracted = turns.where("text is not null and role is not null").groupBy("conv_id", F.col("role").alias("type_id")).agg(F.sum(F.length("text")).alias("extracted"))
    checked = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("conv_id")).agg((F.max("quality") == 1).alias("valid"))
    return routed.join(extracted, ["conv_id", "type_id"], "left").join(checked, "conv_id", "left").select("conv_id", "type_id", F.coalesce("extracted", F.lit(0).cast("long")).alias("extracted"), "valid")


def l08_stage3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts of a semantic judge, toxic ones as a source check that failed: both must hold; what is unavailable passes."""
    source_ok, judge_ok = F.coalesce(F.col("toxic") == 0, F.lit(True)), F.coalesce(F.col("quality") == 1, F.lit(True))
    reason = F.when(~source_ok, "source").when(~judge_ok, "judge").otherwise("")
    return table(spark, sf_dir, "labels").select("doc_id", (source_ok & judge_ok).alias("accepted"), reason.alias("reason"))


QUERIES = {
    q.__name__: q
    for q in (a10_cue_score, a11_diagram_score, a12_keyword_scores, p23_candidates, p24_target_candidates, a13_preselector_score, a15_artifact_score, a15_knowledge_score, p22_routed_types, j11_registry, j16_stage_results, l08_stage3)
}


def _count_sql(words: str) -> str:
    """DuckDB SQL of the occurrences of words (parted by spaces; a _ stands for one inside a word)."""
    return "(" + " + ".join(f"(length(t) - length(replace(t, '{w.replace('_', ' ')}', ''))) // {len(w)}" for w in words.split(" ")) + ")"


_CUES_SQL = (
    f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, {_count_sql('处理 校验 计算 生成 更新 解析')} AS p, {_count_sql('请求 响应 消息 数据 参数 结果')} AS f, {_count_sql('记录 表 档案 数据库 清单 库存')} AS s,"
    f" {_count_sql('用户 管理员 第三方系统 客户端 供应商')} AS e, {_count_sql('数据流图 DFD Data_Flow 顶层图 0层 1层 外部实体 数据存储 加工 处理过程')} AS k, {_count_sql('概念 定义 是指 表示 即 所谓 术语 含义')} AS h,"
    f" {_count_sql('规则 必须 应当 不得 如果 则 要求 约束 限制 规范 注意 警告')} AS r FROM d)"
)
_PIECES_SQL = "WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'dfd' WHEN 'assistant' THEN 'concept' WHEN 'rule' THEN 'rule' ELSE 'unknown' END AS type FROM conversations WHERE length(trim(text, ' ')) >= 30)"
ORACLES = {
    "a10_cue_score": _CUES_SQL + " SELECT doc_id, CAST(p + f + s + e AS INTEGER) AS signals, round(least(1.0, (0.4 * p + 0.3 * f + 0.2 * s + 0.1 * e) / 10.0)::DOUBLE, 4) AS score, p + f + s + e > 0 AS is_candidate FROM c",
    "a11_diagram_score": _CUES_SQL + " SELECT doc_id, CAST(k AS INTEGER) AS diagram, round(greatest(0.1, CASE WHEN k >= 3 THEN 0.7 ELSE 0 END, least(1.0, (0.3 * p + 0.25 * f + 0.2 * s + 0.1 * e + 0.5 * k) / 10.0))::DOUBLE, 4) AS score FROM c",
    "a12_keyword_scores": _CUES_SQL + " SELECT doc_id, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, h / 8.0::DOUBLE) * 0.8), 4) AS concept_score, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, r / 10.0::DOUBLE) * 0.8), 4) AS rule_score FROM c",
    "p23_candidates": _PIECES_SQL + " SELECT conv_id, turn, type, CASE WHEN type = 'unknown' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM c",
    "p24_target_candidates": _PIECES_SQL + " SELECT conv_id, turn, type FROM c WHERE type IN ('concept', 'unknown')",
    "a13_preselector_score": _PIECES_SQL + " SELECT conv_id, CASE WHEN count(*) FILTER (type = 'concept') > 0 THEN least(1.0::DOUBLE, count(*) FILTER (type = 'concept') / 5.0::DOUBLE) ELSE 0.1::DOUBLE END AS score FROM c GROUP BY 1",
    "a15_artifact_score": """WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS p, 2 * count(*) AS f, count(*) FILTER (l_returnflag = 'R') AS s, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1)
      SELECT l_orderkey, round(greatest(0.5::DOUBLE, least(1.0::DOUBLE, 0.25::DOUBLE + 0.25::DOUBLE + CASE WHEN s > 0 THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE + least(p, 5) * 0.04::DOUBLE + least(f, 5) * 0.04::DOUBLE)), 4) AS score FROM n""",
    "a15_knowledge_score": """SELECT 'diagrams.dfd.concepts' AS type_id, page_id AS seq, CASE WHEN len(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>')) > 0 THEN round(least(1.0::DOUBLE, len(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>')) / 5.0::DOUBLE), 4) ELSE 0.2::DOUBLE END AS score FROM pages
      UNION ALL SELECT 'diagrams.dfd.validation', page_id, 0.2::DOUBLE FROM pages UNION ALL SELECT 'schema', doc_id, 0.5::DOUBLE FROM labels""",
    "p22_routed_types": """SELECT event_id, event_type AS type_id, round(coalesce(value / 100, 0.5), 4) AS confidence FROM events
      WHERE (event_type = 'click' AND coalesce(value / 100, 0.5) >= 0.3) OR (event_type = 'view' AND coalesce(value / 100, 0.5) >= 0.5) OR (event_type = 'purchase' AND coalesce(value / 100, 0.5) >= 0.1)""",
    "j11_registry": """SELECT event_id, event_type AS type_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type || '.schema.json' END AS schema, CASE WHEN event_type IN ('click', 'view') THEN 'simple' ELSE 'complex' END AS tier FROM events""",
    "j16_stage_results": """WITH r AS (SELECT conv_id, role AS type_id, coalesce(sum(length(text)), 0) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2), l AS (SELECT doc_id, max(quality) = 1 AS valid FROM labels GROUP BY 1)
      SELECT conv_id, type_id, CAST(n AS BIGINT) AS extracted, valid FROM r LEFT JOIN l ON doc_id = conv_id""",
    "l08_stage3": "SELECT doc_id, coalesce(toxic, 0) = 0 AND coalesce(quality, 1) = 1 AS accepted, CASE WHEN coalesce(toxic, 0) <> 0 THEN 'source' WHEN coalesce(quality, 1) <> 1 THEN 'judge' ELSE '' END AS reason FROM labels",
}
