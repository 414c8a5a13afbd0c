"""Quality evaluation of JSON artifacts: items by type, missing and thin fields, repeated texts, schema checks and run counters.

Lists that are missing or no lists have no items; items that are no objects count as items but have no
fields. Numbers in text fields count as their digits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources.pages import CONCEPTS_SQL, artifacts
from .corpus import PLACEHOLDERS

#: For each type: where its items are (a list, the first of several lists, or the root), which fields they need, which are texts, and which must not repeat. Fixed values.
EVALUATORS = {
    "diagrams.dfd.concepts": [("elements,concepts,generation_knowledge.concepts", "id,name,definition", "name,definition", "definition")],
    "diagrams.dfd.rules": [("rules", "id,name,detail,level", "name,detail", "detail")],
    "diagrams.dfd.examples": [
        ("", "case_name,description,requirements_text,dfd_elements", "description,requirements_text", "description"),
        ("dfd_elements.external_entities", "id,name", "name,data,from,to", "name"),
        ("dfd_elements.processes", "id,name", "name,data,from,to", "name"),
        ("dfd_elements.data_stores", "id,name", "name,data,from,to", "name"),
        ("dfd_elements.data_flows", "from,to,data", "name,data,from,to", "name"),
    ],
    "diagrams.dfd.levels": [("leveling_principles", "id,description", "description", "description"), ("decomposition_rules", "id,description", "description", "description"), ("level_definitions", "level,name,purpose", "name,purpose", "purpose")],
    "diagrams.dfd.templates": [("categories", "id,name,templates", "name", "name"), ("categories[].templates", "id,name,dfd_level,pattern_type,structure", "name,pattern_type", "name")],
    "diagrams.dfd.validation": [("validation_rules", "id,name,definition,severity", "name,definition,error_message", "definition")],
    "theory": [("concepts", "id,name,definition", "name,definition", "definition"), ("principles", "id,detail", "detail", "detail")],
    "domain": [
        ("", "domain_id,name,description", "name,description", "description"),
        ("terms", "term,definition", "term,definition", "definition"),
        ("rules", "rule_id,description", "description", "description"),
        ("models", "entity,attributes,relationships", "entity", "entity"),
    ],
    "mappings": [(x, "id,name,description", "name,description", "description") for x in ("semantic_cues", "linguistic_patterns", "extraction_guidelines")],
    "schema": [("", "title", "title", "title")],
}
#: Least lengths of a text with information and of an item worth an index entry, fixed values.
MIN_INFO, MIN_INDEX = 12, 30


def first_list(body: str, keys: list[str]) -> str:
    """SQL of the items, as JSON texts, of the first key of a JSON column that holds a list (an empty one counts); empty without any."""
    return "coalesce(" + ", ".join(f"from_json(get_json_object({body}, '$.{k}'), 'array<string>')" for k in keys) + ", array())"


#: EVALUATORS as one list; a spec is a number in it. Where its items are: keys of lists, the first that is one counts.
_SPECS = [(type_id, place.split(","), required.split(","), fields.split(","), dup) for type_id, specs in EVALUATORS.items() for place, required, fields, dup in specs]


def _schema(paths: list[list[str]]) -> str:
    """The type of a struct in which each path of keys is a list of JSON texts."""
    inner = {}
    for first, *rest in paths:
        inner.setdefault(first, []).extend([rest] if rest else [])
    return "struct<" + ", ".join(f"{k}: {_schema(rest) if rest else 'array<string>'}" for k, rest in inner.items()) + ">"


#: All lists that evaluators read of a body, as the type of its one parse.
_LISTS = _schema([p.split("[].")[0].split(".") for _, place, *_ in _SPECS for p in place if p])


def _items(place: list[str]) -> str:
    if place == [""]:
        return "array(body)"
    if "[]." in place[0]:
        outer, inner = place[0].split("[].")
        return f"flatten(transform(coalesce(b.{outer}, array()), x -> coalesce(from_json(x, '{inner} array<string>').{inner}, array())))"
    return f"coalesce({', '.join(f'b.{p}' for p in place)}, array())"


def items(rows: DataFrame) -> DataFrame:
    """One row per item of artifacts(seq, type_id, body): item as JSON, and the number of its spec. A body is parsed once for all its lists."""
    made = {t: ", ".join(f"transform({_items(place)}, x -> struct({i} as spec, x as item))" for i, (own, place, *_) in enumerate(_SPECS) if own == t) for t in EVALUATORS}
    branch = " ".join(f"when '{t}' then concat({sql})" for t, sql in made.items())
    parsed = rows.select("seq", "type_id", "body", F.explode(F.array(F.from_json("body", _LISTS))).alias("b"))
    return parsed.select("seq", "type_id", F.explode(F.expr(f"case type_id {branch} end")).alias("e")).select("seq", "type_id", "e.spec", "e.item")


def text_of(value: str) -> str:
    """SQL of the text of a JSON value: a text trimmed, a list's texts joined; nothing for null and other values."""
    return f"btrim(case when {value} is null or startswith({value}, '{{') then '' when startswith({value}, '[') then array_join(coalesce(from_json({value}, 'array<string>'), array({value})), ' ') else {value} end, ' \\t\\n\\r')"


def low_info(text: str, least: int) -> str:
    """SQL of whether a text is empty, too short, or holds a placeholder."""
    return f"({text} = '' or length({text}) < {least} or lower({text}) rlike '{'|'.join(map(re.escape, PLACEHOLDERS))}')"


def item_metrics(rows: DataFrame, min_info: int = MIN_INFO, min_index: int = MIN_INDEX) -> DataFrame:
    """Per item: missing and required fields, thin and all text fields, whether it is too short for the index, and its text that must not repeat."""
    of = lambda k: F.array(*(F.array(*map(F.lit, x[k])) if isinstance(x[k], list) else F.lit(x[k]) for x in _SPECS))[F.col("spec")]
    own = items(rows).select("seq", "type_id", F.explode(F.array(F.from_json("item", "map<string,string>"))).alias("m"), of(2).alias("required"), of(3).alias("fields"), of(4).alias("dup"))
    own = own.withColumn("texts", F.explode(F.array(F.expr(f"transform(fields, f -> {text_of('m[f]')})"))))
    return own.select(
        "seq",
        "type_id",
        F.expr("if(m is null, 0, size(filter(required, f -> coalesce(m[f], '') in ('', '[]'))))").alias("missing"),
        F.expr("if(m is null, 0, size(required))").alias("required"),
        F.expr(f"if(m is null, 0, size(filter(texts, t -> {low_info('t', min_info)})))").alias("low_info"),
        F.expr("if(m is null, 0, size(fields))").alias("text_fields"),
        F.expr(f"if(m is not null and aggregate(texts, 0, (n, t) -> n + length(t)) < {min_index}, 1, 0)").alias("index_failures"),
        F.expr(f"nullif({text_of('m[dup]')}, '')").alias("dup_text"),
    )


def normalized_text(text: Column) -> Column:
    """A text in lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def quality_report(rows: DataFrame, *by: str) -> DataFrame:
    """Counters and rates, to four places, 0 where there is nothing to count, for each `by` of artifacts.

    Repeats are counted over hashes of normalized texts, which partial aggregation brings together before any shuffle of them.
    """
    each = item_metrics(rows).withColumn("h", F.when(F.col("dup_text").isNotNull(), F.md5(normalized_text(F.col("dup_text")))))
    total = each.groupBy(*by).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in ("missing", "required", "low_info", "text_fields", "index_failures")), F.count("h").alias("texts"), F.count_distinct("h").alias("distinct_texts"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    c = F.col
    return total.select(
        *by, "items", rate(c("missing"), c("required")).alias("missing_rate"), rate(c("low_info"), c("text_fields")).alias("low_info_rate"), rate(c("index_failures"), c("items")).alias("indexable_fail_rate"),
        rate(c("texts") - c("distinct_texts"), c("texts")).alias("duplicate_rate"),
    )


def schema_errors(body: str, schema: dict, at: str = "$") -> Column:
    """Errors of a JSON column against a JSON Schema of type, required, properties, enum, pattern, minItems and minimum; an array of texts."""
    value, errors = f"get_json_object({body}, '{at}')", []
    kinds = {"object": f"startswith({value}, '{{')", "array": f"startswith({value}, '[')", "integer": f"{value} rlike '^-?[0-9]+$'", "number": f"{value} rlike '^-?[0-9.eE+-]+$'", "boolean": f"{value} in ('true', 'false')"}
    if schema.get("type") in kinds:
        errors.append((f"{value} is not null and not {kinds[schema['type']]}", f"{at}: not of type {schema['type']}"))
    for name in schema.get("required", []):
        errors.append((f"{value} is not null and get_json_object({body}, '{at}.{name}') is null", f"{at}: {name} is required"))
    if "enum" in schema:
        errors.append((f"{value} not in ({', '.join(repr(str(x)) for x in schema['enum'])})", f"{at}: not one of the values"))
    if "pattern" in schema:
        errors.append((f"not {value} rlike r'{schema['pattern']}'", f"{at}: no match of the pattern"))
    if "minItems" in schema:
        errors.append((f"size(from_json({value}, 'array<string>')) < {schema['minItems']}", f"{at}: too few items"))
    if "minimum" in schema:
        errors.append((f"cast({value} as double) < {schema['minimum']}", f"{at}: too small"))
    own = F.array_compact(F.array(F.expr(f"if({value} is null and '{at}' = '$', '$: no JSON', null)"), *(F.expr(f"if(coalesce({c}, false), '{m}', null)") for c, m in errors)))
    return F.concat(own, *(schema_errors(body, sub, f"{at}.{name}") for name, sub in schema.get("properties", {}).items()))


#: Schemas of the artifact types that have one.
SCHEMAS = {
    "diagrams.dfd.rules": {"type": "object", "required": ["rules"], "properties": {"rules": {"type": "array", "minItems": 1}}},
    "diagrams.dfd.concepts": {"type": "object", "required": ["description", "elements"], "properties": {"elements": {"type": "array", "minItems": 4}, "content_slug": {"type": "string", "pattern": "^page_[0-9]+$"}, "meta": {"type": "object", "properties": {"number": {"type": "integer", "minimum": 10}}}}},
    "domain": {"type": "object", "required": ["domain_id", "name"], "properties": {"description": {"type": "string", "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}}},
}


def validated(rows: DataFrame) -> DataFrame:
    """errors of each artifact: null without a schema of its type, else a list that is empty if it is valid."""
    return rows.withColumn("errors", F.coalesce(*(F.when(F.col("type_id") == t, schema_errors("body", s)) for t, s in SCHEMAS.items())))


def a02_item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of item metrics of each artifact of the concept type."""
    rows = artifacts(spark, sf_dir).where("type_id = 'diagrams.dfd.concepts'")
    return item_metrics(rows).groupBy("seq").agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in ("missing", "required", "low_info", "text_fields", "index_failures")), F.count("dup_text").alias("texts"))


def a03_evaluators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report of artifacts of all ten types, by type."""
    return quality_report(artifacts(spark, sf_dir), "type_id")


def a07_schema_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type how many artifacts there are, pass their schema (R01), fail it, or have none."""
    e = F.col("errors")
    return validated(artifacts(spark, sf_dir)).groupBy("type_id").agg(F.count(e).alias("available"), F.count_if(F.size(e) == 0).alias("passed"), F.count_if(F.size(e) > 0).alias("failed"), F.count_if(e.isNull()).alias("skipped"))


def r01_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the concept artifacts against their schema."""
    rows = validated(artifacts(spark, sf_dir).where("type_id = 'diagrams.dfd.concepts'"))
    return rows.select("seq", (F.size("errors") == 0).alias("ok"), F.array_join("errors", "; ").alias("errors"))


def a20_complex_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: entities, processes, stores and flows of each, those of 22 or more in all, fewest first."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("entities"), F.count("*").alias("processes"), (2 * F.count("*") - 1).alias("flows"), F.count_distinct("l_returnflag").alias("stores"))
    return lines.withColumn("total", F.expr("entities + processes + flows + stores")).where("total >= 22")


def a25_crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawls: how many there are, succeed, fail, and the share that succeeds, of each user and of all."""
    good = F.count_if(F.col("event_type") != "error")
    return table(spark, sf_dir, "events").rollup("user_id").agg(F.count("*").alias("total"), good.alias("succeeded"), (F.count("*") - good).alias("failed"), F.round(good / F.count("*"), 4).alias("success_rate"))


def a26_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (a quarter of the characters, up) of each conversation by stage, the system turn's as routing, others' as extraction, and in all."""
    n = F.expr("cast(ceil(length(coalesce(text, '')) / 4.0) as long)")
    stage = F.when(F.col("role") == "system", F.lit("routing")).otherwise(F.lit("extraction"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id", stage.alias("stage")).agg(F.sum(n).alias("tokens")).rollup("conv_id", "stage").agg(F.sum("tokens").alias("tokens"))


def a27_category_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each artifact by the last part of its type, as {part}_count."""
    last = F.concat(F.substring_index("type_id", ".", -1), F.lit("_count"))
    return items(artifacts(spark, sf_dir)).groupBy(last.alias("statistic")).agg(F.count("*").alias("n"), F.count_distinct("seq").alias("artifacts"))


def a28_context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages and characters each kind of context has, told by words of the address: concept, rule or level, template or pattern, example, others."""
    kind = "case when contains(lower(url), 'concept') then 'concepts' when lower(url) rlike 'rule|level' then 'rules' when lower(url) rlike 'template|pattern' then 'templates' when contains(lower(url), 'example') then 'examples' else 'others' end"
    return table(spark, sf_dir, "pages").groupBy(F.expr(kind).alias("kind")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


QUERIES = {
    q.__name__: q
    for q in (a02_item_metrics, a03_evaluators, a07_schema_tally, r01_schema_errors, a20_complex_cases, a25_crawl_counters, a26_token_totals, a27_category_statistics, a28_context_groups)
}
#: Items by type as lists: values of needed fields, texts and the text that must not repeat.
_ITEMS_SQL = "WITH " + CONCEPTS_SQL + """, i AS (
  SELECT 'diagrams.dfd.concepts' AS t, seq, [id, name, 'about ' || name] AS need, [name, 'about ' || name] AS texts, 'about ' || name AS dup FROM (SELECT seq, unnest(ids) AS id, unnest(names) AS name FROM a)
  UNION ALL SELECT 'diagrams.dfd.rules', conv_id * 1000 + turn, ['rule_' || turn, role, text, CASE WHEN turn % 2 = 0 THEN 'warning' END], [role, text], text FROM conversations
  UNION ALL SELECT 'diagrams.dfd.examples', l_orderkey * 10 + l_linenumber, ['case', l_returnflag, 'x', 'x'], [l_returnflag, 'ship ' || l_linestatus || ' on time'], l_returnflag FROM lineitem
  UNION ALL SELECT 'diagrams.dfd.examples', l_orderkey * 10 + l_linenumber, ['s' || l_suppkey, 'x'], ['supplier ' || l_suppkey, NULL, NULL, NULL], 'supplier ' || l_suppkey FROM lineitem
  UNION ALL SELECT 'diagrams.dfd.examples', l_orderkey * 10 + l_linenumber, ['p' || l_partkey, 'x'], ['part ' || l_partkey, NULL, NULL, NULL], 'part ' || l_partkey FROM lineitem
  UNION ALL SELECT 'diagrams.dfd.examples', l_orderkey * 10 + l_linenumber, ['s', 'p', CAST(l_quantity AS VARCHAR)], [NULL, CAST(l_quantity AS VARCHAR), 's' || l_suppkey, 'p' || l_partkey], NULL FROM lineitem
  UNION ALL SELECT 'diagrams.dfd.examples', l_orderkey * 10 + l_linenumber, ['p', 'buyer', NULL], [NULL, NULL, 'p' || l_partkey, 'buyer'], NULL FROM lineitem
  UNION ALL SELECT 'diagrams.dfd.levels', s_suppkey, ['p', s_name], [s_name], s_name FROM supplier
  UNION ALL SELECT 'diagrams.dfd.levels', s_suppkey, ['n', NULL], [NULL], NULL FROM supplier
  UNION ALL SELECT 'diagrams.dfd.levels', s_suppkey, ['1', s_name, ''], [s_name, ''], '' FROM supplier
  UNION ALL SELECT 'diagrams.dfd.templates', p_partkey, ['c', p_brand, 't'], [p_brand], p_brand FROM part
  UNION ALL SELECT 'diagrams.dfd.templates', p_partkey, ['t', p_name, '0', p_type, p_brand], [p_name, p_type], p_name FROM part
  UNION ALL SELECT 'diagrams.dfd.validation', page_id, ['v', NULL, url, 'error'], [NULL, url, 'n/a'], url FROM pages
  UNION ALL SELECT 'theory', doc_id, ['c', lang, text], [lang, text], text FROM documents
  UNION ALL SELECT 'theory', doc_id, [source, 'from'], ['from ' || source], 'from ' || source FROM documents
  UNION ALL SELECT 'domain', c_custkey, ['d', c_name, c_mktsegment], [c_name, c_mktsegment], c_mktsegment FROM customer
  UNION ALL SELECT 'domain', c_custkey, [c_mktsegment, NULL], [c_mktsegment, NULL], NULL FROM customer
  UNION ALL SELECT 'domain', c_custkey, ['r', ''], [''], '' FROM customer
  UNION ALL SELECT 'domain', c_custkey, [c_name, 'x', NULL], [c_name], c_name FROM customer
  UNION ALL SELECT 'mappings', n_nationkey, ['m', n_name, NULL], [n_name, NULL], NULL FROM nation
  UNION ALL SELECT 'mappings', n_nationkey, ['l', 'x', n_name], ['暂无', n_name], n_name FROM nation
  UNION ALL SELECT 'schema', doc_id, ['x'], ['schema of ' || doc_id], 'schema of ' || doc_id FROM labels),
 m AS (SELECT t, seq, len(list_filter(need, lambda x: coalesce(x, '') = '')) AS missing, len(need) AS required, len(texts) AS text_fields, list_transform(texts, lambda x: trim(coalesce(x, ''), ' ' || chr(9) || chr(10) || chr(13))) AS texts, nullif(trim(dup, ' ' || chr(9) || chr(10) || chr(13)), '') AS dup FROM i),
 e AS (SELECT *, len(list_filter(texts, lambda x: length(x) < 12 OR contains(lower(x), '暂无') OR contains(lower(x), '未知') OR contains(lower(x), '未提供') OR contains(lower(x), '无') OR contains(lower(x), '空')
    OR contains(lower(x), 'n/a') OR contains(lower(x), 'none') OR contains(lower(x), 'null'))) AS low_info, CASE WHEN list_sum(list_transform(texts, lambda x: length(x))) < 30 THEN 1 ELSE 0 END AS index_failures,
    regexp_replace(lower(dup), '[^\\p{L}\\p{N}_]', '', 'g') AS h FROM m)"""
ORACLES = {
    "a02_item_metrics": _ITEMS_SQL + """ SELECT seq, count(*) AS items, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(required) AS BIGINT) AS required, CAST(sum(low_info) AS BIGINT) AS low_info, CAST(sum(text_fields) AS BIGINT) AS text_fields,
      CAST(sum(index_failures) AS BIGINT) AS index_failures, count(dup) AS texts FROM e WHERE t = 'diagrams.dfd.concepts' GROUP BY 1""",
    "a03_evaluators": _ITEMS_SQL + """ SELECT t AS type_id, count(*) AS items, round(sum(missing) / sum(required), 4) AS missing_rate, round(sum(low_info) / sum(text_fields), 4) AS low_info_rate,
      round(sum(index_failures) / count(*), 4) AS indexable_fail_rate, coalesce(round((count(h) - count(DISTINCT h)) / nullif(count(h), 0), 4), 0) AS duplicate_rate FROM e GROUP BY 1""",
    "a07_schema_tally": "WITH " + CONCEPTS_SQL + """, r AS (SELECT 'diagrams.dfd.concepts' AS type_id, len(ids) >= 4 AND seq >= 10 AS ok FROM a
      UNION ALL SELECT 'diagrams.dfd.rules', true FROM conversations UNION ALL SELECT 'domain', c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') FROM customer
      UNION ALL SELECT 'diagrams.dfd.examples', NULL FROM lineitem UNION ALL SELECT 'diagrams.dfd.levels', NULL FROM supplier UNION ALL SELECT 'diagrams.dfd.templates', NULL FROM part
      UNION ALL SELECT 'diagrams.dfd.validation', NULL FROM pages UNION ALL SELECT 'theory', NULL FROM documents UNION ALL SELECT 'mappings', NULL FROM nation UNION ALL SELECT 'schema', NULL FROM labels)
      SELECT type_id, count(ok) AS available, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS skipped FROM r GROUP BY 1""",
    "r01_schema_errors": "WITH " + CONCEPTS_SQL + """ SELECT seq, len(ids) >= 4 AND seq >= 10 AS ok, concat_ws('; ', CASE WHEN len(ids) < 4 THEN '$.elements: too few items' END, CASE WHEN seq < 10 THEN '$.meta.number: too small' END) AS errors FROM a""",
    "a20_complex_cases": """WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS entities, count(*) AS processes, 2 * count(*) - 1 AS flows, count(DISTINCT l_returnflag) AS stores FROM lineitem GROUP BY 1)
      SELECT *, entities + processes + flows + stores AS total FROM c WHERE entities + processes + flows + stores >= 22""",
    "a25_crawl_counters": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate FROM events GROUP BY ROLLUP (user_id)",
    "a26_token_totals": "SELECT conv_id, CASE WHEN role = 'system' THEN 'routing' ELSE 'extraction' END AS stage, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY ROLLUP (conv_id, stage)",
    "a27_category_statistics": _ITEMS_SQL + " SELECT split_part(t, '.', -1) || '_count' AS statistic, count(*) AS n, count(DISTINCT seq) AS artifacts FROM e GROUP BY 1",
    "a28_context_groups": """SELECT CASE WHEN contains(lower(url), 'concept') THEN 'concepts' WHEN regexp_matches(lower(url), 'rule|level') THEN 'rules' WHEN regexp_matches(lower(url), 'template|pattern') THEN 'templates'
      WHEN contains(lower(url), 'example') THEN 'examples' ELSE 'others' END AS kind, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1""",
}
