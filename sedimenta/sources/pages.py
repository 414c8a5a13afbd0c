"""Knowledge artifacts made of pages, as extraction would hand them over: one JSON body per page.

The given tables hold no artifacts, so that pages stand in: a page's links are the elements of a concept
artifact (id: the lower-case address, name and definition: the link's text), its title the description.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

CONCEPTS = "diagrams.dfd.concepts"


def concept_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, type_id, source_url and body (JSON with content_slug, description, elements and meta) of every page."""
    links = r"""regexp_extract_all(html, r'<a href="/([^"]*)">([^<]*)</a>', {})"""
    made = "arrays_zip({}, {})".format(links.format(1), links.format(2))
    elements = f"transform({made}, x -> struct(lower(x['0']) as id, x['1'] as name, concat('about ', x['1']) as definition))"
    title = r"regexp_extract(html, r'(?s)<title[^>]*>(.*?)</title>', 1)"
    body = f"to_json(struct(concat('page_', page_id) as content_slug, {title} as description, {elements} as elements, struct(url as source_url, page_id as number) as meta))"
    return spread(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("seq"), F.lit(CONCEPTS).alias("type_id"), F.col("url").alias("source_url"), F.expr(body).alias("body"))


#: DuckDB SQL of the same artifacts as columns: seq, url, description, ids, names.
CONCEPTS_SQL = r"""a AS (SELECT page_id AS seq, url, coalesce(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS description,
  list_transform(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1), lambda x: lower(x)) AS ids, regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2) AS names FROM pages)"""


#: type -> (table, SQL of seq, SQL of the body as a struct), one artifact per row; a body's null fields are missing fields.
_ROWS = {
    "diagrams.dfd.templates": ("part", "p_partkey", "struct(array(struct(concat('cat_', p_partkey) as id, p_brand as name, array(struct(concat('t_', p_partkey) as id, p_name as name, p_size % 4 as dfd_level, p_type as pattern_type, p_brand as structure, array(p_type, 'any') as applicable_scenarios)) as templates)) as categories)"),
    "diagrams.dfd.levels": ("supplier", "s_suppkey", "struct(array(struct(concat('p_', s_suppkey) as id, s_name as description)) as leveling_principles, array(struct(concat('n_', s_nationkey) as id, cast(null as string) as description)) as decomposition_rules, array(struct(s_nationkey % 4 as level, s_name as name, '' as purpose)) as level_definitions)"),
    "theory": ("documents", "doc_id", "struct(array(struct(concat('c_', doc_id) as id, lang as name, text as definition)) as concepts, array(struct(source as id, concat('from ', source) as detail)) as principles)"),
    "domain": ("customer", "c_custkey", "struct(concat('d_', c_custkey) as domain_id, c_name as name, c_mktsegment as description, array(struct(c_mktsegment as term, cast(null as string) as definition)) as terms, array(struct(concat('r_', c_nationkey) as rule_id, '' as description)) as rules, array(struct(c_name as entity, array(cast(c_nationkey as string)) as attributes, cast(null as string) as relationships)) as models)"),
    "schema": ("labels", "doc_id", "struct(concat('schema of ', doc_id) as title)"),
    "mappings": ("nation", "n_nationkey", "struct(array(struct(concat('m_', n_nationkey) as id, n_name as name)) as semantic_cues, array(struct(concat('l_', n_regionkey) as id, '暂无' as name, n_name as description)) as linguistic_patterns)"),
}


#: The types of `artifacts`.
ARTIFACT_TYPES = (CONCEPTS, *_ROWS, "diagrams.dfd.rules", "diagrams.dfd.examples", "diagrams.dfd.validation")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, type_id and body of artifacts of all ten types, made of the rows of the given tables."""
    out = concept_artifacts(spark, sf_dir).select("seq", "type_id", "body")
    for type_id, (name, seq, body) in _ROWS.items():
        out = out.unionByName(spread(table(spark, sf_dir, name)).selectExpr(f"cast({seq} as long) as seq", f"'{type_id}' as type_id", f"to_json({body}) as body"))
    return out.unionByName(rule_artifacts(spark, sf_dir)).unionByName(case_artifacts(spark, sf_dir)).unionByName(check_artifacts(spark, sf_dir))


def rule_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an artifact of one rule."""
    body = "to_json(struct(array(struct(concat('rule_', turn) as id, role as name, text as detail, case when turn % 2 = 0 then 'warning' end as level)) as rules))"
    return spread(table(spark, sf_dir, "conversations")).selectExpr("conv_id * 1000 + turn as seq", "'diagrams.dfd.rules' as type_id", f"{body} as body")


def check_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address as an artifact of one validation rule."""
    body = "to_json(struct(array(struct(concat('v_', page_id) as id, url as definition, 'error' as severity, cast(null as string) as name, 'n/a' as error_message)) as validation_rules))"
    return spread(table(spark, sf_dir, "pages")).selectExpr("page_id as seq", "'diagrams.dfd.validation' as type_id", f"{body} as body")


def case_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a case: supplier and buyer as entities, the part as process, the line as flow."""
    body = (
        "to_json(struct(concat('case_', l_orderkey, '_', l_linenumber) as case_name, l_returnflag as description, array(concat('ship ', l_linestatus), 'on time') as requirements_text,"
        " struct(array(struct(concat('s', l_suppkey) as id, concat('supplier ', l_suppkey) as name)) as external_entities, array(struct(concat('p', l_partkey) as id, concat('part ', l_partkey) as name)) as processes,"
        " array(struct(concat('s', l_suppkey) as `from`, concat('p', l_partkey) as `to`, cast(l_quantity as string) as data), struct(concat('p', l_partkey) as `from`, 'buyer' as `to`, cast(null as string) as data)) as data_flows) as dfd_elements))"
    )
    return spread(table(spark, sf_dir, "lineitem")).selectExpr("l_orderkey * 10 + l_linenumber as seq", "'diagrams.dfd.examples' as type_id", f"{body} as body")
