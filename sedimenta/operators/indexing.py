"""Index building: types by file name and path, chunks of artifacts of every type, texts for embedding and for prompts.

A body is JSON; lists that are missing or no lists are empty, items that are no objects are left out, null
fields count as missing. Chunks are array expressions inside the JVM, one row per artifact until they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import CLEAN_SQL, clean_text
from ..session import table
from ..sources.pages import CONCEPTS_SQL, artifacts
from .extraction import SECTIONS_SQL, sections
from .structure import TYPE_COLLECTIONS

#: Type of a file by the start of its name, and by a folder of its path, in the order of the tests; strategies by a word of the type; fields of an overview and of texts for embedding. Fixed values.
NAME_PREFIXES = {
    "dfd_concepts": "diagrams.dfd.concepts", "dfd_rules": "diagrams.dfd.rules", "dfd_examples": "diagrams.dfd.examples", "dfd_templates": "diagrams.dfd.templates", "dfd_validation": "diagrams.dfd.validation",
    "dfd_levels": "diagrams.dfd.levels", "theory": "theory", "mappings": "mappings", "schema": "schema", "domain": "domain", "examples": "examples", "rules": "rules",
}
FOLDERS = {
    "concepts": "diagrams.dfd.concepts", "examples": "diagrams.dfd.examples", "rules": "diagrams.dfd.rules", "templates": "diagrams.dfd.templates", "validation": "diagrams.dfd.validation",
    "levels": "diagrams.dfd.levels", "theory": "theory", "domain": "domain", "mappings": "mappings", "schema": "schema",
}
OVERVIEW_FIELDS = ["description", "name", "title", "content_slug", "case_name"]
ROOT_FIELDS = ["description", "definition", "content_slug", "name", "title"]
LIST_FIELDS = ["elements", "rules", "concepts", "principles", "scenarios", "validation_rules"]
ITEM_FIELDS = ["name", "definition", "detail", "description"]
#: Bounds of texts for embedding, of a router's summary and of a preselector's content, and what marks a cut: fixed values.
EMBEDDED, SUMMARY, PRESELECTED = 8000, 8000, 12000
CUT = "\n\n[...内容已截断...]"


def type_by_name(name: Column) -> Column:
    """Type of a file by the first prefix that fits; null without one."""
    return F.coalesce(*(F.when(F.startswith(name, F.lit(p)), F.lit(t)) for p, t in NAME_PREFIXES.items()))


def type_by_path(path: Column) -> Column:
    """Type of a file by the first known folder of its path; `unknown` without one."""
    parts = F.split(path, "/")
    return F.coalesce(*(F.when(F.array_contains(parts, k), F.lit(t)) for k, t in FOLDERS.items()), F.lit("unknown"))


#: Lists of a body that hold what becomes chunks, and those of a case.
_LISTS = ["rules", "validation_rules", "modeling_rules", "elements", "categories", "leveling_principles", "decomposition_rules", "concepts", "principles", "terms"]
_CASE_LISTS = ["external_entities", "processes", "data_stores", "data_flows"]
#: All that chunks read of a body, as the schema of its one parse; items stay JSON until they have rows of their own.
_BODY = ", ".join([*(f"{k} string" for k in OVERVIEW_FIELDS), *(f"{k} array<string>" for k in ["requirements_text", *_LISTS]), f"dfd_elements struct<{', '.join(f'{k}: array<string>' for k in _CASE_LISTS)}>"])
_FLOWS = "array<struct<`from`:string,`to`:string,data:string>>"


def _objects(items: str) -> str:
    """SQL of the objects of a list of JSON texts."""
    return f"filter(coalesce({items}, array()), x -> startswith(x, '{{'))"


def _let(value: str, name: str, body: str) -> str:
    """SQL of body in which `name` stands for value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _piece(kind: str, i: str = "0", item: str = "null", outer: str = "null", flows: str = "null") -> str:
    """SQL of what becomes one chunk: its kind, its number in its list, its item, a text of what it lies in (an overview: its own text), a process's flows."""
    return f"named_struct('kind', '{kind}', 'i', {i}, 'item', cast({item} as string), 'outer', cast({outer} as string), 'flows', cast({flows} as {_FLOWS}))"


def _pieces(items: str, kind: str, outer: str = "null", flows: str = "null") -> str:
    return f"transform({items}, (x, i) -> {_piece(kind, 'i', 'x', outer, flows)})"


def _overview(kind: str) -> str:
    fields = ", ".join(f"concat('{k}: ', nullif(b.{k}, ''))" for k in OVERVIEW_FIELDS)
    return f"array({_piece(kind + '_overview', outer=f"coalesce(nullif(concat_ws('\\n', {fields}), ''), concat('知识文件: ', stem))")})"


def _or_overview(pieces: str, kind: str) -> str:
    return _let(pieces, "made", f"if(size(made) > 0, made, {_overview(kind)})")


def _strategies() -> dict[str, str]:
    """SQL of the pieces of a parsed body, for each word that a type may hold, in the order of the tests."""
    two = lambda a, b: f"concat({a}, {b})"
    first = "coalesce(" + ", ".join(_let(_objects(f"b.{k}"), "ms", "if(size(ms) > 0, ms, null)") for k in ("rules", "validation_rules", "modeling_rules")) + ", array())"
    rules = _or_overview(_pieces(first, "rule"), "rule")
    inner = _let("from_json(c, 'name string, templates array<string>')", "p", _pieces(_objects("p.templates"), "template", "coalesce(p.name, '')"))
    templates = _let(_objects("b.categories"), "cs", f"if(size(cs) > 0, flatten(transform(cs, c -> {inner})), {_overview('template')})")
    levels = two(_pieces(_objects("b.leveling_principles"), "leveling_principle"), _pieces(_objects("b.decomposition_rules"), "decomposition_rule"))
    theory = two(_pieces(_objects("b.concepts"), "theory_concept"), _pieces(_objects("b.principles"), "theory_principle"))
    name = "coalesce(b.name, stem)"
    domain = two(f"array({_piece('domain_overview', outer=f"concat('领域: ', {name}, '\\n描述: ', coalesce(b.description, ''))")})", _pieces(_objects("b.terms"), "domain_term", name))
    case = "coalesce(b.case_name, stem)"
    names = lambda k, label: f"concat('{label}: ', nullif(array_join(transform({_objects('b.dfd_elements.' + k)}, x -> coalesce(from_json(x, 'name string').name, '')), ', '), ''))"
    needs = "concat('需求: ', nullif(array_join(slice(b.requirements_text, 1, 5), '; '), ''))"
    seen = f"concat_ws('\\n', concat('DFD案例: ', {case}), concat('描述: ', coalesce(b.description, '')), {needs}, {names('external_entities', '外部实体')}, {names('processes', '处理过程')}, {names('data_stores', '数据存储')})"
    flows = f"transform({_objects('b.dfd_elements.data_flows')}, x -> from_json(x, '`from` string, `to` string, data string'))"
    examples = two(f"array({_piece('case_overview', outer=seen)})", _let(flows, "fs", _pieces(_objects("b.dfd_elements.processes"), "process_detail", case, "fs")))
    return {
        "concepts": _or_overview(_pieces(_objects("b.elements"), "element"), "concept"), "examples": examples, "rules": rules, "templates": templates, "levels": _or_overview(levels, "levels"),
        "theory": _or_overview(theory, "theory"), "domain": domain, "validation": rules,
    }


def _or(field: str, default: str = "''") -> str:
    return f"coalesce(m['{field}'], {default})"


def _texts(field: str, by: str) -> str:
    """SQL of a list's texts joined, null if there are none."""
    return f"nullif(array_join(from_json(m['{field}'], 'array<string>'), '{by}'), '')"


def _flow(end: str, other: str) -> str:
    """SQL of the flows of a process that have it at `end`, as data and their other end."""
    return f"nullif(array_join(transform(filter(flows, f -> f.`{end}` = {_or('id')}), f -> concat(coalesce(f.data, ''), ' ({other} ', coalesce(f.`{other}`, ''), ')')), '; '), '')"


def _renderings() -> dict[str, tuple[str, list[str]]]:
    """For each kind of item: SQL of the end of its id, and of its lines (null ones are left out)."""
    numbered = lambda prefix: _or("id", f"concat('{prefix}_', i)")
    definition = f"concat('定义: ', {_or('definition')})"
    return {
        "element": (numbered("elem"), [f"concat('DFD概念: ', {_or('name')})", definition, "concat('命名规范: ', nullif(m['naming'], ''))", f"concat('特征: ', {_texts('properties', '; ')})", f"concat('示例: ', {_texts('examples', ', ')})"]),
        "rule": (numbered("rule"), [f"concat('DFD规则: ', {_or('name')})", f"concat('规则ID: ', {numbered('rule')})", "concat('定义: ', coalesce(m['definition'], m['detail'], ''))", "concat('严重级别: ', coalesce(m['severity'], m['level'], 'info'))", "concat('检测逻辑: ', nullif(m['detect_logic'], ''))"]),
        "template": (_or("id"), [f"concat('DFD模板: ', {_or('name')})", "concat('分类: ', outer)", f"concat('DFD层级: Level-', {_or('dfd_level', "'0'")})", f"concat('模式类型: ', {_or('pattern_type')})", f"concat('适用场景: ', {_texts('applicable_scenarios', '; ')})", f"concat('说明: ', {_texts('notes', '; ')})"]),
        "leveling_principle": (numbered("p"), [f"concat('DFD分层原则: ', {numbered('p')})", f"concat('描述: ', {_or('description')})"]),
        "decomposition_rule": (numbered("r"), [f"concat('DFD分解规则: ', {numbered('r')})", f"concat('描述: ', {_or('description')})"]),
        "theory_concept": (numbered("c"), [f"concat('软件工程概念: ', {_or('name')})", definition]),
        "theory_principle": (numbered("p"), [f"concat('软件工程原则: ', {numbered('p')})", f"concat('详情: ', {_or('detail')})"]),
        "domain_term": ("concat('term_', i)", [f"concat('领域术语: ', {_or('term')})", "concat('领域: ', outer)", definition]),
        "process_detail": (_or("id"), [f"concat('处理过程: ', {_or('id')}, ' ', {_or('name')})", "concat('所属案例: ', outer)", f"concat('输入数据流: ', {_flow('to', 'from')})", f"concat('输出数据流: ', {_flow('from', 'to')})"]),
    }


def chunks(rows: DataFrame) -> DataFrame:
    """chunk_id, text, chunk_type and type_id of artifacts(type_id, stem, body), by the strategy of their type; others give an overview.

    A body is parsed once, into lists of JSON items; each item gets a row and is parsed once there.
    """
    parsed = rows.select("type_id", "stem", F.explode(F.array(F.from_json("body", _BODY))).alias("b"))
    when = " ".join(f"when contains(lower(type_id), '{k}') then {sql}" for k, sql in _strategies().items())
    pieces = parsed.select("type_id", "stem", F.explode(F.expr(f"case {when} else {_overview('generic')} end")).alias("e")).select("type_id", "stem", "e.*")
    items = pieces.withColumn("m", F.explode(F.array(F.from_json("item", "map<string,string>")))).where("m is not null or item is null")
    kinds = _renderings()
    ends = " ".join(f"when '{kind}' then {end}" for kind, (end, _) in kinds.items())
    texts = " ".join(f"when '{kind}' then concat_ws('\\n', {', '.join(lines)})" for kind, (_, lines) in kinds.items())
    return items.select(F.expr(f"concat(stem, '_', case kind {ends} else 'overview' end)").alias("chunk_id"), F.expr(f"case kind {texts} else outer end").alias("text"), F.col("kind").alias("chunk_type"), "type_id")


def embedding_text(body: str) -> Column:
    """Text of an artifact for embedding: five root fields, then of the first ten items of six lists four fields each (or the item, if it is a text), 8000 characters at most."""
    root = ", ".join(f"nullif(get_json_object({body}, '$.{k}'), '')" for k in ROOT_FIELDS)
    fields = ", ".join(f"nullif(get_json_object(x, '$.{k}'), '')" for k in ITEM_FIELDS)
    item = f"if(startswith(x, '{{'), nullif(concat_ws(' ', {fields}), ''), x)"
    lists = ", ".join(f"nullif(array_join(filter(transform(slice(coalesce(from_json(get_json_object({body}, '$.{k}'), 'array<string>'), array()), 1, 10), x -> {item}), x -> x is not null), ' '), '')" for k in LIST_FIELDS)
    return F.expr(f"substring(concat_ws(' ', {root}, {lists}), 1, {EMBEDDED})")


def prompt_content(parts: Column, limit: int) -> Column:
    """Parts joined by empty lines up to a bound, which the part that passes it ends; what is cut off is marked."""
    whole = F.array_join(parts, "\n\n")
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit), F.lit(CUT))).otherwise(whole)


def _section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and its sections in order; pages without any have an empty list."""
    pages = table(spark, sf_dir, "pages")
    own = sections(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "heading", "text"))).alias("s"))
    return pages.select("page_id").join(own, "page_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<pos:int,level:int,heading:string,text:string>>")))


def p08_router_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and 300 characters of each section of a page, until what was added last brings the count over 8000."""
    part = "concat_ws('\\n\\n', concat('## ', nullif(x.heading, '')), nullif(substring(x.text, 1, 300), ''))"
    size = "length(case when x.text <> '' then substring(x.text, 1, 300) when x.heading <> '' then concat('## ', x.heading) else '' end)"
    before = f"aggregate(slice(s, 1, i), 0, (n, x) -> n + {size})"
    kept = f"filter(transform(filter(transform(s, (x, i) -> struct(x as x, {before} as n)), y -> y.n <= {SUMMARY}), y -> {part.replace('x.', 'y.x.')}), p -> p <> '')"
    return _section_parts(spark, sf_dir).select("page_id", prompt_content(F.expr(kept), SUMMARY).alias("summary"))


def p09_preselector_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with as many # as their level and whole texts of a page, 12000 characters at most."""
    part = "concat_ws('\\n', concat(repeat('#', x.level), ' ', nullif(x.heading, '')), nullif(x.text, ''))"
    return _section_parts(spark, sf_dir).select("page_id", prompt_content(F.expr(f"transform(s, x -> {part})"), PRESELECTED).alias("content"))


def p07_extraction_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a page as ## heading and text, else its plain text."""
    part = "concat_ws('\\n', concat('## ', nullif(x.heading, ''), '\\n'), nullif(x.text, ''), '')"
    rows = _section_parts(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", clean_text().alias("plain")), "page_id")
    return rows.select("page_id", F.expr(f"if(size(s) > 0, array_join(transform(s, x -> {part}), '\\n'), plain)").alias("content"))


def p06_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts(spark, sf_dir).where("type_id in ('diagrams.dfd.concepts', 'theory')")
    return rows.select("type_id", "seq", embedding_text("body").alias("text"))


def p26_type_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files named after each page's folder and number."""
    name = "concat(case page_id % 5 when 0 then 'dfd_rules_' when 1 then 'theory-' when 2 then 'rules' when 3 then 'domain_x' else 'other_dfd_rules' end, page_id, '.json')"
    return table(spark, sf_dir, "pages").select("page_id", F.expr(name).alias("name")).select("page_id", type_by_name(F.col("name")).alias("type_id"))


def p27_type_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files in folders of the page's number; the first known folder of the fixed order counts."""
    path = "concat('kb/', case page_id % 5 when 0 then 'domain/concepts' when 1 then 'theory' when 2 then 'rulesets' when 3 then 'levels/validation' else 'mappings' end, '/', page_id, '.json')"
    return table(spark, sf_dir, "pages").select("page_id", type_by_path(F.expr(path)).alias("type_id"))


def _chunked(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    rows = artifacts(spark, sf_dir).where(F.col("type_id").isin(*types)) if types else artifacts(spark, sf_dir)
    return chunks(rows.withColumn("stem", F.concat_ws("_", F.substring_index("type_id", ".", -1), "seq")))


def c01_concept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "diagrams.dfd.concepts").drop("type_id")


def c02_case_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview and processes of cases, each process with the flows to and from it (J08)."""
    return _chunked(spark, sf_dir, "diagrams.dfd.examples").drop("type_id")


def c04_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "diagrams.dfd.templates").drop("type_id")


def c05_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "diagrams.dfd.levels").drop("type_id")


def c06_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "theory").drop("type_id")


def c08_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "diagrams.dfd.validation").drop("type_id")


def c09_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of types without a strategy."""
    return _chunked(spark, sf_dir, "schema", "mappings").drop("type_id")


def c11_full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All artifacts chunked into the collection of their type (C10); chunks and characters of each collection and of all (A21, X05)."""
    where = F.create_map(*(F.lit(x) for pair in TYPE_COLLECTIONS.items() for x in pair))
    rows = _chunked(spark, sf_dir).withColumn("collection", where[F.col("type_id")])
    return rows.where("collection is not null").rollup("collection").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


QUERIES = {
    q.__name__: q
    for q in (p06_embedding_text, p07_extraction_content, p08_router_summary, p09_preselector_content, p26_type_by_name, p27_type_by_path, c01_concept_chunks, c02_case_chunks, c04_templates, c05_levels, c06_theory, c08_validation, c09_generic, c11_full_index)
}
_CHUNKS = "WITH " + CONCEPTS_SQL + """, e AS (SELECT seq, unnest(ids) AS id, unnest(names) AS name FROM a), n AS (SELECT chr(10) AS n),
  c01 AS (SELECT 'concepts_' || seq || '_' || id AS chunk_id, 'DFD概念: ' || name || n || '定义: about ' || name AS text, 'element' AS chunk_type FROM e, n
    UNION ALL SELECT 'concepts_' || seq || '_overview', CASE WHEN description <> '' THEN 'description: ' || description || n ELSE '' END || 'content_slug: page_' || seq, 'concept_overview' FROM a, n WHERE len(ids) = 0),
  c02 AS (SELECT 'examples_' || (l_orderkey * 10 + l_linenumber) || '_overview' AS chunk_id, 'DFD案例: case_' || l_orderkey || '_' || l_linenumber || n || '描述: ' || l_returnflag || n || '需求: ship ' || l_linestatus || '; on time' || n || '外部实体: supplier ' || l_suppkey || n || '处理过程: part ' || l_partkey AS text, 'case_overview' AS chunk_type FROM lineitem, n
    UNION ALL SELECT 'examples_' || (l_orderkey * 10 + l_linenumber) || '_p' || l_partkey, '处理过程: p' || l_partkey || ' part ' || l_partkey || n || '所属案例: case_' || l_orderkey || '_' || l_linenumber || n || '输入数据流: ' || l_quantity || ' (from s' || l_suppkey || ')' || n || '输出数据流:  (to buyer)', 'process_detail' FROM lineitem, n),
  c03 AS (SELECT 'rules_' || (conv_id * 1000 + turn) || '_rule_' || turn AS chunk_id, 'DFD规则: ' || coalesce(role, '') || n || '规则ID: rule_' || turn || n || '定义: ' || coalesce(text, '') || n || '严重级别: ' || CASE WHEN turn % 2 = 0 THEN 'warning' ELSE 'info' END AS text, 'rule' AS chunk_type FROM conversations, n),
  c04 AS (SELECT 'templates_' || p_partkey || '_t_' || p_partkey AS chunk_id, 'DFD模板: ' || p_name || n || '分类: ' || p_brand || n || 'DFD层级: Level-' || p_size % 4 || n || '模式类型: ' || p_type || n || '适用场景: ' || p_type || '; any' AS text, 'template' AS chunk_type FROM part, n),
  c05 AS (SELECT 'levels_' || s_suppkey || '_p_' || s_suppkey AS chunk_id, 'DFD分层原则: p_' || s_suppkey || n || '描述: ' || s_name AS text, 'leveling_principle' AS chunk_type FROM supplier, n
    UNION ALL SELECT 'levels_' || s_suppkey || '_n_' || s_nationkey, 'DFD分解规则: n_' || s_nationkey || n || '描述: ', 'decomposition_rule' FROM supplier, n),
  c06 AS (SELECT 'theory_' || doc_id || '_c_' || doc_id AS chunk_id, '软件工程概念: ' || lang || n || '定义: ' || text AS text, 'theory_concept' AS chunk_type FROM documents, n
    UNION ALL SELECT 'theory_' || doc_id || '_' || source, '软件工程原则: ' || source || n || '详情: from ' || source, 'theory_principle' FROM documents, n),
  c07 AS (SELECT 'domain_' || c_custkey || '_overview' AS chunk_id, '领域: ' || c_name || n || '描述: ' || c_mktsegment AS text, 'domain_overview' AS chunk_type FROM customer, n
    UNION ALL SELECT 'domain_' || c_custkey || '_term_0', '领域术语: ' || c_mktsegment || n || '领域: ' || c_name || n || '定义: ', 'domain_term' FROM customer, n),
  c08 AS (SELECT 'validation_' || page_id || '_v_' || page_id AS chunk_id, 'DFD规则: ' || n || '规则ID: v_' || page_id || n || '定义: ' || url || n || '严重级别: error' AS text, 'rule' AS chunk_type FROM pages, n),
  c09 AS (SELECT 'schema_' || doc_id || '_overview' AS chunk_id, 'title: schema of ' || doc_id AS text, 'generic_overview' AS chunk_type FROM labels UNION ALL SELECT 'mappings_' || n_nationkey || '_overview', '知识文件: mappings_' || n_nationkey, 'generic_overview' FROM nation)"""
_PARTS = SECTIONS_SQL + """, g AS (SELECT page_id, list({'pos': pos, 'level': level, 'heading': heading, 'text': text} ORDER BY pos) AS s FROM s GROUP BY 1), q AS (SELECT page_id, coalesce(s, []) AS s, html FROM pages LEFT JOIN g USING (page_id)),
  cut AS (SELECT chr(10) || chr(10) || '[...内容已截断...]' AS mark)"""
ORACLES = {
    "p06_embedding_text": "WITH " + CONCEPTS_SQL + """ SELECT 'diagrams.dfd.concepts' AS type_id, seq, concat_ws(' ', nullif(description, ''), 'page_' || seq, nullif(array_to_string(list_transform(names[1:10], lambda x: concat_ws(' ', nullif(x, ''), 'about ' || x)), ' '), ''))[1:8000] AS text FROM a
      UNION ALL SELECT 'theory', doc_id, concat_ws(' ', nullif(lang, ''), nullif(text, ''), 'from ' || source)[1:8000] FROM documents""",
    "p07_extraction_content": _PARTS + f""" SELECT page_id, CASE WHEN len(s) > 0 THEN array_to_string(list_transform(s, lambda x: concat_ws(chr(10), '## ' || nullif(x.heading, '') || chr(10), nullif(x.text, ''), '')), chr(10)) ELSE {CLEAN_SQL} END AS content FROM q""",
    "p08_router_summary": _PARTS + """, f AS (SELECT page_id, list_transform(s, lambda x, i: {'p': concat_ws(chr(10) || chr(10), '## ' || nullif(x.heading, ''), nullif(x.text[1:300], '')), 'n': coalesce(list_sum(list_transform(s[1:i - 1], lambda y: length(CASE WHEN y.text <> '' THEN y.text[1:300] WHEN y.heading <> '' THEN '## ' || y.heading ELSE '' END))), 0)}) AS f FROM q),
      w AS (SELECT page_id, coalesce(array_to_string(list_filter(list_transform(list_filter(f, lambda y: y.n <= 8000), lambda y: y.p), lambda p: p <> ''), chr(10) || chr(10)), '') AS w FROM f)
      SELECT page_id, CASE WHEN length(w) > 8000 THEN w[1:8000] || mark ELSE w END AS summary FROM w, cut""",
    "p09_preselector_content": _PARTS + """, w AS (SELECT page_id, coalesce(array_to_string(list_transform(s, lambda x: concat_ws(chr(10), repeat('#', x.level) || ' ' || nullif(x.heading, ''), nullif(x.text, ''))), chr(10) || chr(10)), '') AS w FROM q)
      SELECT page_id, CASE WHEN length(w) > 12000 THEN w[1:12000] || mark ELSE w END AS content FROM w, cut""",
    "p26_type_by_name": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'diagrams.dfd.rules' WHEN 1 THEN 'theory' WHEN 2 THEN 'rules' WHEN 3 THEN 'domain' END AS type_id FROM pages",
    "p27_type_by_path": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'diagrams.dfd.concepts' WHEN 1 THEN 'theory' WHEN 2 THEN 'unknown' WHEN 3 THEN 'diagrams.dfd.validation' ELSE 'mappings' END AS type_id FROM pages",
    **{q: _CHUNKS + f" SELECT * FROM {c}" for q, c in (("c01_concept_chunks", "c01"), ("c02_case_chunks", "c02"), ("c04_templates", "c04"), ("c05_levels", "c05"), ("c06_theory", "c06"), ("c08_validation", "c08"), ("c09_generic", "c09"))},
    "c11_full_index": _CHUNKS + """, i AS (SELECT 'se_kb_dfd_concepts' AS collection, text FROM c01 UNION ALL SELECT 'se_kb_dfd_examples', text FROM c02 UNION ALL SELECT 'se_kb_dfd_rules', text FROM c03 UNION ALL SELECT 'se_kb_dfd_rules', text FROM c08
      UNION ALL SELECT 'se_kb_dfd_templates', text FROM c04 UNION ALL SELECT 'se_kb_dfd_levels', text FROM c05 UNION ALL SELECT 'se_kb_theory', text FROM c06 UNION ALL SELECT 'se_kb_theory', text FROM c09 UNION ALL SELECT 'se_kb_domain', text FROM c07)
      SELECT collection, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM i GROUP BY ROLLUP (collection)""",
}
