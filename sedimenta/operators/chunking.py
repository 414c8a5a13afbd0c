"""Artifacts to chunks for retrieval. Pages with sections stand for concept and domain artifacts, turns for rules, orders for cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .extraction import SECTIONS_SQL, sections


def c01_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per element: a section's heading and text; a chunk of the file's name for pages without sections."""
    pages = table(spark, sf_dir, "pages")
    found = sections(pages).selectExpr("page_id", "concat('page_', page_id, '_elem_', pos) as chunk_id", "concat('DFD概念: ', heading, '\\n定义: ', text) as chunk", "'element' as chunk_type")
    # a heading is looked for with the pattern that cuts sections, so no join is needed
    bare = pages.where(F.expr("coalesce(not html rlike r'(?i)<h[1-3][ >]', true)"))
    stem = "concat('page_', page_id)"
    return found.unionByName(bare.selectExpr("page_id", f"concat({stem}, '_overview') as chunk_id", f"concat('知识文件: ', {stem}) as chunk", "'concept_overview' as chunk_type"))


def c03_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule chunk per turn: role as name, text as definition, severity info."""
    text = "concat_ws('\\n', concat('DFD规则: ', coalesce(role, '')), concat('规则ID: rule_', turn), concat('定义: ', coalesce(text, '')), '严重级别: info')"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "concat('conv_', conv_id, '_rule_', turn) as chunk_id", f"{text} as chunk", "'info' as severity")


def c02_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a case: an overview with its complexity, and one chunk per line with the flows into and out of it.

    A line's parts flow to the next line; lines of an order, a few each, are numbered by l_linenumber.
    """
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lag("l_partkey").over(by).alias("into"), F.lag("l_linenumber").over(by).alias("source"), F.lead("l_linenumber").over(by).alias("sink"))
    case = "concat('order_', l_orderkey)"
    detail = (
        f"concat_ws('\\n', concat('处理过程: ', l_linenumber, ' part ', l_partkey), concat('所属案例: ', {case}), concat('输入数据流: part ', into, ' (from ', source, ')'),"
        " if(sink is not null, concat('输出数据流: part ', l_partkey, ' (to ', sink, ')'), null))"
    )
    details = lines.selectExpr("l_orderkey as order_id", f"concat({case}, '_', l_linenumber) as chunk_id", f"{detail} as chunk", "'process_detail' as chunk_type", "cast(null as string) as complexity")
    cases = lines.groupBy("l_orderkey").agg(F.expr("transform(sort_array(collect_list(struct(l_linenumber, l_partkey))), x -> concat('part ', x.l_partkey))").alias("p"))
    overview = f"concat('DFD案例: ', {case}, '\\n描述: \\n处理过程: ', array_join(p, ', '))"
    total = "2 * size(p) - 1"
    tops = cases.selectExpr("l_orderkey as order_id", f"concat({case}, '_overview') as chunk_id", f"{overview} as chunk", "'case_overview' as chunk_type", f"case when {total} >= 50 then 'high' when {total} >= 25 then 'medium' else 'low' end as complexity")
    return tops.unionByName(details)


def c07_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as domains: an overview chunk of title and URL, and a term chunk per section."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.coalesce("url", F.lit("")).alias("name"))
    tops = pages.selectExpr("concat('page_', page_id, '_overview') as chunk_id", "concat('领域: ', name, '\\n描述: ', coalesce(regexp_extract(html, r'(?s)<title[^>]*>(.*?)</title>', 1), '')) as chunk", "'domain_overview' as chunk_type")
    terms = sections(pages).join(pages.select("page_id", "name"), "page_id")
    return tops.unionByName(terms.selectExpr("concat('page_', page_id, '_term_', pos) as chunk_id", "concat('领域术语: ', heading, '\\n领域: ', name, '\\n定义: ', text) as chunk", "'domain_term' as chunk_type"))


def a21_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and characters of each kind, and of all."""
    kinds = c01_concepts(spark, sf_dir).select("chunk_type", "chunk").unionByName(c07_domain(spark, sf_dir).select("chunk_type", "chunk"))
    return kinds.rollup("chunk_type").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


QUERIES = {q.__name__: q for q in (c01_concepts, c02_cases, c03_rules, c07_domain, a21_index_stats)}
_CHUNKS_SQL = SECTIONS_SQL + r""", c AS (SELECT page_id, 'page_' || page_id || '_elem_' || pos AS chunk_id, 'DFD概念: ' || heading || chr(10) || '定义: ' || text AS chunk, 'element' AS chunk_type FROM s
  UNION ALL SELECT page_id, 'page_' || page_id || '_overview', '知识文件: page_' || page_id, 'concept_overview' FROM pages WHERE coalesce(NOT regexp_matches(html, '(?i)<h[1-3][ >]'), true)),
  d AS (SELECT 'page_' || page_id || '_overview' AS chunk_id, '领域: ' || coalesce(url, '') || chr(10) || '描述: ' || coalesce(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS chunk, 'domain_overview' AS chunk_type FROM pages
  UNION ALL SELECT 'page_' || page_id || '_term_' || pos, '领域术语: ' || heading || chr(10) || '领域: ' || coalesce(url, '') || chr(10) || '定义: ' || text, 'domain_term' FROM s JOIN pages USING (page_id))"""
ORACLES = {
    "c01_concepts": _CHUNKS_SQL + " SELECT * FROM c",
    "c07_domain": _CHUNKS_SQL + " SELECT * FROM d",
    "a21_index_stats": _CHUNKS_SQL + ", a AS (SELECT chunk_type, chunk FROM c UNION ALL SELECT chunk_type, chunk FROM d) SELECT chunk_type, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM a GROUP BY ROLLUP (chunk_type)",
    "c03_rules": "SELECT conv_id, 'conv_' || conv_id || '_rule_' || turn AS chunk_id, 'DFD规则: ' || coalesce(role, '') || chr(10) || '规则ID: rule_' || turn || chr(10) || '定义: ' || coalesce(text, '') || chr(10) || '严重级别: info' AS chunk, 'info' AS severity FROM conversations",
    "c02_cases": """WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS n, l_partkey AS p, lag(l_partkey) OVER w AS i, lag(l_linenumber) OVER w AS a, lead(l_linenumber) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
      t AS (SELECT order_id, string_agg('part ' || p, ', ' ORDER BY n, p) AS ps, 2 * count(*) - 1 AS total FROM l GROUP BY 1)
      SELECT order_id, 'order_' || order_id || '_overview' AS chunk_id, 'DFD案例: order_' || order_id || chr(10) || '描述: ' || chr(10) || '处理过程: ' || ps AS chunk, 'case_overview' AS chunk_type,
        CASE WHEN total >= 50 THEN 'high' WHEN total >= 25 THEN 'medium' ELSE 'low' END AS complexity FROM t
      UNION ALL SELECT order_id, 'order_' || order_id || '_' || n, concat_ws(chr(10), '处理过程: ' || n || ' part ' || p, '所属案例: order_' || order_id, '输入数据流: part ' || i || ' (from ' || a || ')',
        CASE WHEN b IS NOT NULL THEN '输出数据流: part ' || p || ' (to ' || b || ')' END), 'process_detail', NULL FROM l""",
}
