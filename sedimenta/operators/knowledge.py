"""Knowledge of texts by rules: concepts with names, patterns, transformations, criteria, errors, checklists and templates.

All of it is expressions inside the JVM, most in the two dialects of `dialects` so that long rules need no
second telling. Texts are cleaned once, sentences are cut once. Null and empty texts hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialects import duck_sql, spark_sql
from ..functions.html import CLEAN_SQL, clean_text
from ..session import table
from .corpus import RELIABLE_SQL, reliability, valid_text
from .extraction import _JSON_LIKE, _MARKS, _URL_LINE, CLEANED, NOT_A_NAME, RULE_WORDS, SENTENCES, VALID_ITEM, once, rule_rows
from .signals import TAG_OR_ENTITY

#: Words that tell a definition, what follows a subject, endings that a name goes without: fixed values, in the order of the tests.
DEFINITIONS = ["定义", "概念", "是指", "指的是", "表示", "所谓", "即", "称为", "意思是", "代表", "包括", "包含", "用于", "通过", "可以", "需要"]
DEFINITION_ORDER = ["定义", "概念", "是指", "指的是", "表示", "所谓", "即", "称为", "概念", "定义", "是指", "指的是", "意思是", "表示", "代表", "包括", "包含", "用于", "通过", "可以", "需要"]
SUBJECT_ENDS = ["是", "为", "指", "表示", "代表", "包括", "用于"]
NAME_ENDS = ["的定义", "的区别", "的目标", "的原则", "的过程", "简介", "概述", "总结", "说明", "介绍"]
#: Words of patterns, words that no pattern's name holds, words of steps, criteria and errors: fixed values.
PATTERNS = [
    "模式", "模板", "格式", "结构", "框架", "样式", "方法", "流程", "步骤", "模型", "图", "表", "算法", "技术", "策略", "原则", "规范", "标准", "设计", "架构", "体系", "系统", "机制", "机理", "原理", "理论", "分析",
    "建模", "实现", "解决方案", "方案", "途径", "手段", "工具",
]
NO_PATTERN = ["未知", "通过", "基于", "进行", "实现", "完成", "处理", "分析", "设计", "一致性", "需求规格", "原型完善", "用户需求"]
STEPS = ["步骤", "阶段", "过程", "流程", "顺序"]
CRITERIA = ["标准", "指标", "准则", "要求", "规范"]
ERRORS = ["错误", "问题", "缺陷", "异常", "故障", "失败"]
#: Words of a template's concepts, rules, systems and cases: fixed values, in the order of the tests.
TEMPLATE = {
    "concepts": {"process": ["处理", "加工", "过程", "功能", "业务流程"], "entity": ["外部实体", "实体", "用户", "客户", "管理员"], "data_store": ["数据存储", "数据库", "文件", "存储"], "data_flow": ["数据流", "信息流", "数据传输"]},
    "rules": {"hierarchy": ["层次", "Level", "分层", "细化"], "connection": ["连接", "流向", "箭头", "数据流"], "naming": ["命名", "名称", "标识"]},
    "systems": {"电商系统": ["电商", "购物", "订单"], "管理信息系统": ["管理", "信息系统", "MIS"], "图书管理系统": ["图书", "借阅", "图书馆"]},
    "cases": {"error_case": ["错误", "问题", "注意", "避免", "不要", "禁止"], "best_practice": ["正确", "建议", "最佳", "推荐", "应该", "规范"]},
}
#: Concepts, patterns, transformations and checklist items of a text at most, and sentences that are looked at: fixed values.
MOST = {"concepts": (15, 8), "patterns": (8, 5), "transformations": (10, 5), "checklist": (0, 10)}

_NUMBER = r"^(第\s*[0-9]+[章节条]\s*|[一二三四五六七八九十百千]+[、.]\s*|[一二三四五六七八九十百千]+\s+|[0-9]+[、.]\s*|[0-9]+\s+)"
_EDGE = r"[、，。！？：；\s]+"
_list = lambda words: "@[" + ", ".join(f"'{w}'" for w in words) + "@]"


def _refined(name: str) -> str:
    out = f"regexp_replace(trim({name}), @'{_NUMBER}', ''@every)"
    for end in NAME_ENDS:
        out = f"regexp_replace({out}, @'{end}$', ''@every)"
    return f"substring(regexp_replace(regexp_replace({out}, @'^(..+)的$', '@1'@every), @'\\s+', ' '@every), 1, 20)"


def _valid_name(n: str) -> str:
    marks = f"(length({n}) - length(regexp_replace({n}, @'" + r"[{}\[\]\x22\x27:,;()（）【】]" + "', ''@every)))"
    return f"length(trim({n})) >= 2 AND length({n}) <= 50 AND NOT @like(trim({n}), @'{'|'.join(NOT_A_NAME)}') AND {marks} * 10 <= 3 * length({n})"


def _before(words: list[str], s: str) -> str:
    """Names before each word of a list that a sentence holds."""
    cut = f"regexp_replace(regexp_replace(trim(@before({s}, k, 1)), @'^{_EDGE}', ''@every), @'{_EDGE}$', ''@every)"
    return f"@map(@filter({_list(words)}, @lambda k@to contains({s}, k)), @lambda k@to {_refined(cut)})"


def concept_name(x: str) -> str:
    """Name of the concept that a sentence defines: what stands before a word of definition, else in brackets, in quotes, or before the verb; empty without a valid one."""
    s = f"regexp_replace({x}, @'{_NUMBER}', ''@every)"
    inside = [_refined(f"trim(regexp_extract({s}, @'{p}', 1))") for p in ("[（(]([^）)]+)[）)]", r"\x22([^\x22]+)\x22")]
    names = f"@both(@both({_before(DEFINITION_ORDER, s)}, @[{', '.join(inside)}@]), {_before(SUBJECT_ENDS, s)})"
    return _refined(f"@join(@take(@filter({names}, @lambda n@to {_valid_name('n')}), 1, 1), '')")


def clean_definition(x: str) -> str:
    """A sentence with single spaces, without the number before it or digits at its end, closed by a full stop."""
    out = f"regexp_replace(trim({x}), @'\\s+', ' '@every)"
    for p in (r"^[0-9]+[、.]?\s*", r"^[一二三四五六七八九十]+[、.]?\s*", r"^[第\s]*[0-9]+[章节步骤条]\s*[：:]\s*", r"[、。,，\s]*[0-9]+\s*$"):
        out = f"regexp_replace({out}, @'{p}', ''@every)"
    return f"regexp_replace({out}, @'([^。！？.!?])$', '@1。'@every)"


_ENUMERATED = "[一二三四五六七八九十][ \t]*[、，,]"
_PATTERN_SENTENCES = f"@filter(s, @lambda x@to NOT @like(x, @'{_ENUMERATED}'))"


def pattern_name(x: str) -> str:
    """Name of a pattern: what stands before the first word of patterns if it is short, else the three words after it, else the first two words."""
    c = f"regexp_replace({x}, @'^[一二三四五六七八九十]+[、，,]\\s*', ''@every)"
    words = lambda t, n: f"@join(@take(@split(trim({t}), @'\\s+'), 1, {n}), '')"
    after = words(f"substring({c}, instr({c}, k) + length(k))", 3)
    short = lambda t: f"length({t}) BETWEEN 1 AND 20"
    before = f"trim(@before({c}, k, 1))"
    each = f"@map(@filter({_list(PATTERNS)}, @lambda k@to contains({c}, k)), @lambda k@to CASE WHEN {short(before)} THEN {before} WHEN {short(after)} THEN {after} ELSE '' END)"
    first = f"@join(@take(@filter({each}, @lambda n@to n <> ''), 1, 1), '')"
    return f"coalesce(nullif({first}, ''), CASE WHEN {short(words(c, 2))} THEN {words(c, 2)} END, '通用模式')"


def valid_pattern_name(n: str) -> str:
    """P20: 2 to 20 characters without a word that tells nothing and without an enumeration."""
    return f"length({n}) BETWEEN 2 AND 20 AND NOT @like({n}, @'{'|'.join(NO_PATTERN)}|{_ENUMERATED}')"


#: P16 as a predicate of a line `l`.
JSON_LINE = _JSON_LIKE.format("l")
_STEP_SENTENCES = SENTENCES.replace("[.!?。！？\\n]", "[。！？\\n]").replace("|organic_results|search_metadata", "")
_MARKED = "({}) * 10 <= 3 * length({})".format(_MARKS.format("l"), "l")
_LINES = rf"@filter(@map(@split(t, @'[。！？]'), @lambda l@to trim(l)), @lambda l@to length(l) >= 5 AND NOT {JSON_LINE} AND NOT {_URL_LINE.format('l')} AND {_MARKED})"
_TIDY = r"trim(regexp_replace(regexp_replace(l, @'[{}\[\]\x22\x27]', ' '@every), @'\s+', ' '@every))"
_FLAT = f"@join(@filter(@map({_LINES}, @lambda l@to {_TIDY}), @lambda l@to length(l) > 5), ' ')"
#: Text with a line for each item of a numbered or marked list.
LISTED = rf"regexp_replace(regexp_replace({_FLAT}, @'([0-9]+[.、])', chr(10) || '@1'@every), @'([•·-]\s)', chr(10) || '@1'@every)"
_ITEM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(l), @'^[\x22\x27]|[\x22\x27]$', ''@every), @'[,，]\s*$', ''@every), @'^\s*[{\[\x22\x27]', ''@every), @'[}\]\x22\x27],?\s*$', ''@every))"
_FOUND = [r"[0-9]+[.、]\s*([^。！？\n]{5,100})", r"[•·-]\s*([^。！？\n]{5,100})", r"([0-9]+[.、][^。！？\n]{5,100})", r"([•·-][^。！？\n]{5,100})"]
_ALL = [f"regexp_extract_all(t, @'{p}', 1)" for p in _FOUND]
CHECKLIST = f"@take(@filter(@map(@both(@both({_ALL[0]}, {_ALL[1]}), @both({_ALL[2]}, {_ALL[3]})), @lambda l@to {_ITEM}), @lambda l@to {VALID_ITEM}), 1, 10)"


def _sentences(docs: DataFrame, cut: str = SENTENCES, *columns: str) -> DataFrame:
    """doc_id and s, the sentences that carry meaning of texts of 50 cleaned characters or more that are no JSON."""
    rows = docs.select("doc_id", *columns, once(CLEANED).alias("c")).where(F.expr(spark_sql("length(c) >= 50 AND NOT " + _JSON_LIKE.format("c"))))
    return rows.select("doc_id", *columns, once(cut).alias("s"))


def concepts(docs: DataFrame) -> DataFrame:
    """doc_id, concept_id, name and definition: of the first 15 sentences those of over 20 characters with a word of definition and a name, 8 at most."""
    looked, most = MOST["concepts"]
    made = f"transform(filter(slice(s, 1, {looked}), x -> length(x) > 20 and x rlike '{'|'.join(DEFINITIONS)}'), x -> struct({spark_sql(concept_name('x'))} as name, {spark_sql(clean_definition('x'))} as definition))"
    rows = _sentences(docs).where("size(s) >= 2").select("doc_id", F.explode(F.array(F.expr(made))).alias("a"))
    found = rows.select("doc_id", F.posexplode(F.expr(f"slice(filter(a, y -> length(trim(y.name)) >= 2), 1, {most})")).alias("pos", "c"))
    return found.select("doc_id", F.format_string("concept_%03d", F.col("pos") + 1).alias("concept_id"), "c.name", "c.definition")


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id, pattern_id, name and template: of the first 8 sentences without enumerations those of over 20 characters with a word of patterns and a valid name, 5 at most."""
    looked, most = MOST["patterns"]
    made = f"transform(filter(slice(s, 1, {looked}), x -> length(x) > 20 and x rlike '{'|'.join(PATTERNS)}'), x -> struct({spark_sql(pattern_name('x'))} as name, x as template))"
    rows = _sentences(docs).select("doc_id", once(_PATTERN_SENTENCES).alias("s")).where("size(s) >= 2").select("doc_id", F.explode(F.array(F.expr(made))).alias("a"))
    found = rows.select("doc_id", F.posexplode(F.expr(f"slice(filter(a, y -> {spark_sql(valid_pattern_name('y.name'))}), 1, {most})")).alias("pos", "c"))
    return found.select("doc_id", F.format_string("pattern_%03d", F.col("pos") + 1).alias("pattern_id"), "c.name", "c.template")


def transformations(docs: DataFrame, words: list[str] = STEPS) -> DataFrame:
    """doc_id, transformation_id, steps and first_step: a sentence of over 20 characters with a step's word starts a group that later sentences join (W02), among the first 10; 5 groups at most."""
    looked, most = MOST["transformations"]
    rows = _sentences(docs, _STEP_SENTENCES).where("size(s) >= 2").select("doc_id", F.posexplode(F.expr(f"slice(s, 1, {looked})")).alias("pos", "x"))
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begins = (F.length("x") > 20) & F.col("x").rlike("|".join(words))
    groups = rows.withColumn("n", F.sum(begins.cast("int")).over(by)).where(f"n between 1 and {most} and length(x) > 15")
    each = groups.groupBy("doc_id", "n").agg(F.count("*").alias("steps"), F.min_by("x", "pos").alias("first_step"))
    return each.select("doc_id", F.format_string("transform_%03d", F.col("n").cast("int")).alias("transformation_id"), "steps", "first_step")


def checklist(docs: DataFrame) -> DataFrame:
    """doc_id and items, the valid ones of numbered and marked lists of a text, 10 at most."""
    plain = docs.select("doc_id", F.explode(F.array(F.when(F.col("text").rlike(TAG_OR_ENTITY), clean_text("text")).otherwise(F.col("text")))).alias("t"))
    return plain.select("doc_id", once(LISTED).alias("t")).select("doc_id", once(CHECKLIST).alias("items"))


def with_words(text: str, words: list[str]) -> str:
    """SQL of the sentences of a raw text that hold any of the words (E08)."""
    return rf"@map(@filter(@split({text}, @'[。！？\n]'), @lambda x@to @like(x, @'{'|'.join(words)}')), @lambda x@to trim(x))"


def p16_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document look like JSON."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(spark_sql(_P16)).alias("json_lines"))


_P16 = rf"coalesce(@size(@filter(@split(text, @'\n'), @lambda l@to {JSON_LINE})), 0)"


def p20_pattern_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1).alias("t")
    return table(spark, sf_dir, "pages").select("page_id", title).select("page_id", F.expr(spark_sql(valid_pattern_name("t"))).alias("valid"))


def _per_document(docs: DataFrame, found: DataFrame, name: str, first: str, key: str) -> DataFrame:
    n = found.groupBy("doc_id").agg(F.count("*").alias(name), F.min_by(first, key).alias(f"first_{name}"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce(name, F.lit(0).cast("long")).alias(name), f"first_{name}")


def e03_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many concepts each document defines, and the first one's name (E04)."""
    docs = table(spark, sf_dir, "documents")
    return _per_document(docs, concepts(docs), "concepts", "name", "concept_id")


def e06_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _per_document(docs, patterns(docs), "patterns", "name", "pattern_id")


def e07_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _per_document(docs, transformations(docs), "transformations", "first_step", "transformation_id")


def e08_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with words of criteria and of errors, all of them, of the raw text."""
    return table(spark, sf_dir, "documents").select("doc_id", *(F.expr(spark_sql(f"@join({with_words('text', w)}, '|')")).alias(k) for k, w in (("criteria", CRITERIA), ("errors", ERRORS))))


def e09_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(F.array_join("items", "|"), F.lit("")).alias("items"))


def e13_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a template finds in a text: kinds of concepts and rules it has a word of, its system, and kinds of cases."""
    of = lambda kind: F.array_join(F.array_compact(F.array(*(F.when(F.col("text").rlike("|".join(w)), F.lit(k)) for k, w in TEMPLATE[kind].items()))), ",")
    system = F.coalesce(*(F.when(F.col("text").rlike("|".join(w)), F.lit(k)) for k, w in TEMPLATE["systems"].items()), F.lit("通用系统"))
    pattern = F.when(F.col("text").rlike("系统|流程|处理"), system)
    return table(spark, sf_dir, "documents").select("doc_id", of("concepts").alias("concepts"), of("rules").alias("rules"), pattern.alias("system"), of("cases").alias("cases"), F.when(F.col("text").rlike("用户|系统|操作|处理"), 2).otherwise(0).alias("mappings"))


def e14_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's Markdown report: title, source and counts of what the template found; the description stands for the content's analysis."""
    found = lambda kind: F.size(F.array_compact(F.array(*(F.when(F.col("html").rlike("|".join(w)), F.lit(k)) for k, w in TEMPLATE[kind].items()))))
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# 📚 DFD知识库提取结果："), title), F.concat(F.lit("> 来源：["), title, F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")  ")), F.lit(""), F.lit("## 📊 知识库统计"),
        F.concat(F.lit("- **概念定义**: "), found("concepts"), F.lit(" 个")), F.concat(F.lit("- **规则条目**: "), found("rules"), F.lit(" 个")), F.concat(F.lit("- **案例示例**: "), found("cases"), F.lit(" 个")),
    )
    return table(spark, sf_dir, "pages").select("page_id", lines.alias("markdown"))


def e12_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts and rules of the documents in the older format: id, type, description and the sentence as rule, as one table."""
    docs = table(spark, sf_dir, "documents")
    old = concepts(docs).selectExpr("doc_id", "replace(concept_id, 'concept_', 'dfd-') as id", "'concept' as type", "name as description")
    rules = rule_rows(docs, RULE_WORDS, 10, 6).selectExpr("doc_id", "replace(rule_id, 'rule_', 'ru-') as id", "'rule' as type", "action as description")
    n = old.unionByName(rules).groupBy("doc_id").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("items", F.lit(0).cast("long")).alias("items"), F.coalesce("ids", F.lit("")).alias("ids"))


def e01_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, reliability (0 of texts that are not valid) and whether a text is worth keeping."""
    rows = table(spark, sf_dir, "documents").select("doc_id", valid_text("text").alias("valid"), reliability("text").alias("r"))
    return rows.select("doc_id", "valid", F.when(F.col("valid"), F.col("r")).otherwise(0.0).alias("reliability"), (F.col("valid") & (F.col("r") >= 0.7)).alias("kept"))


QUERIES = {
    q.__name__: q
    for q in (p16_json_lines, p20_pattern_names, e01_knowledge, e03_concepts, e06_patterns, e07_transformations, e08_criteria, e09_checklist, e12_converted, e13_template, e14_rendered)
}
_C = f"WITH d AS (SELECT doc_id, {duck_sql(CLEANED)} AS c FROM documents), t AS (SELECT doc_id, c FROM d WHERE length(c) >= 50 AND NOT {duck_sql(_JSON_LIKE.format('c'))})"
_S = _C + f", s AS (SELECT doc_id, {duck_sql(SENTENCES)} AS s FROM t)"
_X = "unnest(list_slice(s, 1, {})) AS x, unnest(range(1, len(list_slice(s, 1, {})) + 1)) AS pos"
_CONCEPTS_SQL = _S + ", x AS (SELECT doc_id, " + _X.format(15, 15) + f""" FROM s WHERE len(s) >= 2), n AS (SELECT doc_id, pos, {duck_sql(concept_name('x'))} AS name FROM x
  WHERE length(x) > 20 AND regexp_matches(x, '定义|概念|是指|指的是|表示|所谓|即|称为|意思是|代表|包括|包含|用于|通过|可以|需要')),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM n WHERE length(trim(name)) >= 2 QUALIFY i <= 8)"""
_RULES_SQL = ", u AS (SELECT doc_id, list_filter(s[1:10], lambda x: length(x) > 20 AND regexp_matches(x, '规则|约束|限制|要求|必须|应该|应当|需要|不能|禁止|规定|条件|如果|当|则'))[1:6] AS u FROM (SELECT doc_id, s FROM s WHERE len(s) >= 2))"
_HAS = lambda c, pairs: "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{k}' END" for k, p in pairs) + ")"
_CONCEPT_KINDS = [("process", "处理|加工|过程|功能|业务流程"), ("entity", "外部实体|实体|用户|客户|管理员"), ("data_store", "数据存储|数据库|文件|存储"), ("data_flow", "数据流|信息流|数据传输")]
_RULE_KINDS = [("hierarchy", "层次|Level|分层|细化"), ("connection", "连接|流向|箭头|数据流"), ("naming", "命名|名称|标识")]
_CASE_KINDS = [("error_case", "错误|问题|注意|避免|不要|禁止"), ("best_practice", "正确|建议|最佳|推荐|应该|规范")]
_N = lambda pairs: "(" + " + ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN 1 ELSE 0 END" for _, p in pairs) + ")"
ORACLES = {
    "p16_json_lines": f"SELECT doc_id, CAST({duck_sql(_P16)} AS INTEGER) AS json_lines FROM documents",
    "p20_pattern_names": f"SELECT page_id, {duck_sql(valid_pattern_name('t'))} AS valid FROM (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)",
    "e01_knowledge": rf"""WITH v AS (SELECT doc_id, coalesce(length(text) >= 5 AND NOT contains(text, chr(0)) AND NOT contains(text, 'ÿ') AND NOT contains(text, 'þ')
      AND (regexp_matches(text, '\p{{L}}') OR length(regexp_replace(text, '[^\x09-\x0D\x20-\x7E\x{{80}}-\x{{10FFFF}}]', '', 'g')) * 2 >= length(text)), false) AS valid, {RELIABLE_SQL} AS r FROM documents)
      SELECT doc_id, valid, CASE WHEN valid THEN r ELSE 0.0::DOUBLE END AS reliability, valid AND r >= 0.7 AS kept FROM v""",
    "e03_concepts": _CONCEPTS_SQL + " SELECT d.doc_id, count(name) AS concepts, min(name) FILTER (i = 1) AS first_concepts FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1",
    "e06_patterns": _S + f", f AS (SELECT doc_id, {duck_sql(_PATTERN_SENTENCES)} AS s FROM s), x AS (SELECT doc_id, " + _X.format(8, 8) + f""" FROM f WHERE len(s) >= 2),
      n AS (SELECT doc_id, pos, {duck_sql(pattern_name('x'))} AS name FROM x WHERE length(x) > 20 AND regexp_matches(x, '模式|模板|格式|结构|框架|样式|方法|流程|步骤|模型|图|表|算法|技术|策略|原则|规范|标准|设计|架构|体系|系统|机制|机理|原理|理论|分析|建模|实现|方案|途径|手段|工具')),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM n WHERE {duck_sql(valid_pattern_name('name'))} QUALIFY i <= 5)
      SELECT d.doc_id, count(name) AS patterns, min(name) FILTER (i = 1) AS first_patterns FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""",
    "e07_transformations": _C + f", s AS (SELECT doc_id, {duck_sql(_STEP_SENTENCES)} AS s FROM t), x AS (SELECT doc_id, " + _X.format(10, 10) + """ FROM s WHERE len(s) >= 2),
      n AS (SELECT *, sum(CASE WHEN length(x) > 20 AND regexp_matches(x, '步骤|阶段|过程|流程|顺序') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM x),
      g AS (SELECT doc_id, n, arg_min(x, pos) AS f FROM n WHERE n BETWEEN 1 AND 5 AND length(x) > 15 GROUP BY 1, 2)
      SELECT d.doc_id, count(n) AS transformations, arg_min(f, n) AS first_transformations FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1""",
    "e08_criteria": r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[。！？\n]') AS s FROM documents)
      SELECT doc_id, array_to_string(list_transform(list_filter(s, lambda x: regexp_matches(x, '标准|指标|准则|要求|规范')), lambda x: trim(x)), '|') AS criteria,
        array_to_string(list_transform(list_filter(s, lambda x: regexp_matches(x, '错误|问题|缺陷|异常|故障|失败')), lambda x: trim(x)), '|') AS errors FROM s""",
    "e09_checklist": f"""WITH p AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{TAG_OR_ENTITY}') THEN {CLEAN_SQL.replace('html', 'text')} ELSE text END AS t FROM documents), l AS (SELECT doc_id, {duck_sql(LISTED)} AS t FROM p)
      SELECT doc_id, coalesce(array_to_string({duck_sql(CHECKLIST)}, '|'), '') AS items FROM l""",
    "e12_converted": _CONCEPTS_SQL + _RULES_SQL + """, o AS (SELECT doc_id, printf('dfd-%03d', i) AS id FROM k UNION ALL SELECT doc_id, printf('ru-%03d', unnest(range(1, len(u) + 1))) FROM u)
      SELECT d.doc_id, count(id) AS items, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM documents d LEFT JOIN o USING (doc_id) GROUP BY 1""",
    "e13_template": f"""SELECT doc_id, {_HAS('text', _CONCEPT_KINDS)} AS concepts, {_HAS('text', _RULE_KINDS)} AS rules, CASE WHEN regexp_matches(text, '系统|流程|处理') THEN CASE WHEN regexp_matches(text, '电商|购物|订单') THEN '电商系统'
      WHEN regexp_matches(text, '管理|信息系统|MIS') THEN '管理信息系统' WHEN regexp_matches(text, '图书|借阅|图书馆') THEN '图书管理系统' ELSE '通用系统' END END AS system, {_HAS('text', _CASE_KINDS)} AS cases,
      CASE WHEN regexp_matches(text, '用户|系统|操作|处理') THEN 2 ELSE 0 END AS mappings FROM documents""",
    "e14_rendered": f"""WITH t AS (SELECT page_id, coalesce(url, '') AS url, html, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)
      SELECT page_id, concat_ws(chr(10), '# 📚 DFD知识库提取结果：' || title, '> 来源：[' || title || '](' || url || ')  ', '', '## 📊 知识库统计', '- **概念定义**: ' || {_N(_CONCEPT_KINDS)} || ' 个', '- **规则条目**: ' || {_N(_RULE_KINDS)} || ' 个', '- **案例示例**: ' || {_N(_CASE_KINDS)} || ' 个') AS markdown FROM t""",
}
