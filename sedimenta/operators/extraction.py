"""Rule-based extraction from texts: cleaning, meaningful sentences, rules, names, list items, image and file names, page metrics.

A null text stays null when cleaned and has no sentences and no rules; a null name or item is null, a null URL no image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialects import duck_sql, spark_sql
from ..functions.html import CLEAN_SQL, DYNAMIC_SQL, clean_text, is_dynamic
from ..functions.urls import domain
from ..session import table

#: Words, patterns and limits of the extraction rules, fixed values.
RULE_WORDS = ["规则", "约束", "限制", "要求", "必须", "应该", "应当", "需要", "不能", "禁止", "规定", "条件", "如果", "当", "则"]
WEB_WORDS = ["http", "www.", "redirect_link", "displayed_link", "favicon", "snippet_highlighted_words", "organic_results", "search_metadata"]
FIELD_WORDS = ["position", "title", "link", "redirect_link", "displayed_link", "favicon", "date", "snippet", "snippet_highlighted_words", "source", "search_metadata", "search_parameters", "organic_results", "pagination"]
NOT_A_NAME = [
    "^[0-9]+[、.]", r"^[0-9]+\s", "^[一二三四五六七八九十百千]+[、.]", r"^[一二三四五六七八九十百千]+\s", "https?://", r"www\.",
    r"^[第\s]*[0-9]+[章节步骤]", r"^\s*[（(].*[）)]\s*$", r"^\s*\x22 .* \x22\s*$",
]
NOT_AN_ITEM = ["^[0-9]+$", "^[a-zA-Z]+$", r"^[{}\[\]\x22\x27]+$", "json", "redirect_link", "favicon", "snippet_highlighted_words"]
IMAGE_ENDS = ["jpg", "jpeg", "png", "gif", "webp", "svg"]
IMAGE_WORDS = ["image", "img", "photo", "pic"]
NOT_CONTENT = ["logo", "icon", "avatar", "ad", "ads", "spacer", "blank", "tracker"]
DOMAINS = {
    "blog.csdn.net": "csdn", "www.csdn.net": "csdn", "zhuanlan.zhihu.com": "zhihu", "www.zhihu.com": "zhihu", "www.jianshu.com": "jianshu",
    "juejin.cn": "juejin", "www.cnblogs.com": "cnblogs", "segmentfault.com": "segfault", "www.oschina.net": "oschina", "mp.weixin.qq.com": "wechat",
    "www.infoq.cn": "infoq", "xie.infoq.cn": "infoq", "www.visual-paradigm.com": "vp", "boardmix.cn": "boardmix", "www.processon.com": "processon",
    "www.finebi.com": "finebi", "jingyan.baidu.com": "baidu", "www.feishu.cn": "feishu", "www.w3cschool.cn": "w3c", "www.runoob.com": "runoob",
}
MAIN_SELECTORS = [r"<article[ >]", r"<main[ >]", r"id=\x22content\x22", r"class=\x22([^\x22]* )?post[ \x22]", r"class=\x22([^\x22]* )?article[ \x22]", r"class=\x22([^\x22]* )?content[ \x22]", r"role=\x22main\x22", r"class=\x22([^\x22]* )?entry-content[ \x22]", r"id=\x22content_views\x22"]
INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}\x{FE0F}]"

_JSON_LIKE = r"@like(trim({0}), @'^\x22(.*\x22,?)?$|\x22: \x22|^[{{}}\[\],]$|^[0-9]+$')"
_URL_LINE = r"((@like({0}, @'^(https?://|ftp://|www\.)') AND length({0}) < 200 AND length({0}) - length(replace({0}, ' ', '')) < 3) OR (length({0}) < 100 AND (" + " + ".join(
    f"CASE WHEN contains({{0}}, '{x}') THEN 1 ELSE 0 END" for x in ("http://", "https://", "www.", ".com", ".net", ".org", ".cn")
) + ") >= 2))"
_MARKS = r"(length({0}) - length(regexp_replace({0}, @'[{{}}\[\]\x22\x27:,;]', ''@every)))"
_LINES = (
    r"@filter(@map(@split(text, @'\n'), @lambda l@to trim(l)), @lambda l@to length(l) > 10 AND @like(l, @'\p{{L}}') AND NOT " + _JSON_LIKE.format("l").replace("{", "{{").replace("}", "}}")
    + " AND NOT " + _URL_LINE.format("l") + " AND " + _MARKS.format("l").replace("{", "{{").replace("}", "}}") + " * 10 <= 3 * length(l))"
).replace("{{", "{").replace("}}", "}")
#: A text's lines that are neither JSON nor URLs, joined, without brackets, quotes, escapes and field words.
CLEANED = (
    rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(@join({_LINES}, ' '), @'[{{}}\[\]\x22\x27]', ' '@every), @'[ \t\r\f]+', ' '@every), @'%[0-9A-Fa-f][0-9A-Fa-f]', ' '@every), "
    rf"@'\b({'|'.join(FIELD_WORDS)})\b:?', ' '@every))"
)
_MEANT = (
    "length(s) >= 15 AND " + _MARKS.format("s") + " * 10 <= length(s) AND NOT @like(lower(s), @'" + "|".join(w.replace(".", r"\.") for w in WEB_WORDS) + "') AND NOT " + _JSON_LIKE.format("s")
    + r" AND (@like(s, @'[一-龥]') OR (length(s) > 20 AND @like(s, @'\p{L}')))"
)
#: Sentences of a cleaned text `c` that carry meaning.
SENTENCES = rf"@filter(@map(@split(c, @'[.!?。！？\n]'), @lambda s@to trim(s)), @lambda s@to {_MEANT})"
_NAME = "trim(t)"
VALID_NAME = f"length({_NAME}) BETWEEN 2 AND 50 AND NOT @like({_NAME}, @'{'|'.join(NOT_A_NAME)}') AND (length({_NAME}) - length(regexp_replace({_NAME}, @'" + r"[{}\[\]\x22\x27:,;()（）【】]" + f"', ''@every))) * 10 <= 3 * length({_NAME})"
VALID_ITEM = f"length(l) BETWEEN 5 AND 100 AND NOT @like(lower(l), @'{'|'.join(x.lower() for x in NOT_AN_ITEM)}') AND (@like(l, @'[一-龥]') OR (length(l) > 10 AND @like(l, @'" + r"\p{L}')))"
IMAGE_URL = f"coalesce(@like(lower(url), @'\\.({'|'.join(IMAGE_ENDS)})$|{'|'.join(IMAGE_WORDS)}') AND NOT @like(lower(url), @'{'|'.join(NOT_CONTENT)}'), false)"


def once(expression: str):
    """An expression behind a generator: what follows reads its value instead of repeating it."""
    return F.explode(F.array(F.expr(spark_sql(expression))))


def e02_clean_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(spark_sql(CLEANED)).alias("cleaned"))


def p18_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of a cleaned text carry meaning, and how long they are in all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", once(CLEANED).alias("c")).select("doc_id", once(SENTENCES).alias("s"))
    return rows.select("doc_id", F.coalesce(F.size("s"), F.lit(0)).alias("sentences"), F.expr("coalesce(aggregate(s, 0L, (n, x) -> n + length(x)), 0L)").alias("chars"))


def rule_rows(docs: DataFrame, words: list[str], among: int, least: int) -> DataFrame:
    """doc_id, rule_id, action: sentences of over 20 characters with a rule word among the first `among`, `least` at most.

    Texts of under 50 cleaned characters or with fewer than two sentences that carry meaning have none.
    """
    rows = docs.select("doc_id", once(CLEANED).alias("c")).where("length(c) >= 50").select("doc_id", once(SENTENCES).alias("s"))
    picked = f"slice(filter(slice(s, 1, {among}), x -> length(x) > 20 and x rlike '{'|'.join(words)}'), 1, {least})"
    found = rows.where("size(s) >= 2").select("doc_id", F.posexplode(F.expr(picked)).alias("pos", "action"))
    return found.select("doc_id", F.format_string("rule_%03d", F.col("pos") + 1).alias("rule_id"), "action")


def e05_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules each document has, and the first one; the invented prose has none of the fixed words."""
    docs = table(spark, sf_dir, "documents")
    found = rule_rows(docs, RULE_WORDS, 10, 6).groupBy("doc_id").agg(F.count("*").alias("rules"), F.min_by("action", "rule_id").alias("first_rule"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"), "first_rule")


def p19_concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1).alias("t")
    return table(spark, sf_dir, "pages").select("page_id", title).select("page_id", F.expr(spark_sql(VALID_NAME)).alias("valid"))


def p21_checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rf"@size(@filter(@map(@split(text, @'\n'), @lambda l@to trim(l)), @lambda l@to {VALID_ITEM}))"
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(spark_sql(items)).alias("items"))


def u11_image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(spark_sql(IMAGE_URL)).alias("is_image"))


def domain_short():
    """Short name of a URL's domain: the fixed one, else ten characters of its first label without www."""
    known = F.create_map(*(F.lit(x) for pair in DOMAINS.items() for x in pair))
    return F.coalesce(known[domain()], F.substring(F.substring_index(F.replace(domain(), F.lit("www."), F.lit("")), ".", 1), 1, 10))


def u06_domain_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", domain_short().alias("domain_short"))


def k02_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact file names of type, short domain and six digits of the URL's md5."""
    name = F.concat(F.lit("dfd_concepts_"), domain_short(), F.lit("_"), F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 6), F.lit(".json"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("file_name"))


def h11_link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a page's text that stands inside links."""
    bare = r"length(regexp_replace({}, r'<[^>]+>|[ \t\r\n]', ''))"
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(bare.format(r"array_join(regexp_extract_all(html, r'(?is)<a [^>]*>.*?</a>', 0), '')")).alias("inside"), F.expr(bare.format("html")).alias("n"))
    return rows.select("page_id", F.expr("if(n > 0, round(inside / n, 4), 0.0D)").alias("link_density"))


def h25_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without invisible characters and emoji, two line ends in a row at most."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", INVISIBLE, ""), EMOJI, ""), "\n{3,}", "\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("text"))


def h29_crawl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, text density, main selectors hit, dynamic markers, and whether a page should be rendered instead."""
    hits = " + ".join(f"if(regexp_like(html, r'(?i){s}'), 1, 0)" for s in MAIN_SELECTORS)
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.expr("coalesce(length(html), 0)").alias("html_length"), F.length(clean_text()).alias("cleaned_length"),
        F.expr(f"coalesce({hits}, 0)").alias("main_selector_hits"), is_dynamic().alias("dynamic_markers_found"),
    )
    rows = rows.withColumn("text_density", F.expr("if(html_length > 0, round(cleaned_length / html_length, 4), 0.0D)"))
    return rows.withColumn("fallback", F.expr(_FALLBACK))


def h14_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the main container (the article, else the page), one row per heading of level 1 to 3 in order."""
    rows = sections(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "pos", "level", "heading", "text")


def sections(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, heading, text of each section of pages(page_id, html)."""
    body = r"if(html rlike r'(?i)<article[ >]', regexp_extract(html, r'(?is)<article[^>]*>(.*)</article>', 1), html)"
    cut = rf"slice(split(regexp_replace({body}, r'(?i)<h([1-3])([ >])', concat(chr(1), '$1<h$2')), chr(1)), 2, 1000000000)"
    rows = pages.select("page_id", F.posexplode(F.expr(cut)).alias("pos", "part"))
    plain = r"trim(regexp_replace(regexp_replace({}, r'<[^>]*>', ' '), r'[ \t\r\n]+', ' '))"
    heading = plain.format(r"regexp_extract(part, r'(?is)^[1-3]<h[^>]*>(.*?)</h[1-3]>', 1)")
    text = plain.format(r"regexp_replace(part, r'(?is)^[1-3]<h[^>]*>.*?</h[1-3]>', '')")
    return rows.select("page_id", "pos", F.expr("cast(substring(part, 1, 1) as int)").alias("level"), F.expr(heading).alias("heading"), F.expr(text).alias("text"))


_FALLBACK = "(dynamic_markers_found AND cleaned_length < 2000) OR ((cleaned_length < 1200 OR text_density < 0.18) AND main_selector_hits = 0)"
QUERIES = {
    q.__name__: q
    for q in (e02_clean_content, p18_sentences, e05_rules, p19_concept_names, p21_checklist_items, u11_image_urls, u06_domain_short, k02_file_name,
              h11_link_density, h25_visible, h29_crawl_metrics, h14_sections)
}
_DOMAIN_SQL = "coalesce(nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), 'unknown')"
_SHORT_SQL = f"CASE {_DOMAIN_SQL} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in DOMAINS.items())} ELSE split_part(replace({_DOMAIN_SQL}, 'www.', ''), '.', 1)[1:10] END"
_PLAIN_SQL = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_SECTIONS_SQL = r"""WITH b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<article[ >]') THEN regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1) ELSE html END AS body FROM pages),
  p AS (SELECT page_id, string_split(regexp_replace(body, '(?i)<h([1-3])([ >])', chr(1) || '\1<h\2', 'g'), chr(1))[2:] AS parts FROM b),
  u AS (SELECT page_id, unnest(parts) AS part, CAST(unnest(range(len(parts))) AS INTEGER) AS pos FROM p),
  s AS (SELECT page_id, pos, CAST(part[1:1] AS INTEGER) AS level, """ + _PLAIN_SQL.format(r"regexp_extract(part, '(?is)^[1-3]<h[^>]*>(.*?)</h[1-3]>', 1)") + " AS heading, " + _PLAIN_SQL.format(
    r"regexp_replace(part, '(?is)^[1-3]<h[^>]*>.*?</h[1-3]>', '')") + " AS text FROM u)"
_MEANT_SQL = f"WITH d AS (SELECT doc_id, {duck_sql(CLEANED)} AS c FROM documents), s AS (SELECT doc_id, {duck_sql(SENTENCES)} AS s FROM d WHERE {{0}})"
ORACLES = {
    "e02_clean_content": f"SELECT doc_id, {duck_sql(CLEANED)} AS cleaned FROM documents",
    "p18_sentences": _MEANT_SQL.replace("{0}", "true") + " SELECT doc_id, CAST(coalesce(len(s), 0) AS INTEGER) AS sentences, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM s",
    "e05_rules": _MEANT_SQL.replace("{0}", "length(c) >= 50") + """, r AS (SELECT doc_id, list_filter(s[1:10], lambda x: length(x) > 20 AND regexp_matches(x, '规则|约束|限制|要求|必须|应该|应当|需要|不能|禁止|规定|条件|如果|当|则'))[1:6] AS a FROM s WHERE len(s) >= 2)
      SELECT d.doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS rules, a[1] AS first_rule FROM documents d LEFT JOIN r USING (doc_id)""",
    "p19_concept_names": f"SELECT page_id, {duck_sql(VALID_NAME)} AS valid FROM (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)",
    "p21_checklist_items": duck_sql(rf"SELECT doc_id, CAST(@size(@filter(@map(@split(text, @'\n'), @lambda l@to trim(l)), @lambda l@to {VALID_ITEM})) AS INTEGER) AS items FROM documents"),
    "u11_image_urls": f"SELECT page_id, {duck_sql(IMAGE_URL)} AS is_image FROM pages",
    "u06_domain_short": f"SELECT page_id, {_SHORT_SQL} AS domain_short FROM pages",
    "k02_file_name": f"SELECT page_id, 'dfd_concepts_' || {_SHORT_SQL} || '_' || md5(coalesce(url, ''))[1:6] || '.json' AS file_name FROM pages",
    "h11_link_density": r"""WITH p AS (SELECT page_id, length(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>'), ''), '<[^>]+>|[ \t\r\n]', '', 'g')) AS i,
      length(regexp_replace(html, '<[^>]+>|[ \t\r\n]', '', 'g')) AS n FROM pages) SELECT page_id, CASE WHEN n > 0 THEN round(i / n, 4) ELSE 0.0::DOUBLE END AS link_density FROM p""",
    "h25_visible": f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{INVISIBLE}', '', 'g'), '{EMOJI}', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM documents",
    "h29_crawl_metrics": f"""WITH m AS (SELECT page_id, CAST(coalesce(length(html), 0) AS INTEGER) AS html_length, CAST(length({CLEAN_SQL}) AS INTEGER) AS cleaned_length,
        CAST(coalesce({" + ".join(f"CASE WHEN regexp_matches(html, '(?i){s}') THEN 1 ELSE 0 END" for s in MAIN_SELECTORS)}, 0) AS INTEGER) AS main_selector_hits,
        {DYNAMIC_SQL} AS dynamic_markers_found FROM pages),
      d AS (SELECT *, CASE WHEN html_length > 0 THEN round(cleaned_length / html_length, 4) ELSE 0.0::DOUBLE END AS text_density FROM m) SELECT *, {_FALLBACK} AS fallback FROM d""",
    "h14_sections": _SECTIONS_SQL + " SELECT * FROM s",
}
SECTIONS_SQL = _SECTIONS_SQL
