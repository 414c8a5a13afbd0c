"""Pages to text with regular expressions inside the JVM: plain texts, tag ratios, addresses, result lists, names, decisions. Null pages hold nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialects import duck_sql, spark_sql
from ..functions.html import CLEAN_SQL, clean_text
from ..functions.urls import NORMALIZED_SQL, domain, normalized, title_slug
from ..session import table
from ..sources.artifacts import search_items

_ARTICLE = r"(?is)<article[^>]*>(.*)</article>"
_COUNT = "@size(@all(k, @'{}'@whole))"


def h07_basic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags, with the commonest entities decoded and single spaces."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(spark_sql(_BASIC)).alias("text"))


_BASIC = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, @'<[^>]+>', ''@every), '&lt;', '<'), '&gt;', '>'), '&quot;', '\x22'), '&copy;', '©'), '&amp;', '&'), @'[ \t\r\n]+', ' '@every))".replace(r"'\x22'", "chr(34)")


def _container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and k, the article of a page or the page without one."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.coalesce(F.nullif(F.regexp_extract("html", _ARTICLE, 1), F.lit("")), "html", F.lit("")))).alias("k"))


def h12_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of list tags and of headings among the tags of a page's container."""
    n = {k: F.expr(spark_sql(_COUNT.format(p))) for k, p in _TAGS.items()}
    rows = _container(spark, sf_dir).select("page_id", *(c.alias(k) for k, c in n.items()))
    return rows.select("page_id", *(F.round(F.coalesce(F.try_divide(k, "tags"), F.lit(0.0)), 6).alias(f"{k}_ratio") for k in ("lists", "headings")))


_TAGS = {"tags": "<[a-zA-Z][^>]*>", "lists": "(?i)<(ul|ol|li)[ >]", "headings": "(?i)<h[1-3][ >]"}


def resolved(base: str, url: str) -> str:
    """SQL of a relative URL against its page: absolute ones stay, // gets https, / starts at the host, others at the folder; dot segments stay."""
    root = rf"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
    folder = rf"coalesce(nullif(regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?', 0), ''), {root} || '/')"
    return f"CASE WHEN {url} LIKE 'http://%' OR {url} LIKE 'https://%' THEN {url} WHEN {url} LIKE '//%' THEN 'https:' || {url} WHEN {url} LIKE '/%' THEN {root} || {url} ELSE {folder} || {url} END"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, pos and src of links, every third one as a relative address."""
    found = r"""transform(regexp_extract_all(html, r'<a href="([^"]*)">', 1), (x, i) -> if(i % 3 = 2, substring(x, 2), if(i % 3 = 1, '/' || x, x)))"""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.expr(found)).alias("pos", "src"))


def u10_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", "pos", F.expr(resolved("url", "src")).alias("resolved"))


def h34_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description and headings of a page, then its paragraphs of over 20 characters."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(spark_sql(_PAGE_TEXT)).alias("text"))


_BARE = "regexp_replace(regexp_replace(regexp_replace({}, @'(?is)<(script|style)[^>]*>.*?</(script|style)>', ''@every), @'<[^>]*>', ''@every), @'[ \\t\\r\\n]+', ' '@every)"
_PAGE_TEXT = (
    "'【标题】' || coalesce(nullif(regexp_extract(html, @'(?is)<title[^>]*>(.*?)</title>', 1), ''), '无标题') || chr(10) || '【描述】' || coalesce(nullif(regexp_extract(html, @'(?is)<meta name=\\x22description\\x22 content=\\x22([^\\x22]*)\\x22', 1), ''), '无描述')"
    " || chr(10) || '【结构】' || @join(@map(regexp_extract_all(html, @'(?is)<h[12][^>]*>(.*?)</h[12]>', 1), @lambda x@to trim(" + _BARE.format("x") + ")), ', ') || chr(10) || chr(10) ||"
    " @join(@filter(@map(regexp_extract_all(html, @'(?is)<p[^>]*>(.*?)</p>', 1), @lambda x@to trim(" + _BARE.format("x") + ")), @lambda x@to length(x) > 20), chr(10))"
)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search responses made of pages: the links of each as results; even pages name them otherwise."""
    links = r"""transform(regexp_extract_all(html, r'<a href="([^"]*)">([^<]*)</a>', 1), (x, i) -> """
    odd = f"to_json(struct({links} named_struct('link', x, 'title', substring(x, 2), 'position', i)) as organic_results))"
    even = f"to_json(struct(array() as organic_results, {links} named_struct('url', if(i = 1, '', x), 'name', substring(x, 2), 'snippet', '', 'description', 'about ' || x, 'rank', i + 1)) as web_results))"
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"if(page_id % 2 = 1, {odd}, {even})").alias("raw"))


def p01_search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(_responses(spark, sf_dir)).select("page_id", F.col("place").cast("int"), "url", "title", "snippet", "position")


def h35_result_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of each response as a Markdown list (K03)."""
    items = search_items(_responses(spark, sf_dir).withColumnRenamed("url", "keyword"))
    entry = "concat('## ', i + 1, '. ', coalesce(x.title, '无标题'), '\\n\\n**链接**: ', x.url, if(x.snippet is null, '', concat('\\n\\n**摘要**: ', x.snippet)), if(x.position is null, '', concat('\\n\\n**排名**: ', x.position)), '\\n\\n---')"
    lists = items.groupBy("page_id", "keyword").agg(F.array_sort(F.collect_list(F.struct("place", "title", "url", "snippet", "position"))).alias("r"))
    head = "concat('# 搜索结果: ', coalesce(keyword, '未知'), '\\n\\n- **结果数量**: ', size(r), '\\n\\n')"
    return lists.select("page_id", F.expr(f"concat({head}, array_join(transform(r, (x, i) -> {entry}), '\\n\\n'))").alias("markdown"))


def u09_folder_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder of a saved page: its title in letters, digits and _ (else its host), eight digits of the URL's md5, and the time, which is a parameter."""
    title = F.btrim(F.substring(F.regexp_replace(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1), r"[^\p{L}\p{N}_]+", "_"), 1, 50), F.lit("_"))
    name = F.coalesce(F.nullif(title, F.lit("")), F.replace(domain(), F.lit("."), F.lit("_")))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(name, F.lit("_"), F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), F.lit("_20240101_000000")).alias("folder"))


def u12_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of parts in canonical form: trimmed, single spaces, 64 characters at most."""
    plain = lambda c: F.substring(F.regexp_replace(F.trim(c), r"[ \t\r\n]+", " "), 1, 64)
    return table(spark, sf_dir, "part").select("p_partkey", plain(F.concat_ws("  ", "p_name", "p_brand", "p_type", F.lit(" "))).alias("name"))


def u13_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookie strings of events as maps; parts without = are left out, the last of equal names counts."""
    cookies = F.expr("concat('uid=', user_id, '; type = ', event_type, ';bad; a=b=c; uid=', user_id + 1)")
    pairs = "filter(split({}, ';'), p -> contains(p, '='))"
    made = f"map_from_entries(transform({pairs.format('c')}, p -> struct(trim(substring_index(p, '=', 1)) as k, trim(substring(p, instr(p, '=') + 1)) as v)))"
    last = made.replace(pairs.format("c"), f"filter({pairs.format('c')}, (p, i) -> not exists(slice({pairs.format('c')}, i + 2, size({pairs.format('c')})), o -> trim(substring_index(o, '=', 1)) = trim(substring_index(p, '=', 1))))")
    rows = table(spark, sf_dir, "events").select("event_id", cookies.alias("c")).select("event_id", F.expr(last).alias("m"))
    return rows.select("event_id", F.expr("m['uid']").alias("uid"), F.expr("m['type']").alias("type"), F.expr("m['a']").alias("a"), F.size("m").alias("n"))


def w06_clash_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of saved events: the type, from the second of a user's day on with a number."""
    by = Window.partitionBy("user_id", "day", "event_type").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day")).withColumn("n", F.row_number().over(by) - 1)
    return rows.select("event_id", F.expr("concat(event_type, if(n > 0, concat('_', n), ''))").alias("name"))


def d09_manage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache's numbers before and after cleaning visits older than ten days from the newest, and after a reset."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    newest = table(spark, sf_dir, "events").agg(F.max("ts").alias("newest"))  # one row
    n = rows.join(F.broadcast(newest), F.lit(True)).agg(F.count("*").alias("stats"), F.count_if(F.expr("last >= newest - interval 10 days")).alias("clean"))
    return n.select(F.expr("stack(3, 'stats', stats, 'clean', clean, 'reset', 0L) as (action, rows)"))


def j07_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source of each page's artifact: the sidecar's address if there is a sidecar (even pages, every fourth without an address), else the parsed page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sidecars = pages.where("page_id % 2 = 0").select("page_id", F.expr("if(page_id % 4 = 0, null, concat(url, '?side'))").alias("side_url"), F.lit(True).alias("has"))
    return pages.join(sidecars, "page_id", "left").select("page_id", F.expr("if(coalesce(has, false), side_url, url)").alias("source_url"))


def k01_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder path of each page's artifact (K01): year, month, day, hour and minute of a parameter, domain and slug."""
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.lit("2024/01/01/00_00"), domain(), title_slug(title, F.col("url"))).alias("path"))


QUERIES = {
    q.__name__: q
    for q in (h07_basic_clean, h12_tag_ratio, h34_page_text,
              h35_result_list, p01_search_items, u09_folder_name, u10_resolved, u12_names, u13_cookies, w06_clash_suffix, d09_manage, j07_source_urls, k01_paths)
}
_K = r"WITH c AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), html, '') AS k FROM pages)"
_N = lambda p: f"len(regexp_extract_all(k, '{p}'))"
_LINKS = r"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a FROM pages), l AS (SELECT page_id, url, unnest(a) AS s, CAST(unnest(range(len(a))) AS INTEGER) AS pos FROM x),
  r AS (SELECT page_id, url, pos, CASE pos % 3 WHEN 2 THEN s[2:] WHEN 1 THEN '/' || s ELSE s END AS src FROM l)"""
_ITEMS = _LINKS + """, i AS (SELECT page_id, url AS keyword, pos AS place, CASE WHEN page_id % 2 = 0 AND pos = 1 THEN NULL ELSE s END AS url, s[2:] AS title, CASE WHEN page_id % 2 = 0 THEN 'about ' || s END AS snippet, CASE WHEN page_id % 2 = 0 THEN pos + 1 WHEN pos > 0 THEN pos END AS position FROM l)"""
_HOST = "coalesce(nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), 'unknown')"
ORACLES = {
    "h07_basic_clean": f"SELECT page_id, {duck_sql(_BASIC)} AS text FROM pages",
    "h12_tag_ratio": _K + f", n AS (SELECT page_id, {_N('<[a-zA-Z][^>]*>')} AS t, {_N('(?i)<(ul|ol|li)[ >]')} AS l, {_N('(?i)<h[1-3][ >]')} AS h FROM c) SELECT page_id, round(coalesce(l / nullif(t, 0), 0), 6) AS lists_ratio, round(coalesce(h / nullif(t, 0), 0), 6) AS headings_ratio FROM n",
    "u10_resolved": _LINKS + f" SELECT page_id, pos, {resolved('url', 'src')} AS resolved FROM r",
    "h34_page_text": f"SELECT page_id, {duck_sql(_PAGE_TEXT)} AS text FROM pages",
    "p01_search_items": _ITEMS + " SELECT page_id, place, url, title, snippet, position FROM i WHERE url IS NOT NULL",
    "h35_result_list": _ITEMS + """, e AS (SELECT page_id, keyword, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n, place, '. ' || title || chr(10) || chr(10) || '**链接**: ' || url || coalesce(chr(10) || chr(10) || '**摘要**: ' || snippet, '') || coalesce(chr(10) || chr(10) || '**排名**: ' || position, '') || chr(10) || chr(10) || '---' AS e FROM i WHERE url IS NOT NULL)
      SELECT page_id, '# 搜索结果: ' || coalesce(keyword, '未知') || chr(10) || chr(10) || '- **结果数量**: ' || count(*) || chr(10) || chr(10) || string_agg('## ' || n || e, chr(10) || chr(10) ORDER BY n) AS markdown FROM e GROUP BY page_id, keyword""",
    "u09_folder_name": rf"""WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '[^\p{{L}}\p{{N}}_]+', '_', 'g')[1:50], '_') AS t FROM pages)
      SELECT page_id, coalesce(nullif(t, ''), replace({_HOST}, '.', '_')) || '_' || md5(coalesce(url, ''))[1:8] || '_20240101_000000' AS folder FROM t""",
    "u12_names": "SELECT p_partkey, regexp_replace(trim(concat_ws('  ', p_name, p_brand, p_type, ' ')), '[ \\t\\r\\n]+', ' ', 'g')[1:64] AS name FROM part",
    "u13_cookies": "SELECT event_id, CAST(user_id + 1 AS VARCHAR) AS uid, event_type AS type, 'b=c' AS a, 3 AS n FROM events",
    "w06_clash_suffix": "WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d'), event_type ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, event_type || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS name FROM n",
    "d09_manage": """WITH l AS (SELECT max(ts) AS last FROM events GROUP BY user_id, event_type), n AS (SELECT count(*) AS s, count(*) FILTER (last >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS) AS c FROM l)
      SELECT 'stats' AS action, s AS rows FROM n UNION ALL SELECT 'clean', c FROM n UNION ALL SELECT 'reset', 0 FROM n""",
    "j07_source_urls": "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN url WHEN page_id % 4 <> 0 THEN url || '?side' END AS source_url FROM pages",
    "k01_paths": r"""WITH t AS (SELECT page_id, url, trim(coalesce(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM pages)
      SELECT page_id, '2024/01/01/00_00/' || coalesce(nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), 'unknown') || '/' || regexp_replace(regexp_replace(replace(CASE WHEN t = '' THEN 'untitled' ELSE t END, ' ', '-'), '[<>:"/\\|?*]', '_', 'g'), '-+', '-', 'g')[1:60]
      || '-' || md5(coalesce(url, ''))[1:8] AS path FROM t""",
}
