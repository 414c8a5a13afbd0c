"""HTML to text and structure with regular expressions that run inside the JVM.

A null page has an empty text and title, no headings, no markers and null lengths.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Block tags that end a line, then what is removed; white space and what else a plain text does not hold.
_TAGS = [
    (r"(?i)</?(br|p|div|h[1-6]|li)[^>]*>", "\n"),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
    (r"<[^>]+>", ""),
]
_BLANKS = [
    (r"[ \t\n\r\f\x0B\x{A0}]+", " "),
    (r"""[^\p{L}\p{N}_ .,!?;:()\[\]{}"'\x{3000}-\x{303F}\x{FF00}-\x{FFEF}-]""", " "),
    (" +", " "),
]
#: Named entities, fixed values; the ampersand is the last to be decoded.
ENTITIES = {
    "nbsp": 0xA0, "lt": 0x3C, "gt": 0x3E, "quot": 0x22, "apos": 0x27, "copy": 0xA9, "reg": 0xAE, "trade": 0x2122, "hellip": 0x2026, "mdash": 0x2014, "ndash": 0x2013, "lsquo": 0x2018, "rsquo": 0x2019, "ldquo": 0x201C, "rdquo": 0x201D,
    "middot": 0xB7, "bull": 0x2022, "laquo": 0xAB, "raquo": 0xBB, "times": 0xD7, "deg": 0xB0, "plusmn": 0xB1, "euro": 0x20AC, "pound": 0xA3, "yen": 0xA5, "sect": 0xA7, "para": 0xB6, "amp": 0x26,
}


def _numeric(text: str) -> str:
    """SQL of a text with its numeric entities decoded; numbers that are no characters become U+FFFD, what is no entity stays."""
    n = "coalesce(cast(nullif(regexp_extract(p, r'^([0-9]{1,7});', 1), '') as bigint), cast(conv(nullif(regexp_extract(p, r'^[xX]([0-9a-fA-F]{1,6});', 1), ''), 16, 10) as bigint))"
    bad = f"({n} = 0 or {n} between 55296 and 57343 or {n} > 1114111)"
    letter = f"if({bad}, '\uFFFD', decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32'))"
    piece = f"case when i = 0 then p when {n} is null then concat('&#', p) else concat({letter}, substring(p, instr(p, ';') + 1)) end"
    return f"array_join(transform(split({text}, '&#'), (p, i) -> {piece}), '')"


def decoded(text: str) -> str:
    """SQL of a text with its entities decoded: numeric ones, named ones, and numeric ones that this brings forth."""
    out = _numeric(text)
    for name, code in ENTITIES.items():
        out = f"replace({out}, '&{name};', decode(unhex('{code:08X}'), 'UTF-32'))"
    return _numeric(out)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def clean_text(html: str = "html"):
    """Plain text of a page on one line; null gives an empty text."""
    out = f"coalesce({html}, '')"
    for pattern, by in _TAGS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)})"
    out = f"element_at(transform(array({out}), t -> if(contains(t, '&'), {decoded('t')}, t)), 1)"  # no ampersand, no entity
    for pattern, by in _BLANKS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)})"
    return F.expr(f"trim({out})")


def _decoded_sql(text: str) -> str:
    n = "coalesce(CAST(nullif(regexp_extract(p, '^([0-9]{1,7});', 1), '') AS BIGINT), CAST('0x' || nullif(regexp_extract(p, '^[xX]([0-9a-fA-F]{1,6});', 1), '') AS BIGINT))"
    letter = f"CASE WHEN {n} = 0 OR {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN chr(65533) ELSE chr(CAST({n} AS INTEGER)) END"
    numeric = lambda t: f"array_to_string(list_transform(string_split({t}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {n} IS NULL THEN '&#' || p ELSE {letter} || p[instr(p, ';') + 1:] END), '')"
    out = numeric(text)
    for name, code in ENTITIES.items():
        out = f"replace({out}, '&{name};', chr({code}))"
    return numeric(out)


def _sql() -> str:
    out = "coalesce(html, '')"
    doubled = lambda x: x.replace("'", "''")
    for pattern, by in _TAGS:
        out = f"regexp_replace({out}, '{doubled(pattern)}', '{by}', 'g')"
    out = _decoded_sql(out)
    for pattern, by in _BLANKS:
        out = f"regexp_replace({out}, '{doubled(pattern)}', '{by}', 'g')"
    return f"trim({out})"


CLEAN_SQL = _sql()


def h04_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their entities decoded, tags and all."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(decoded("html")).alias("html"))


#: What tells a page that scripts fill, fixed values; letter case does not count.
MARKERS = ["__NUXT__", "data-reactroot", 'id="__next"', "ng-version", "skeleton", "loading", 'id="root"', 'id="app"', "window.__APOLLO_STATE__", "__INITIAL_STATE__"]


def is_dynamic(html: str = "html"):
    """Whether a page holds a marker of a page that scripts fill; false for null."""
    return F.coalesce(F.lower(html).rlike("|".join(re.escape(m.lower()) for m in MARKERS)), F.lit(False))




def h01_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", clean_text().alias("clean_text"))


def h19_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First h1, else the title that the page gives to link previews, else the title element."""
    meta = [F.nullif(F.trim(F.regexp_extract("html", rf"""(?is)<meta[^>]*(?:property|name)=["']{k}["'][^>]*content=["'](.*?)["']""", 1)), F.lit("")) for k in ("og:title", "twitter:title")]
    first = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", f"(?is)<{t}[^>]*>(.*?)</{t}>", 1), "<[^>]+>", "")), F.lit("")) for t in ("h1", "title")]
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(first[0], *meta, first[1], F.lit("")).alias("title"))


def h26_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings h1 to h3 that hold text, in order."""
    found = F.expr(r"filter(regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>', 0), h -> trim(regexp_replace(h, '<[^>]+>', '')) <> '')")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "h"))
    return rows.select("page_id", (F.col("pos") + 1).cast("int").alias("position"), F.expr("cast(substring(h, 3, 1) as int)").alias("level"), F.expr("concat('h', substring(h, 3, 1))").alias("tag"), F.trim(F.regexp_replace("h", "<[^>]+>", "")).alias("text"))


def h28_cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.char_length("html").alias("html_length"), F.char_length(clean_text()).alias("cleaned_length"), F.regexp_count("html", F.lit("<[^>]+>")).alias("tags"), F.regexp_count("html", F.lit("&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;|&#x[0-9a-fA-F]+;")).alias("entities"))
    return rows.withColumn("reduction", F.round(1 - F.try_divide(F.col("cleaned_length"), F.col("html_length")), 3))


def h30_dynamic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_dynamic().alias("dynamic"))


DYNAMIC_SQL = """coalesce(contains(lower(html), '__nuxt__') OR contains(lower(html), 'data-reactroot') OR contains(lower(html), 'id="__next"') OR contains(lower(html), 'ng-version')
  OR contains(lower(html), 'skeleton') OR contains(lower(html), 'loading') OR contains(lower(html), 'id="root"') OR contains(lower(html), 'id="app"')
  OR contains(lower(html), 'window.__apollo_state__') OR contains(lower(html), '__initial_state__'), false)"""
QUERIES = {q.__name__: q for q in (h01_clean_text, h04_entities, h19_title, h26_outline, h28_cleaning_stats, h30_dynamic_pages)}
ORACLES = {
    "h04_entities": f"SELECT page_id, {_decoded_sql('html')} AS html FROM pages",
    "h01_clean_text": f"SELECT page_id, {CLEAN_SQL} AS clean_text FROM pages",
    "h19_title": """SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), ''),
      nullif(trim(regexp_extract(html, '(?is)<meta[^>]*(?:property|name)=["'']og:title["''][^>]*content=["''](.*?)["'']', 1)), ''),
      nullif(trim(regexp_extract(html, '(?is)<meta[^>]*(?:property|name)=["'']twitter:title["''][^>]*content=["''](.*?)["'']', 1)), ''),
      nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')), ''), '') AS title FROM pages""",
    "h26_outline": """WITH h AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>'), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g')) <> '') AS a FROM pages),
      e AS (SELECT page_id, unnest(a) AS h, unnest(range(1, len(a) + 1)) AS position FROM h)
      SELECT page_id, CAST(position AS INTEGER) AS position, CAST(h[3:3] AS INTEGER) AS level, 'h' || h[3:3] AS tag, trim(regexp_replace(h, '<[^>]+>', '', 'g')) AS text FROM e""",
    "h28_cleaning_stats": f"""WITH s AS (SELECT page_id, CAST(length(html) AS INTEGER) AS html_length, CAST(length({CLEAN_SQL}) AS INTEGER) AS cleaned_length,
      CAST(len(regexp_extract_all(html, '<[^>]+>')) AS INTEGER) AS tags,
      CAST(len(regexp_extract_all(html, '&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;|&#x[0-9a-fA-F]+;')) AS INTEGER) AS entities FROM pages) SELECT *, round(1 - cleaned_length / nullif(html_length, 0), 3) AS reduction FROM s""",
    "h30_dynamic_pages": "SELECT page_id, " + DYNAMIC_SQL + " AS dynamic FROM pages",
}
