"""URL identity: canonical addresses, hashes, domains and slugs, all as column expressions.

A null URL stays null, and so do its hashes and keys; its domain is `unknown`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Query parameters that only track, fixed values.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "_ga", "_gid", "ref", "referrer",
    "source", "from", "spm", "scm", "pvid", "pos", "ps", "clickid", "timestamp", "time", "t", "_t", "v", "version",
]
_LIST = ", ".join(f"'{p}'" for p in TRACKING)


def normalized(url: str = "url") -> Column:
    """Canonical form of a URL column: trimmed, scheme and host in lower case, default ports, tracking
    parameters, blank values and the fragment gone, parameters by key, an empty path as /. What has no
    scheme stays as it is; null stays null. Parameters are decoded (a broken escape is kept as written) and
    encoded anew, so that each has one spelling; of equal keys the order stays."""
    u = f"trim(BOTH FROM {url})"
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"regexp_replace(lower(regexp_extract({u}, '://([^/?#]*)', 1)), if({scheme} = 'http', ':80$', ':443$'), '')"
    path = f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
    plain = lambda x: f"coalesce(try_url_decode({x}), {x})"
    coded = lambda x: f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"
    pairs = f"transform(filter(split({query}, '&'), p -> p rlike '=.'), p -> struct({plain("substring_index(p, '=', 1)")} as k, {plain("substring(p, instr(p, '=') + 1)")} as v))"
    kept = f"filter({pairs}, p -> lower(p.k) not in ({_LIST}))"
    ordered = f"array_join(transform(array_sort(transform({kept}, (p, i) -> struct(p.k as k, i as i, p.v as v))), x -> concat({coded('x.k')}, '=', {coded('x.v')})), '&')"
    return F.expr(f"if({scheme} = '', {u}, concat({scheme}, '://', {host}, if({path} = '', '/', {path}), if({ordered} = '', '', concat('?', {ordered}))))")


NORMALIZED_SQL = f"""
WITH a AS (
  SELECT page_id, url, trim(url) AS u, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme FROM pages
), b AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), CASE scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, '') AS host,
    regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) AS query FROM a
), c AS (
  SELECT *, coalesce(array_to_string(list_transform(list_sort(list_transform(
    list_filter(list_transform(list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '=.')), lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(p[instr(p, '=') + 1:], '+', ' '))}}),
      lambda p: lower(p.k) NOT IN ({_LIST})),
    lambda p, i: {{'k': p.k, 'i': i, 'v': p.v}})), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&'), '') AS rest FROM b
), n AS (
  SELECT page_id, url, CASE WHEN scheme = '' THEN u ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN rest = '' THEN '' ELSE '?' || rest END END AS normalized_url FROM c
)"""


def domain(url: str = "url") -> Column:
    """Host and port, or `unknown`."""
    return F.expr(f"coalesce(nullif(regexp_extract({url}, '://([^/?#]*)', 1), ''), 'unknown')")


def u01_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normalized().alias("normalized_url"))


def u02_url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(normalized(), 256).alias("url_hash"))


def u03_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr("substring(md5(lower(rtrim('/', url))), 1, 12)").alias("url_key"))


def u04_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each URL as it is written, by a pre-aggregated minimum."""
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


def u05_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(domain().alias("domain")).agg(F.count("*").alias("pages"))


def title_slug(title: Column, url: Column) -> Column:
    """Title of at most 60 characters fit for a file name, `untitled` without one, and eight digits of the URL's md5 (of an empty text for null)."""
    plain = F.coalesce(F.nullif(F.btrim(title, F.lit(" \t\n\r\f\x0b")), F.lit("")), F.lit("untitled"))
    slug = F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit(" "), F.lit("-")), r'[<>:"/\\|?*]', "_"), "-+", "-")
    return F.concat(F.substring(slug, 1, 60), F.lit("-"), F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 8))


def u07_url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title_slug(title, F.col("url")).alias("slug"))


QUERIES = {q.__name__: q for q in (u01_normalize_url, u02_url_hash, u03_url_key, u04_first_seen, u05_domain_counts, u07_url_slug)}
ORACLES = {
    "u01_normalize_url": NORMALIZED_SQL + " SELECT page_id, normalized_url FROM n",
    "u02_url_hash": NORMALIZED_SQL + " SELECT page_id, sha256(normalized_url) AS url_hash FROM n",
    "u03_url_key": "SELECT page_id, md5(lower(rtrim(url, '/')))[1:12] AS url_key FROM pages",
    "u04_first_seen": "SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "u05_domain_counts": "SELECT coalesce(nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), 'unknown') AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "u07_url_slug": r"""WITH t AS (SELECT page_id, url, trim(coalesce(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM pages)
      SELECT page_id, regexp_replace(regexp_replace(replace(CASE WHEN t = '' THEN 'untitled' ELSE t END, ' ', '-'), '[<>:"/\\|?*]', '_', 'g'), '-+', '-', 'g')[1:60]
      || '-' || md5(coalesce(url, ''))[1:8] AS slug FROM t""",
}
