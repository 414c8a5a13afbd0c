"""Pages as node tables: noise, containers, sections, Markdown, images, tables and site fields, one pass over the pages each.

Each page's tree is built where the page is read (Arrow batches); what comes out is columns, and what goes on from
there (clean texts, image lists, tables, exploded sections) is DataFrame work. Null pages are empty ones. The SQL that
checks these queries builds the tree anew, token by token, by a recursive query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nodes
from ..functions.html import CLEAN_SQL, _decoded_sql, clean_text
from ..functions.nodes import RULES, Page
from ..session import let_workers_import, table
from .extraction import EMOJI, INVISIBLE

#: Pages whose results are held as Python objects at once.
AT_ONCE = 256
_IMAGE = pa.struct([("src", pa.string()), ("alt", pa.string())])
_SECTION = pa.struct(
    [("heading", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("lists", pa.list_(pa.string())), ("images", pa.list_(_IMAGE)), ("code_blocks", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string()))))]
)
_TABLE = pa.list_(pa.list_(pa.string()))
_SPARK = {
    pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.string()): "array<string>", pa.list_(_IMAGE): "array<struct<src: string, alt: string>>",
    pa.list_(_TABLE): "array<array<array<string>>>",
    pa.list_(_SECTION): "array<struct<heading: string, level: int, text: string, lists: array<string>, images: array<struct<src: string, alt: string>>, code_blocks: array<string>, tables: array<array<array<string>>>>>",
}


def load_rules(spark: SparkSession, path: str | None = None) -> dict:
    """The cleaning rules, with the keys of a JSON file in place of their own; without a file, or with one that is no JSON object, as they are."""
    if path is None:
        return RULES
    try:
        own = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except ValueError:
        return RULES
    return RULES | own if isinstance(own, dict) else RULES


def over_pages(pages: DataFrame, columns: dict[str, pa.DataType], work: Callable[[str, str], dict]) -> DataFrame:
    """page_id, url and the columns that work(html, url) gives for each of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (rows.slice(lo, AT_ONCE) for rows in batches for lo in range(0, rows.num_rows, AT_ONCE)):
            out = [work(html or "", url or "") for html, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array([x[c] for x in out], kind) for c, kind in columns.items())], names=["page_id", "url", *columns])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, ", ".join(["page_id long, url string", *(f"{c} {_SPARK[kind]}" for c, kind in columns.items())]))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return table(spark, sf_dir, "pages")


def _without(*steps: Callable[[Page], None]) -> Callable[[str, str], dict]:
    def work(html: str, url: str) -> dict:
        page = Page(html)
        for step in steps:
            step(page)
        return {"html": page.serialized()}

    return work


TAGS, NOISE = (lambda page: page.remove_tags(RULES)), (lambda page: page.remove_noise(RULES))


def _markup(spark: SparkSession, sf_dir: str, *steps) -> DataFrame:
    return over_pages(_pages(spark, sf_dir), {"html": pa.string()}, _without(*steps)).drop("url")


def h09_without_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the elements that never hold content, nor what stands inside them."""
    return _markup(spark, sf_dir, TAGS)


def h10_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the elements whose class or id holds a word of noise."""
    return _markup(spark, sf_dir, NOISE)


def h15_internal_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without blacklisted, noisy and empty elements."""
    return _markup(spark, sf_dir, TAGS, NOISE, Page.remove_empty)


def h16_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose elements outside the white list are unwrapped."""
    return _markup(spark, sf_dir, lambda page: page.unwrap(RULES))


def h17_without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without elements that hold neither text nor an important element."""
    return _markup(spark, sf_dir, Page.remove_empty)


def container_scores(pages: DataFrame, rules: dict = RULES) -> DataFrame:
    """page_id, pos (order in the page) and score of each article, main, section and div that is no noise."""

    def work(html: str, url: str) -> dict:
        page = Page(html)
        page.remove_tags(rules)
        page.remove_noise(rules)
        own = [j for j in page.elements(0) if page.tag[j] in nodes.SCORED]
        return {"found": [f"{page.tag[j]} {page.score(j, rules)!r}" for j in own]}

    rows = over_pages(pages, {"found": pa.list_(pa.string())}, work).select("page_id", F.posexplode("found").alias("pos", "x"))
    return rows.select("page_id", "pos", F.split("x", " ")[0].alias("tag"), F.split("x", " ")[1].cast("double").alias("score"))


def h13_container_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all candidates for the main container."""
    return container_scores(_pages(spark, sf_dir)).withColumn("score", F.round("score", 4))


def main_containers(pages: DataFrame, rules: dict = RULES) -> DataFrame:
    """page_id, url, what found the main container, its tag before and after the check of continuity, and its raw text."""

    def work(html: str, url: str) -> dict:
        page = Page(html)
        page.remove_tags(rules)
        page.remove_noise(rules)
        first, found = page.main_container(nodes.host_of(url), rules)
        page, last, _ = nodes.cleaned(html, url, rules)
        return {"found_by": found, "first_tag": page.tag[first], "tag": page.tag[last], "raw": page.get_text(last, "\n")}

    return over_pages(pages, dict.fromkeys(("found_by", "first_tag", "tag", "raw"), pa.string()), work)


def h14_main_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main container of each page: by selectors in order, else by score, else the body."""
    rows = main_containers(_pages(spark, sf_dir))
    return rows.select("page_id", "found_by", F.col("first_tag").alias("tag"))


def h18_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container after the check of continuity, with the length of its plain text: articles of pages put in a section and that in a division, which hold a paragraph of their own."""
    more = F.concat(F.lit("<p>"), F.expr("repeat(concat(url, ' '), 9)"), F.lit("</p>"))
    inside = F.replace("html", F.lit("<article>"), F.concat(F.lit("<div>"), more, F.lit("<section>"), more, F.lit("<article>")))
    html = F.replace(inside, F.lit("</article>"), F.lit("</article></section></div>"))
    rows = main_containers(_pages(spark, sf_dir).withColumn("html", html))
    return rows.select("page_id", "found_by", "tag", F.char_length(clean_text("raw")).alias("text_length"))


def structured_pages(pages: DataFrame, rules: dict = RULES) -> DataFrame:
    """page_id, url, title, clean_text, markdown, sections and images (src, alt) of each page's main container."""
    kinds = {"title": pa.string(), "text": pa.string(), "markdown": pa.string(), "sections": pa.list_(_SECTION), "images": pa.list_(_IMAGE)}
    rows = over_pages(pages, kinds, lambda html, url: nodes.structured(html, url, rules))
    visible = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean_text("text"), INVISIBLE, ""), EMOJI, ""), "\n{3,}", "\n\n")
    return rows.select("page_id", F.coalesce("url", F.lit("")).alias("source_url"), "title", visible.alias("clean_text"), "markdown", "sections", "images")


def page_tables(pages: DataFrame, rules: dict = RULES) -> DataFrame:
    """page_id and rows of each table of a page's main container, as `structured_pages` has them in its sections."""

    def work(html: str, url: str) -> dict:
        page, container, _ = nodes.cleaned(html, url, rules)
        return {"tables": page.tables(container)}

    return over_pages(pages, {"tables": pa.list_(_TABLE)}, work).select("page_id", F.explode("tables").alias("rows"))


def h20_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each section: heading, level, paragraphs, list items, code blocks and numbers of images and tables."""
    rows = structured_pages(_pages(spark, sf_dir)).select("page_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("page_id", "pos", "s.heading", "s.level", "s.text", F.array_join("s.lists", "|").alias("items"), F.array_join("s.code_blocks", "|").alias("code"), F.size("s.images").alias("images"), F.size("s.tables").alias("tables"))


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a page with a table of its lines, one row of cells left open."""
    cell = "concat('<tr><td>', l_partkey, '<td>', cast(l_quantity as int), '</tr>')"
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_quantity, {cell} as cell))), x -> x.cell), '')").alias("lines"))
    html = F.concat(F.lit("<article><h2>Order "), F.col("l_orderkey"), F.lit("</h2><table><thead><tr><th>part</th><th> quantity </th></tr></thead>"), F.col("lines"), F.lit("</table></article>"))
    return rows.select(F.col("l_orderkey").alias("page_id"), F.lit("http://shop.example.com/orders").alias("url"), html.alias("html"))


def h21_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages as pipe tables: pages of orders with their lines as HTML tables, a cell left open in each row."""
    let_workers_import(spark)
    rows = page_tables(_order_pages(spark, sf_dir))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head, rest = F.col("rows")[0], F.expr("slice(rows, 2, size(rows))")
    return rows.select(F.col("page_id").alias("l_orderkey"), F.concat_ws("\n", line(head), line(F.transform(head, lambda c: F.lit("---"))), F.nullif(F.array_join(F.transform(rest, line), "\n"), F.lit(""))).alias("markdown"))


def h22_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main container of each page as Markdown."""
    return structured_pages(_pages(spark, sf_dir)).select("page_id", "markdown")


def _image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links became images in an article, every other one with a relative address, the last twice."""
    links = r"""transform(regexp_extract_all(html, r'<a href="([^"]*)">', 1), (x, i) -> concat('<img alt="', i, '" ', if(i % 3 = 2, 'data-', ''), 'src="', if(i % 2 = 0, x, substring(x, 2)), '"', if(i % 2 = 0, '/>', '>')))"""
    body = F.array_join(F.expr(links), "")
    return _pages(spark, sf_dir).select("page_id", "url", F.concat(F.lit("<article><p>"), body, body, F.lit("</p></article>")).alias("html"))


def h23_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a page's main container: resolved, without those whose address holds a word of images that are no content, each once in order."""
    rows = structured_pages(_image_pages(spark, sf_dir)).where(F.size("images") > 0)
    return rows.select("page_id", F.array_join(F.transform("images", lambda x: F.concat(x["src"], F.lit(" "), x["alt"])), "|").alias("images"))


def h24_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's structured record with its sections and images counted."""
    return structured_pages(_pages(spark, sf_dir)).select("page_id", "source_url", "title", "clean_text", "markdown", F.size("sections").alias("sections"), F.size("images").alias("images"))


def h32_site_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, content, author, time of publication and tags of each page by the ordered selectors of an article site."""
    rows = over_pages(_pages(spark, sf_dir), {**dict.fromkeys(("title", "content", "author", "publish_time"), pa.string()), "tags": pa.list_(pa.string())}, lambda html, url: nodes.site_fields(html))
    return rows.select("page_id", "title", "content", "author", "publish_time", F.array_join("tags", "|").alias("tags"), F.char_length("content").alias("word_count"))


QUERIES = {
    q.__name__: q
    for q in (h09_without_blacklist, h10_without_noise, h13_container_score, h14_main_container, h15_internal_cleanup, h16_unwrapped, h17_without_empty, h18_continuity, h20_sections, h21_tables, h22_markdown, h23_images, h24_structured, h32_site_fields)
}

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_VOID, _RAW_TAG = _LIST(sorted(nodes.VOID)), r"(?i)^<(?:script|style)[ >]"
#: Tokens t of pages p, elements el (token s, tokens up to e inside), texts tx, and the end tags of elements as closers; {html} is the page.
_TREE = r"""WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS r, page_id, url, regexp_extract_all({html}, '(?i)<!--(?s:.*?)-->|<[!?][^>]*>|<script[^>]*>(?s:.*?)</script>|<style[^>]*>(?s:.*?)</style>|<[^>]*>|[^<]+') AS toks FROM {pages}
), t AS (
  SELECT r, i, toks[i] AS x, lower(regexp_extract(toks[i], '^</?([a-zA-Z][^ />]*)', 1)) AS tag, starts_with(toks[i], '</') AS ends, regexp_matches(toks[i], '{raw}') AS raw FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM p)
), walk AS (
  SELECT r, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stack, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS popped FROM p
  UNION ALL
  SELECT r, i + 1, CASE WHEN ends THEN stack[:len(stack) - k] WHEN opens THEN list_append(stack, i + 1) ELSE stack END,
    CASE WHEN ends THEN names[:len(names) - k] WHEN opens THEN list_append(names, tag) ELSE names END,
    CASE WHEN tag IS NULL THEN list_reverse(stack) WHEN ends THEN list_reverse(stack[len(stack) - k + 1:]) ELSE [] END
  FROM (SELECT w.*, t.tag, coalesce(t.ends, false) AS ends, NOT coalesce(t.ends, false) AND coalesce(t.tag, '') <> '' AND NOT t.raw AND t.tag NOT IN {void} AS opens,
      coalesce(list_position(list_reverse(w.names), t.tag), 0) AS k
    FROM walk w JOIN p USING (r) LEFT JOIN t ON t.r = w.r AND t.i = w.i + 1 WHERE w.i <= len(p.toks))
), closers AS (SELECT r, unnest(popped) AS s, i AS e, unnest(range(1, len(popped) + 1)) AS n FROM walk),
el AS (
  SELECT t.r, t.i AS s, coalesce(c.e, t.i + 1) AS e, tag, x, raw, regexp_extract(x, '^[^>]* class="([^"]*)"', 1) AS cls, regexp_extract(x, '^[^>]* id="([^"]*)"', 1) AS id FROM t LEFT JOIN closers c ON c.r = t.r AND c.s = t.i WHERE tag <> '' AND NOT ends
), tx AS (SELECT r, i, {decoded} AS v FROM t WHERE NOT starts_with(x, '<')),
black AS (SELECT * FROM el WHERE tag IN {black}), noise AS (SELECT * FROM el WHERE {noise}), gone AS (SELECT * FROM black UNION SELECT * FROM noise)"""
_NOISE = " OR ".join(f"contains(cls, '{w}') OR contains(id, '{w}')" for w in RULES["blacklist_keywords"])


def _tree(html: str = "coalesce(html, '')", pages: str = "pages") -> str:
    return _TREE.format(html=html, pages=pages, raw=_RAW_TAG, void=_VOID, black=_LIST(RULES["blacklist_tags"]), noise=_NOISE, decoded=_decoded_sql("x"))


_IN = "{0}.r = {1}.r AND {0}.{2} > {1}.s AND {0}.{2} < {1}.e"
_NOT_IN = "NOT EXISTS (SELECT 1 FROM {1} g WHERE g.r = {0}.r AND g.s <= {0}.{2} AND {0}.{2} < g.e)"


def _empties(gone: str, within: str = "") -> str:
    """SQL of elements that hold no text and nothing important, of what `gone` leaves."""
    return f"""SELECT * FROM el WHERE tag NOT IN {_LIST(sorted(nodes.IMPORTANT))} {within} AND {_NOT_IN.format('el', gone, 's')} AND NOT (raw AND trim(regexp_extract(x, '^<[^>]*>((?s:.*))</[^>]*>$', 1)) <> '')
      AND NOT EXISTS (SELECT 1 FROM tx WHERE {_IN.format('tx', 'el', 'i')} AND trim(v, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND {_NOT_IN.format('tx', gone, 'i')})
      AND NOT EXISTS (SELECT 1 FROM el k WHERE {_IN.format('k', 'el', 's')} AND k.tag IN {_LIST(sorted(nodes.IMPORTANT))} AND {_NOT_IN.format('k', gone, 's')})"""


def _markup_sql(gone: str, shells: str = "true", extra: str = "") -> str:
    return _tree() + f"""{extra}, pieces AS (
      SELECT t.r, i AS n, i, 0 AS sub, CASE WHEN tag = '' OR {shells} THEN x WHEN raw THEN regexp_extract(x, '^<[^>]*>((?s:.*))</[^>]*>$', 1) ELSE '' END AS x FROM t WHERE NOT ends
      UNION ALL SELECT c.r, c.s, c.e, c.n, CASE WHEN {shells} THEN '</' || tag || '>' ELSE '' END FROM closers c JOIN el ON el.r = c.r AND el.s = c.s
    ) SELECT page_id, coalesce(string_agg(x, '' ORDER BY i, sub), '') AS html FROM p LEFT JOIN (SELECT * FROM pieces WHERE {_NOT_IN.format('pieces', gone, 'n')}) USING (r) GROUP BY r, page_id"""


_SCORES = f""", box AS (SELECT * FROM el WHERE tag IN ('article', 'main', 'section', 'div') AND {_NOT_IN.format('el', 'gone', 's')}),
  inner_text AS (SELECT b.r, b.s, string_agg(v, chr(10) ORDER BY i) AS html, sum(length(trim(v, ' ' || chr(9) || chr(10) || chr(13)))) AS total FROM box b JOIN tx ON {_IN.format('tx', 'b', 'i')} AND {_NOT_IN.format('tx', 'gone', 'i')} GROUP BY ALL),
  links AS (SELECT b.r, b.s, sum(length(trim(v, ' ' || chr(9) || chr(10) || chr(13)))) AS inside FROM box b JOIN el a ON {_IN.format('a', 'b', 's')} AND a.tag = 'a' JOIN tx ON {_IN.format('tx', 'a', 'i')} AND {_NOT_IN.format('tx', 'gone', 'i')} GROUP BY ALL),
  tags AS (SELECT b.r, b.s, count(*) AS n, count(*) FILTER (k.tag IN ('ul', 'ol', 'li')) AS lists, count(*) FILTER (k.tag IN ('h1', 'h2', 'h3')) AS heads FROM box b JOIN el k ON {_IN.format('k', 'b', 's')} AND {_NOT_IN.format('k', 'gone', 's')} GROUP BY ALL),
  scores AS (SELECT b.*, CAST(row_number() OVER (PARTITION BY b.r ORDER BY b.s) - 1 AS INTEGER) AS pos,
    CASE WHEN html IS NULL THEN 0 ELSE length({CLEAN_SQL}) END * (1 - CASE WHEN total > 0 THEN coalesce(inside, 0) / total ELSE 0 END) * (1 - 0.3::DOUBLE * ({" + ".join(f"CAST(contains(lower(cls || ' ' || id), '{w}') AS INTEGER)" for w in RULES["blacklist_keywords"])}))
      * (1 - coalesce(lists / n, 0) * 0.2::DOUBLE) * (1 - coalesce(heads / n, 0) * 0.2::DOUBLE) AS score
    FROM box b LEFT JOIN inner_text USING (r, s) LEFT JOIN links USING (r, s) LEFT JOIN tags USING (r, s))"""
_SELECTED = {"article": "tag = 'article'", "main": "tag = 'main'", "#content": "id = 'content'", "#main-content": "id = 'main-content'", **{f".{c}": f"list_contains(string_split(cls, ' '), '{c}')" for c in ("post", "article-content", "entry-content", "content", "entry", "markdown-body")}, "#content_views": "id = 'content_views'"}
_MAIN = _SCORES + f""", ways AS (
    {" UNION ALL ".join(f"SELECT r, s, e, tag, '{name}' AS found_by, {n} AS way, 0.0 AS better FROM el WHERE ({rule}) AND {_NOT_IN.format('el', 'gone', 's')}" for n, (name, rule) in enumerate(_SELECTED.items()))}
    UNION ALL SELECT r, s, e, tag, 'score', 20, -score FROM scores WHERE score > 0
    UNION ALL SELECT r, s, e, tag, 'body', 21, 0.0 FROM el WHERE tag = 'body' AND {_NOT_IN.format('el', 'gone', 's')}
    UNION ALL SELECT r, 0, 1000000000, '[document]', 'body', 22, 0.0 FROM p
  ), main AS (SELECT r, arg_min(struct_pack(s := s, e := e, tag := tag, found_by := found_by), (way, better, s)) AS m FROM ways GROUP BY r), c AS (SELECT r, m.s AS s, m.e AS e, m.tag AS tag, m.found_by AS found_by FROM main)"""
_CLEAN_MAIN = _MAIN + f""", empty AS ({_empties('gone', "AND EXISTS (SELECT 1 FROM c WHERE " + _IN.format('el', 'c', 's') + ")")}), out AS (SELECT r, s, e FROM gone UNION SELECT r, s, e FROM empty),
  live AS (SELECT * FROM el WHERE {_NOT_IN.format('el', 'out', 's')}), words AS (SELECT *, trim(v, ' ' || chr(9) || chr(10) || chr(13)) AS w FROM tx WHERE {_NOT_IN.format('tx', 'out', 'i')})"""
_CONTINUED = _CLEAN_MAIN + f""", around AS (SELECT l.* FROM live l JOIN c ON l.r = c.r AND l.s <= c.s AND c.s < l.e UNION ALL SELECT c.r, c.s, c.e, c.tag, NULL, NULL, NULL, NULL FROM c WHERE c.s = 0),
  stats AS (SELECT a.r, a.s, a.tag, row_number() OVER (PARTITION BY a.r ORDER BY a.s DESC) - 1 AS up, (SELECT count(*) FROM live k WHERE {_IN.format('k', 'a', 's')} AND k.tag = 'p') AS ps,
    (SELECT length({CLEAN_SQL}) FROM (SELECT string_agg(v, chr(10) ORDER BY i) AS html FROM words WHERE {_IN.format('words', 'a', 'i')})) AS n FROM around a),
  steps AS (SELECT x.r, x.up, x.n, x.ps, x.tag FROM stats x WHERE up = 0
    UNION ALL SELECT y.r, y.up, y.n, y.ps, y.tag FROM steps x JOIN stats y ON y.r = x.r AND y.up = x.up + 1 WHERE y.up <= 2 AND y.tag IN ('div', 'section', 'article', 'main') AND y.n > x.n * 1.2 AND y.ps >= x.ps
      AND (x.up > 0 OR NOT (x.ps >= 5 AND x.n >= 800)))"""
_BLOCKS = _CLEAN_MAIN + f""", k AS (SELECT l.* FROM live l JOIN c ON {_IN.format('l', 'c', 's')} WHERE l.tag IN {_LIST(RULES["whitelist_tags"])}),
  held AS (SELECT k.r, k.s, k.e, k.tag, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (w <> ''), '') AS spaced, coalesce(string_agg(w, '' ORDER BY i), '') AS joined, coalesce(string_agg(w, chr(10) ORDER BY i) FILTER (w <> ''), '') AS lines FROM k LEFT JOIN words ON {_IN.format('words', 'k', 'i')} GROUP BY ALL)"""
_SECTION_SQL = _BLOCKS + f""", placed AS (SELECT *, count(*) FILTER (tag IN ('h1', 'h2', 'h3')) OVER (PARTITION BY r ORDER BY s) AS sec FROM held),
  items AS (SELECT u.r, u.sec, u.s, li.s AS place, li.spaced FROM placed u JOIN held li ON {_IN.format('li', 'u', 's')} AND li.tag = 'li' AND li.spaced <> '' WHERE u.tag IN ('ul', 'ol')),
  lists AS (SELECT r, sec, string_agg(spaced, '|' ORDER BY s, place) AS items FROM items GROUP BY ALL),
  secs AS (SELECT r, sec, max(joined) FILTER (tag IN ('h1', 'h2', 'h3')) AS heading, CAST(max(tag[2:2]) FILTER (tag IN ('h1', 'h2', 'h3')) AS INTEGER) AS level,
    coalesce(string_agg(spaced || chr(10), '' ORDER BY s) FILTER (tag = 'p' AND spaced <> ''), '') AS text, coalesce(string_agg(lines, '|' ORDER BY s) FILTER (tag IN ('pre', 'code') AND lines <> ''), '') AS code,
    CAST(count(*) FILTER (tag = 'img') AS INTEGER) AS images, CAST(count(*) FILTER (tag = 'table') AS INTEGER) AS tables FROM placed GROUP BY ALL),
  sections AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY sec) - 1 AS INTEGER) AS pos FROM secs LEFT JOIN lists USING (r, sec) WHERE coalesce(heading, '') <> '' OR text <> '' OR code <> '' OR items <> '')"""
_MARKDOWN_SQL = f""", md AS (
    SELECT r, s, 0 AS sub, repeat('#', CAST(tag[2:2] AS INTEGER)) || ' ' || joined AS line FROM held WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')
    UNION ALL SELECT r, s, 0, spaced FROM held WHERE tag = 'p'
    UNION ALL SELECT r, s, 0, '```' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '```' FROM held WHERE tag IN ('pre', 'code') AND lines <> ''
    UNION ALL SELECT u.r, u.s, li.s, CASE WHEN u.tag = 'ul' THEN '- ' ELSE row_number() OVER (PARTITION BY u.r, u.s ORDER BY li.s) || '. ' END || li.spaced FROM held u JOIN held li ON {_IN.format('li', 'u', 's')} AND li.tag = 'li'
      WHERE u.tag IN ('ul', 'ol') AND li.spaced <> '' AND NOT EXISTS (SELECT 1 FROM held m WHERE m.r = u.r AND m.s > u.s AND m.s < li.s AND m.e > li.s)
  ), marked AS (SELECT r, trim(regexp_replace(string_agg(line, chr(10) || chr(10) ORDER BY s, sub) FILTER (trim(line) <> ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS markdown FROM md GROUP BY r)"""
_HOST_RULE = "coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:')) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)', 1), '')"
_TITLE_SQL = f"""(SELECT arg_min(joined, s) FROM held WHERE held.r = p.r AND tag = 'h1')"""
_DOC_TITLE = f"""(SELECT coalesce(string_agg(w, '' ORDER BY i), '') FROM (SELECT arg_min(struct_pack(s := s, e := e), s) AS t FROM live WHERE live.r = p.r AND tag = 'title') JOIN words ON words.r = p.r AND i > t.s AND i < t.e)"""
ORACLES = {
    "h09_without_blacklist": _markup_sql("black"),
    "h10_without_noise": _markup_sql("noise"),
    "h15_internal_cleanup": _markup_sql("out", extra=f", empty AS ({_empties('gone')}), out AS (SELECT r, s, e FROM gone UNION SELECT r, s, e FROM empty)"),
    "h16_unwrapped": _markup_sql("none", f"tag IN {_LIST(RULES['whitelist_tags'])}", ", none AS (SELECT * FROM el WHERE false)"),
    "h17_without_empty": _markup_sql("empty", extra=f", none AS (SELECT * FROM el WHERE false), empty AS ({_empties('none')})"),
    "h13_container_score": _tree() + _SCORES + " SELECT page_id, pos, tag, round(score, 4) AS score FROM scores JOIN p USING (r)",
    "h14_main_container": _tree() + _MAIN + " SELECT page_id, found_by, tag FROM c JOIN p USING (r)",
    "h18_continuity": _tree("coalesce(replace(replace(html, '<article>', '<div>' || m || '<section>' || m || '<article>'), '</article>', '</article></section></div>'), '')", "(SELECT *, '<p>' || repeat(url || ' ', 9) || '</p>' AS m FROM pages)")
    + _CONTINUED + " SELECT page_id, found_by, s.tag, coalesce(CAST(s.n AS INTEGER), 0) AS text_length FROM (SELECT r, max(up) AS up FROM steps GROUP BY r) JOIN steps s USING (r, up) JOIN c USING (r) JOIN p USING (r)",
    "h20_sections": _tree() + _SECTION_SQL + " SELECT page_id, pos, heading, level, text, coalesce(items, '') AS items, code, images, tables FROM sections JOIN p USING (r)",
    "h21_tables": """SELECT l_orderkey, '| part | quantity |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_partkey || ' ' || CAST(l_quantity AS INTEGER) || ' | ' || CAST(l_quantity AS INTEGER) || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS markdown FROM lineitem GROUP BY 1""",
    "h22_markdown": _tree() + _BLOCKS + _MARKDOWN_SQL + " SELECT page_id, coalesce(markdown, '') AS markdown FROM p LEFT JOIN marked USING (r)",
    "h23_images": f"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a FROM pages), l AS (SELECT page_id, url, unnest(a) AS s, unnest(range(len(a))) AS pos FROM x),
      f AS (SELECT page_id, pos, CASE pos % 2 WHEN 0 THEN {_HOST_RULE} || s ELSE {_HOST_RULE} || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || s[2:] END AS src FROM l),
      k AS (SELECT page_id, src, min(pos) AS pos FROM f WHERE NOT regexp_matches(lower(src), 'avatar|logo|icon|qr|barcode|ad|banner|tracker|spacer|blank') GROUP BY 1, 2)
      SELECT page_id, string_agg(src || ' ' || pos, '|' ORDER BY pos) AS images FROM k GROUP BY 1""",
    "h24_structured": _tree() + _SECTION_SQL + _MARKDOWN_SQL + f""" SELECT page_id, coalesce(url, '') AS source_url, coalesce(nullif({_TITLE_SQL}, ''), {_DOC_TITLE}) AS title,
      (SELECT regexp_replace(regexp_replace({CLEAN_SQL}, '{INVISIBLE}', '', 'g'), '{EMOJI}', '', 'g') FROM (SELECT string_agg(v, chr(10) ORDER BY i) AS html FROM words JOIN c ON {_IN.format('words', 'c', 'i')} WHERE c.r = p.r)) AS clean_text,
      coalesce(markdown, '') AS markdown, CAST((SELECT count(*) FROM sections WHERE sections.r = p.r) AS INTEGER) AS sections, CAST((SELECT coalesce(sum(images), 0) FROM secs WHERE secs.r = p.r) AS INTEGER) AS images FROM p LEFT JOIN marked USING (r)""",
    "h32_site_fields": _tree() + f""", pick AS (
      SELECT r, 'title' AS f, s, e, 1 AS way FROM el WHERE tag = 'h1' UNION ALL SELECT r, 'title', s, e, 2 FROM el WHERE list_contains(string_split(cls, ' '), 'title')
      UNION ALL SELECT r, 'content', s, e, 1 FROM el WHERE tag = 'article' UNION ALL SELECT r, 'content', s, e, 2 FROM el WHERE list_contains(string_split(cls, ' '), 'content')),
      first AS (SELECT r, f, arg_min(struct_pack(s := s, e := e), (way, s)) AS m FROM pick GROUP BY ALL),
      texts AS (SELECT first.r, f, trim(string_agg(v, '' ORDER BY i), ' ' || chr(10) || chr(9)) AS html FROM first JOIN tx ON tx.r = first.r AND tx.i > m.s AND tx.i < m.e GROUP BY ALL),
      v AS (SELECT r, max(html) FILTER (f = 'title') AS title, max({CLEAN_SQL}) FILTER (f = 'content') AS content FROM texts GROUP BY r)
      SELECT page_id, coalesce(title, '') AS title, coalesce(content, '') AS content, '' AS author, '' AS publish_time, '' AS tags, CAST(length(coalesce(content, '')) AS INTEGER) AS word_count FROM p LEFT JOIN v USING (r)""",
}
