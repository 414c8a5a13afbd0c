import duckdb
import pytest

from sedimenta.operators import signals
from verify import compare

TEXTS = [
    "The data flow has a process. A definition of the concept is given here. Short.\nA rule must hold: 规则必须 apply in each case",
    "规则 概念 定义 流程 处理 DFD DFD",
    "<p>a &amp; b</p> see https://a.com/x?y=1 and http://b.org/z",
    "https://a.com/x\nwww.b.net only this\nplain text line\n http://c.cn and https://d.org with more words than a URL line would have, and so on until it is long enough to count as text",
    "![img](http://x.y/z.png)  text\n\n\n\n![](a)more\t\n",
    "&#39; &#x2F; alone",
    "none",
    "   ",
    "",
    None,
    "aaaa concept concept concept " * 3000,
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, 0)", [(i, t, None if i % 3 else "s") for i, t in enumerate(TEXTS)])
    con.execute(f"COPY documents TO '{at}/documents.parquet'")
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1, 'https://a.com/x?y=1', '<h1>A <b>x</b></h1><H3 id=1>c\n</H3>'), (2, NULL, NULL), (3, 'u', '')) t(page_id, url, html)")
    con.execute(f"COPY pages TO '{at}/pages.parquet'")
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 5, 'a', 1.0::DOUBLE), (2, TIMESTAMP '2024-01-01 00:00:00', 5, 'b', NULL), (3, TIMESTAMP '2024-01-01 02:30:00', 5, 'a', 2.0)) t(event_id, ts, user_id, event_type, value)")
    con.execute(f"COPY events TO '{at}/events.parquet'")
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (1, 2), (2, NULL), (3, 2)) t(vec_id, label)")
    con.execute(f"COPY embeddings TO '{at}/embeddings.parquet'")
    return str(at)


@pytest.mark.parametrize("name", sorted(signals.QUERIES))
def test_hard_rows_match_sql(spark, folder, name):
    assert compare(spark, folder, signals.QUERIES[name], signals.ORACLES[name]) == ""


def test_cues_are_found(spark, folder):
    got = {r.doc_id: r for r in signals.e15_sentence_candidates(spark, folder).collect()}
    assert (got[0].concept_candidates, got[0].rule_candidates, got[8].concept_candidates) == (1, 1, 0)
    got = {r.doc_id: r for r in signals.a09_keyword_signals(spark, folder).collect()}
    assert (got[1].dfd, got[1].concepts, got[1].rules, got[1].types) == (4, 2, 1, "dfd,concepts,rules")
    assert got[8].types == "concepts,rules"
    assert [r.doc_id for r in signals.h08_is_html(spark, folder).where("is_html").orderBy("doc_id").collect()] == [2, 5]
    assert {r.doc_id: r.url_lines for r in signals.p17_url_lines(spark, folder).collect()}[3] == 2
