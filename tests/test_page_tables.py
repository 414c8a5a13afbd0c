"""Tables of pages without the rest of the structured record."""

from sedimenta.functions import nodes
from sedimenta.functions.nodes import RULES
from sedimenta.operators import dom

PAGES = [
    (1, "http://a.example.com/", "<article><h2>a</h2><table><tr><th>h<td>1</tr><tr></tr></table><h3>b</h3><table><tr><td>x<table><tr><td>y</table></table><table></table></article>"),
    (2, "http://a.example.com/", "<div><p>short</p><section><p>t</p><article><table><tr><td class='ad'>gone<td>k</tr></table></article></section></div>"),
    (3, None, None),
    (4, "http://a.example.com/", "<p>no table</p>"),
]


def test_same_as_in_sections(spark):
    pages = spark.createDataFrame(PAGES * 200, "page_id long, url string, html string").coalesce(1)
    want = [(i, t) for i, url, html in PAGES * 200 for s in nodes.structured(html or "", url or "", RULES)["sections"] for t in s["tables"]]
    assert sorted((r.page_id, r.rows) for r in dom.page_tables(pages).collect()) == sorted(want) and len(want) == 600


def test_tables_query_makes_no_records(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the whole record of a page")

    monkeypatch.setattr(dom, "structured_pages", refuse)
    assert dom.h21_tables(spark, "/root/testdata/sf0.001").columns == ["l_orderkey", "markdown"]
