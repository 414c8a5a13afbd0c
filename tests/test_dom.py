"""The node table and what cleaning takes from it, on hand-made pages with literal expectations."""

import pytest

from sedimenta.functions import nodes
from sedimenta.functions.nodes import RULES, Page
from sedimenta.operators import dom


def after(html, *steps):
    page = Page(html)
    for step in steps:
        step(page)
    return page.serialized()


NOISE, TAGS = (lambda p: p.remove_noise(RULES)), (lambda p: p.remove_tags(RULES))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><div>x</div>y</div>z", "<div><div>x</div>y</div>z"),
        ("<p>a<b>c<br>d</p>e", "<p>a<b>c<br>d</b></p>e"),  # an end tag closes what is open inside
        ("<p>a</b></p></p>e", "<p>a</p>e"),  # end tags without an opener go
        ("<P CLASS=x>a", "<P CLASS=x>a</p>"),
        ("<li>a<li>b", "<li>a<li>b</li></li>"),  # nothing closes by itself
        ('<a href="x>y" title=\'<b>\'>t</a>', '<a href="x>y" title=\'<b>\'>t</a>'),
        ("<script>if (a < b) '</p>'</SCRIPT>x", "<script>if (a < b) '</p>'</script>x"),
        ("<style>a{}", "<style>a{}</style>"),
        ("a < b <!-- <p> --> c <!x> <?y?>", "a < b <!-- <p> --> c <!x> <?y?>"),
        ("<!-- open <p>x", "<!-- open <p>x"),
        ("<div/>x<img/>y", "<div/>x<img/>y"),
        ("", ""),
    ],
)
def test_trees(html, want):
    assert after(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div class="sidebar"><div>x</div>NOISE</div>k', "k"),
        ('<span id="my-header">x</span><p class="shadow">y</p><p class="Sidebar">z</p>', '<p class="Sidebar">z</p>'),  # a part is enough, in the same case
        ('<body class="download"><p>x</p></body>', ""),
        ("<p class>x</p><p data-class='ad'>y</p>", "<p class>x</p><p data-class='ad'>y</p>"),
    ],
)
def test_noise(html, want):
    assert after(html, NOISE) == want


def test_blacklist():
    assert after("<nav><ul><li>a</ul></nav><header>h<header>i</header>j</header><meta x><link y><p>k</p><form><input>f</form>", TAGS) == "<p>k</p>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<aside></aside><dl><dt> </dt></dl><p>x<b></b></p>", "<p>x</p>"),
        ("<div><img></div><div><br></div><pre></pre><td></td><blockquote></blockquote>", "<div><img></div><div><br></div><pre></pre><td></td><blockquote></blockquote>"),
        ("<section><div>\n&nbsp;<i></i></div></section>y", "y"),
        ("<hr>z<head><script>s()</script></head><script>t()</script><script src=u></script>", "z<script>t()</script>"),
    ],
)
def test_empty(html, want):
    assert after(html, Page.remove_empty) == want


def test_unwrap():
    assert after('<div><span>a<b>c</b></span><p>d<a href="x">e</a></p></div>', lambda p: p.unwrap(RULES)) == "a<b>c</b><p>de</p>"


@pytest.mark.parametrize(
    ("selector", "want"),
    [("b", ["1", "3"]), ("#i", ["2"]), (".c", ["1", "2"]), (".c.d", ["2"]), ("b.c", ["1"]), ("div .c", ["2"]), ("div b", ["3"]), ("[role=main]", ["3"]), ('[role*="ai"]', ["3"]), ("div b, .c", ["1", "2", "3"]), ("ul div b", ["3"]), ("ul ul b", [])],
)
def test_selectors(selector, want):
    page = Page('<b class="c">1</b><ul><div><i id="i" class="d c">2</i><b role="main">3</b></div></ul>')
    assert [page.get_text(j) for j in page.select(selector)] == want


def test_main_container():
    find = lambda html, host="": (lambda p, f: (p.get_text(f[0]), f[1]))(p := Page(html), p.main_container(host, RULES))
    assert find('<main>m</main><div class="post">p</div><article>a</article>') == ("a", "article")
    assert find('<div class="x post">p</div><div id="content">c</div>') == ("c", "#content")
    both = '<article>a</article><div id="content_views">v</div>'
    assert find(both) == ("a", "article")
    assert find(both, "blog.csdn.net") == ("v", "#content_views")
    assert find("<div>short</div><section>much longer text</section>") == ("much longer text", "score")
    assert find("<div><a>only links</a></div><body>b</body>") == ("b", "body")
    assert find("no tags") == ("no tags", "body")


def test_score():
    page = Page('<div class="Sidebar Ad"><ul><li>one two</li></ul><h1>head</h1><a>link</a></div>')
    text, density = len("one two head link"), 4 / len("one twoheadlink")
    noise = len([w for w in RULES["blacklist_keywords"] if w in "sidebar ad"])
    assert page.score(1, RULES) == pytest.approx(text * (1 - density) * (1 - noise * 0.3) * (1 - 2 / 4 * 0.2) * (1 - 1 / 4 * 0.2))


def test_continuity():
    long = "w" * 300
    tag = lambda html: (lambda p, i, f: p.tag[i])(*nodes.cleaned(html, "", RULES))
    assert tag(f"<section><p>{long}</p><article>{long}</article></section>") == "section"
    assert tag(f"<div><p>{long}</p><section><p>{long}</p><article>{long}</article></section></div>") == "div"
    assert tag(f"<ul><p>{long}</p><article>{long}</article></ul>") == "article"  # no container
    assert tag(f"<div><p>{'w' * 59}</p><article>{long}</article></div>") == "article"  # not a fifth more
    assert tag(f"<div><p>{long * 9}</p><article>{f'<p>{long}</p>' * 5}</article></div>") == "article"  # long enough


PAGE = """<html><head><meta property="og:title" content=" M "><title> T </title></head><body><nav>n</nav><article><p>intro &amp; <b>more</b></p>
<h2>Two <i>x</i></h2><ul><li>a<ul><li>b</li></ul></li><li></li></ul><ol><li>c</li><li> </li><li>d</li></ol><pre><code>k = 1</code></pre><blockquote>q<br>r</blockquote>
<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr><tr></tr></table><h3></h3><img src="/i.png" alt="I"><img data-src="//c.com/j.png"><img src="/logo.png"><img alt="none"><img src="/i.png"></article></body></html>"""


def test_structured():
    out = nodes.structured(PAGE, "http://a.com/x/y", RULES)
    assert out["title"] == "T"  # metas are gone by then
    assert out["images"] == [{"src": "http://a.com/i.png", "alt": "I"}, {"src": "https://c.com/j.png", "alt": ""}, {"src": "", "alt": "none"}]  # as images go, one without an address stays
    empty = {"heading": None, "level": None, "text": "", "lists": [], "images": [], "code_blocks": [], "tables": []}
    assert out["sections"] == [
        empty | {"text": "intro & more\n"},
        empty | {"heading": "Twox", "level": 2, "lists": ["a b", "b", "b", "c", "d"], "code_blocks": ["k = 1", "k = 1"], "tables": [[["h", "i"], ["1", "2"]]], "images": [{"src": s, "alt": a} for s, a in (("/i.png", "I"), ("//c.com/j.png", ""), ("/logo.png", ""), ("/i.png", ""))]},
    ]
    assert out["markdown"].split("\n\n") == [
        "intro & more", "## Twox", "- a b", "- b", "1. c", "2. d", "```", "k = 1", "```", "```", "k = 1", "```", "> q", "> r", "| h | i |\n| --- | --- |\n| 1 | 2 |",
        "![I](http://a.com/i.png)", "![](https://c.com/j.png)", "![](http://a.com/logo.png)", "![](http://a.com/i.png)",
    ]


def test_site_fields():
    html = """<h1>other</h1><div class="article-title-box"><h1> Title </h1></div><div id="content_views">a<script>s</script> <p class="hljs-button">copy</p>b&lt;c</div>
    <div class="user-info"><span class="name">N</span></div><span class="article-bar-top"><i class="time">2024</i></span><div class="tags-box"><a class="tag-link">x</a><a class="tag-link"> y</a></div><a class="tag">z</a>"""
    assert nodes.site_fields(html) == {"title": "Title", "content": "a b c", "author": "N", "publish_time": "2024", "tags": ["x", "y"]}
    assert nodes.site_fields("") == {"title": "", "content": "", "author": "", "publish_time": "", "tags": []}


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</p>" * 3000
    page = Page(deep)
    page.remove_empty()
    assert page.get_text(0) == "x" and page.last[1] == len(page.tag) - 1
    wide = "<p>a<b>" * 20_000 + '<a href="' + "=" * 100_000
    assert Page(wide).get_text(0).startswith("aa")


def test_structured_pages(spark, tmp_path):
    rows = [(1, "http://a.com/x/y", PAGE), (1, "http://a.com/x/y", PAGE), (None, None, None), (2, "http://a.com", "<article>z</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.title, r.clean_text, len(r.sections), len(r.images)) for r in dom.structured_pages(pages).collect()))
    whole = "intro more Two x a b c d k 1 q r h i 1 2"
    assert got == [(0, "", "", 0, 0), (1, "T", whole, 2, 3), (1, "T", whole, 2, 3), (2, "", "z", 0, 0)]
    (tmp_path / "rules.json").write_text('{"main_container_selectors": [".z"], "version": "2"}')
    rules = dom.load_rules(spark, str(tmp_path / "rules.json"))
    assert rules["main_container_selectors"] == [".z"] and rules["blacklist_tags"] == RULES["blacklist_tags"]
    other = spark.createDataFrame([(1, "", '<article>a</article><div class="z">b</div>')], "page_id long, url string, html string")
    assert [r.raw for r in dom.main_containers(other, rules).collect()] == ["b"]
    (tmp_path / "bad.json").write_text("{")
    assert dom.load_rules(spark, str(tmp_path / "bad.json")) == RULES
