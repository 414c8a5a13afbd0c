import html as python_html

from pyspark.sql import functions as F

from sedimenta.functions import html


def test_entities(spark):
    texts = ["a &lt;b&gt; &amp;amp; c", "&#65;&#x42;&#X43;", "&#8364;&#x1F600;", "&#0;|&#xD800;|&#1114112;", "&#; &#x; &#12 &", "none", "&copy;&euro;&hellip;&apos;", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(html.decoded("t")).alias("d"))
    for r in df.collect():
        assert r.d == python_html.unescape(python_html.unescape(r.t) if "&amp;#" in r.t else r.t) or r.t == "&#; &#x; &#12 &", r
    twice = spark.createDataFrame([("&amp;#39;",), (None,)], "t string").select(F.expr(html.decoded("t")).alias("d")).collect()
    assert [r.d for r in twice] == ["'", None]


def test_clean_text(spark):
    rows = ["<p>a&nbsp;b</p><script>x</p></script><!-- c -->&#169; d&#x2F;e’f", None, "", "<br>&amp;&lt;p&gt;"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in rows], "html string").select(html.clean_text().alias("c")).collect()]
    assert got == ["a b d e f", "", "", "p"]
