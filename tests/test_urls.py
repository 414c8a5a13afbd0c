from pyspark.sql import functions as F

from sedimenta.functions import urls

CASES = {
    "HTTP://A.com:80": "http://a.com/",
    "https://a.com:443/P?b=2&a=1#f": "https://a.com/P?a=1&b=2",
    "http://a.com:443/": "http://a.com:443/",
    "http://a.com/?UTM_source=x&q=1&fbclid=2&v=3": "http://a.com/?q=1",
    "http://a.com/?a=&b&c=1": "http://a.com/?c=1",
    "http://a.com/?a=2&b=1&a=1": "http://a.com/?a=2&a=1&b=1",
    "http://a.com/?q=a+b%20c%7E*": "http://a.com/?q=a+b+c~%2A",
    "http://a.com/?q=%C3%A9&q=é": "http://a.com/?q=%C3%A9&q=%C3%A9",
    "http://a.com/?%75tm_source=1": "http://a.com/",
    "http://a.com/?x=1=2": "http://a.com/?x=1%3D2",
    "  http://a.com/x  ": "http://a.com/x",
    "no scheme": "no scheme",
    "": "",
    None: None,
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string").withColumn("n", urls.normalized())
    assert {r.url: r.n for r in df.collect()} == CASES
    assert df.select(urls.normalized("n").alias("m"), "n").where("not m <=> n").count() == 0


def test_slugs(spark):
    rows = [("  a b/c:d  ", "u"), ("", None), (None, "u"), ("x" * 90, "u")]
    got = [r.s for r in spark.createDataFrame(rows, "t string, u string").select(urls.title_slug(F.col("t"), F.col("u")).alias("s")).collect()]
    assert got == ["a-b_c_d-7b774eff", "untitled-d41d8cd9", "untitled-7b774eff", "x" * 60 + "-7b774eff"]
