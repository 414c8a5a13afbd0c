import numpy as np

from sedimenta.llm import url_filter
from sedimenta.llm.queries import URL_RULES


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "https://example.org", "http://example.org/en/12", "http://org/", "http://xorg/", "x.com/de/", "http://a.com/de/", "http://a.com/fr/b", "http://é.com/de/\n?", None, "", "://", "http://a.org:80/", "http://b.org?/", "a://b://c.org/", "http://" + "a." * 3000 + "org/", "http://.org/"]
    df = spark.createDataFrame([(i % 9, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [tuple(r) for r in url_filter.judge_urls(df, URL_RULES).collect()]
    want = [(i % 9, *brute(u, URL_RULES)) for i, u in enumerate(urls)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}
    table = spark.createDataFrame([*URL_RULES, ("allow", "org", None), ("allow", "com", "/de/"), ("block", "exampl", "e.org/es/"), ("allow", "", "/")], "verdict string, host string, path string")
    more = [*URL_RULES, ("block", "exampl", "e.org/es/"), ("allow", "", "/")]
    want = sorted(map(str, [(i % 9, *brute(u, more)) for i, u in enumerate(urls)]))
    for most in (2, 100):
        assert sorted(map(str, map(tuple, url_filter.judge_urls(df, table, most_rules=most).collect()))) == want
        assert sorted(map(str, map(tuple, url_filter.judge_urls(df, more, most_rules=most).collect()))) == want


def test_keys_of_long_hosts_do_not_grow_with_their_square():
    keys = list(url_filter.candidates("a." * 100_000 + "org", "/" * 50_000, url_filter._lengths([(3, 1), (3, 4), (5, 0), (900, 1)])))
    assert keys == [("org", "/"), ("org", "////"), ("a.org", "")]


def test_equal_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda h, p: len(h + p))
    rules = url_filter.DigestFile.of([("allow", "ab", "/"), ("block", "cd", "/"), ("block", "e", "/")])
    assert rules.digests.tolist() == [2, 3, 3]
    assert [[rules.string(j) for j in js] for js in rules.find(np.array([3, 2, 9], np.uint64))] == [["ab/", "cd/"], ["e/"], []]
