import pytest

from sedimenta import registry
from verify import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_url_cases(spark):
    from sedimenta.functions.urls import normalized

    cases = {
        " HTTP://A.com:80?b=2&a=1&utm_source=x#f ": "http://a.com/?a=1&b=2",
        "https://a.com:443/P/?V=1&q=&z=1&z=0": "https://a.com/P/?z=1&z=0",
        "https://a.com:80/": "https://a.com:80/",
        "no scheme": "no scheme",
    }
    df = spark.createDataFrame([(u, w) for u, w in cases.items()] + [(None, None)], "url string, want string")
    assert [tuple(r) for r in df.select(normalized().alias("got"), "want").where("not got <=> want").collect()] == []
