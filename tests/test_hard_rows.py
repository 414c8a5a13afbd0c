"""All engine queries on small tables with nulls, blanks, repeated rows and odd values, against their SQL."""

import datetime as dt
import os

import duckdb
import pytest

from sedimenta import registry
from verify import compare

T = dt.datetime
TABLES = {
    "region": ("r_regionkey INTEGER, r_name VARCHAR", [(0, "A"), (1, None)]),
    "nation": ("n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER", [(0, "N", 0), (1, "", 1)]),
    "customer": ("c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR", [(1, "C1", 0, 1.0, "BUILDING"), (2, "C 2", 1, None, "OTHER")]),
    "supplier": ("s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE", [(1, "S1", 0, 0.0), (2, "S2", 1, None)]),
    "part": ("p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE", [(1, "red  bolt", "B", "X", 5, 1.0), (2, "a", "b", "c", 0, None)]),
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR", [(1, 1, "O", 1.0, T(2024, 1, 1), "1"), (2, None, None, None, None, None)]),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
        [(o, p, s, n, float(n + 10 * o), 1.0, 0.0, 0.0, "RAN"[n % 3], "OF"[n % 2], None) for o in range(1, 6) for n, (p, s) in enumerate([(o, 1), (2, 2), (3, o)], 1)],
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
        [(i, T(2024, 1, 10 + i % 9, i % 24), i % 3, ["click", "view", "error"][i % 3 if i < 6 else 0], [None, 50.0, 10.0][i % 3], '{"k": %d}' % i) for i in range(20)],
    ),
    "documents": (
        "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
        [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(["the rule must hold. 规则：必须 the end", "", "   ", "a" * 70, "a" * 70, "<p>html &amp; text</p>\nhttps://a.com/x y", "示例：一\n结果: 二。步骤一是收集所有用户需求并整理成完整清单文档！", "数据流图是指描述系统中数据流动和处理过程的图形化工具。" * 9, "处理校验计算，请求响应数据；记录表数据库。用户管理员 DFD Data Flow 概念定义规则必须如果则要求。流程步骤示例例子约束 MIS 订单 Level 错误问题 正确建议命名。" * 12, "process data flow concept definition rule DFD. " * 30])],
    ),
    "labels": ("doc_id BIGINT, quality INTEGER, toxic INTEGER", [(0, 1, 0), (1, 0, 1), (2, None, None), (3, 1, None)]),
    "benchmark": ("item_id BIGINT, text VARCHAR", [(0, "the rule"), (1, None)]),
    "pages": (
        "page_id BIGINT, url VARCHAR, html VARCHAR",
        [
            (11, "HTTP://A.example.com:80/x?utm_source=1&b=2&a=&a=3#f", '<html lang="de"><head><title> T  x/y </title></head><body class="main"><nav><a href="/The">The</a><a href="/and">and</a></nav><article><h1>H <b>b</b></h1><p>A paragraph of more than twenty characters.</p><ul><li>i</li><li></li></ul><h2></h2><p></p><pre>c</pre></article></body></html>'),
            (12, "http://a.example.com/x?a=3&b=2", '<title></title><a href="/and">and</a><a href="/The">The</a><a href="/x">x</a>'),
            (13, "nohost", "plain text, no tags at all"),
            (14, "https://b.org/d/e?q#z", '<div class="ad">x</div><a href="/and">and</a><a href="/the">the</a><div id="__next"></div>'),
        ],
    ),
    "conversations": ("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", [(1, 0, "user", "什么是数据流? level and a long enough text"), (1, 1, "assistant", "b " * 3000), (2, 0, "system", ""), (2, 1, "user", "x"), (3, 0, "user", "y")]),
    "embeddings": ("vec_id BIGINT, embedding FLOAT[], label INTEGER", [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.6, 0.8], 2), (3, [0.0, 1.0], 3), (50, [0.8, 0.6], 2), (100, [0.0, 1.0], 0), (101, [0.1, 0.9], None)]),
}


def save(folder, empty, nulls=False):
    con = duckdb.connect()
    for name, (columns, rows) in TABLES.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if not empty:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        if nulls:
            con.execute(f"INSERT INTO {name} VALUES ({', '.join(['900'] + ['NULL'] * (len(columns.split(', ')) - 1))})")
            con.execute(f"INSERT INTO {name} VALUES ({', '.join(['NULL'] * len(columns.split(', ')))})")
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    return save(tmp_path_factory.mktemp("hard"), False)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return save(tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_matches_sql(spark, full, name):
    assert compare(spark, full, registry.queries()[name], registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["r07_export", "r09_two_stages", "h14_main_container", "h20_sections", "h24_structured", "h32_site_fields", "a09_keyword_signals", "e15_sentence_candidates"])
def test_repeated_ids(spark, tmp_path, name):
    """Rows that share an id are rows of their own."""
    folder = save(tmp_path, False)
    for table, key in (("documents", "doc_id"), ("pages", "page_id")):
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} // 2 AS {key}) FROM '{folder}/{table}.parquet') TO '{folder}/{table}2.parquet'")
        os.replace(f"{folder}/{table}2.parquet", f"{folder}/{table}.parquet")
    assert compare(spark, folder, registry.queries()[name], registry.oracle_sql()[name]) == ""


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    return save(tmp_path_factory.mktemp("nulls"), False, True)


@pytest.mark.parametrize("name", registry.queries())
def test_null_rows(spark, nulls, name):
    registry.queries()[name](spark, nulls).collect()


@pytest.mark.parametrize("name", registry.queries())
def test_empty_tables(spark, empty, name):
    registry.queries()[name](spark, empty).collect()
