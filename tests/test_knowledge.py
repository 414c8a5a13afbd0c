import duckdb
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import html
from sedimenta.operators import caches, chunking, extraction, knowledge, retrieval, structure
from sedimenta.sources import artifacts
from sedimenta.streaming import dedup
from verify import compare

TEXTS = [
    "系统必须在提交之前检查所有输入数据，如果失败则回滚并通知使用者。另一个句子也足够长，可以算作有意义的句子。示例：输入甲\n结果: 乙",
    '"key": "value",\n{\nhttps://a.com only\n12345\nThe rule must hold for the whole of this long sentence here. And the other sentence must hold too, %41 title: x',
    "emoji 😀☀​‏ text\n\n\n\nend ÿ",
    "UML application",
    "",
    "   ",
    None,
    "word " * 20000,
    "1、数据流图是指描述系统中数据流动和处理过程的图形化工具3。第二句话介绍外部实体的定义以及它和系统之间的各种关系与边界。步骤一是收集所有用户需求并整理成完整清单文档！随后分析每一个需求的可行性和实现代价细节。"
    "模板：该结构框架能够帮助工程师快速完成系统设计任务吗？\n1. 检查所有输入是否有效\n2、确认输出格式符合标准要求\n• 记录全部出现的错误问题",
    "一、模式 说明：这里给出一个可以重复使用的设计模式供大家参考学习。流程图展示了从开始到结束的所有步骤与分支情况说明。（边界）用来称呼系统与外界之间的分隔，\"接口\"则用于连接两边的不同部件。",
]
PAGES = [
    (1, "https://www.zhihu.com/a.png", "<html><title>名称 x</title><body><nav>n</nav><article class=a><h1>A <b>b</b></h1><p>one<br>two</p><H3 id=1>C</H3><ul><li>i</li></ul></article></body></html>"),
    (2, None, None),
    (3, "", ""),
    (4, "https://www.zhihu.com/a.png", "<p>no heading</p><a href=x>link</a>"),
    (5, "http://logo.de/img", "<h2>only</h2>" + "t " * 3000),
]
MODULES = (extraction, structure, chunking, knowledge, html)
CASES = [(m, n) for m in MODULES for n in m.QUERIES if n != "c02_cases"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()

    def save(name, columns, rows):
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{at}/{name}.parquet'")

    save("documents", "doc_id BIGINT, text VARCHAR", list(enumerate(TEXTS)))
    save("pages", "page_id BIGINT, url VARCHAR, html VARCHAR", PAGES)
    save("conversations", "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", [(1, 0, "user", "什么是数据流? level"), (1, 1, "user", "概念 rule"), (2, 0, None, None), (2, 1, "user", None)])
    vectors = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [0.6, 0.8], 2), (52, None, 1), (53, [float("nan"), 1.0], 1), (54, [1.0, 0.0], None), (55, [1.0, None], 2), (100, [0.0, 1.0], 2)]
    save("embeddings", "vec_id BIGINT, embedding FLOAT[], label INTEGER", vectors)
    return str(at)


@pytest.mark.parametrize("module, name", CASES)
def test_hard_rows_match_sql(spark, folder, module, name):
    assert compare(spark, folder, module.QUERIES[name], module.ORACLES[name]) == ""


def test_intents(spark, folder):
    got = {(r.conv_id, r.turn): r.intent for r in retrieval.v05_intent(spark, folder).collect()}
    assert got == {(1, 0): "concept", (1, 1): "rule", (2, 1): "general"}


def test_nearest_skips_broken_vectors(spark, folder):
    rows = [(*r[:3], round(r[3], 6), r[4]) for r in retrieval.j09_collection_knn(spark, folder).orderBy("query_id", "collection", "place").collect()]
    assert rows == [(0, 1, 50, 1.0, 1), (0, 2, 51, 0.6, 1), (0, 2, 100, 0.0, 2), (50, 1, 0, 1.0, 1), (50, 2, 51, 0.6, 1), (50, 2, 100, 0.0, 2), (100, 1, 0, 0.0, 1), (100, 1, 50, 0.0, 2), (100, 2, 51, 0.8, 1)]


def test_rules(spark, folder):
    got = extraction.rule_rows(spark.read.parquet(f"{folder}/documents.parquet"), extraction.RULE_WORDS, 10, 6).collect()
    assert [(r.doc_id, r.rule_id) for r in got if r.doc_id < 8] == [(0, "rule_001")]


def test_concepts_and_patterns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [(r.doc_id, r.concept_id, r.name) for r in knowledge.concepts(docs).orderBy("doc_id", "concept_id").collect()]
    assert (8, "concept_001", "数据流图") in got
    first = knowledge.concepts(docs).where("doc_id = 8").orderBy("concept_id").first()
    assert first.definition == "数据流图是指描述系统中数据流动和处理过程的图形化工具。"
    steps = knowledge.transformations(docs).where("doc_id = 8").orderBy("transformation_id").first()
    assert steps.first_step.startswith("1、数据流图") or steps.first_step.startswith("步骤")
    assert {r.doc_id: r["items"] for r in knowledge.checklist(docs).collect()}[8].count("检查所有输入是否有效") == 1


def test_categories(spark):
    rows = [(0.9, 3, "A DFD of it"), (0.6, 3, "dfd"), (0.9, 1, "dfd"), (0.7, 2, "requirement analysis, uml"), (0.8, 2, "none"), (0.8, 2, None)]
    df = spark.createDataFrame(rows, "r double, n int, t string")
    got = [r.c for r in df.select(structure.category(F.col("r"), F.col("n"), F.col("t")).alias("c")).collect()]
    assert got == ["dfd_modeling", "archived", "archived", "requirement_analysis", "uncategorized", "uncategorized"]


def test_dynamic_pages_and_validity(spark):
    from sedimenta.operators import corpus

    pages = ['<div id="app">', "window.__NUXT__=1", "LOADING", "<p>plain</p>", None, "__INITIAL_STATE__", "ng-app"]
    got = [r.d for r in spark.createDataFrame([(p,) for p in pages], "html string").select(html.is_dynamic().alias("d")).collect()]
    assert got == [True, True, True, False, False, True, False]
    texts = ["abcd", "abcde", "a\0bcde", "ÿabcdef", "12345", "\x01\x02\x03\x04\x05", None, "  a  "]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "text string").select(corpus.valid_text("text").alias("v")).collect()]
    assert got == [False, True, False, False, True, False, False, True]


def test_ttl_across_buckets(spark):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:59:00"), (3, "a", "2024-01-01 01:30:00"), (4, "a", "2024-01-01 03:00:00"), (5, "b", "2024-01-01 03:00:00"), (6, "b", "2024-01-01 03:00:00"), (7, None, "2024-01-01 03:00:00"), (8, "b", None)]
    df = spark.createDataFrame(rows, "id long, k string, ts string").selectExpr("id", "k", "cast(ts as timestamp) ts")
    got = {r.id: r.seen for r in caches.with_seen(df, ["k"], "ts", "id", 3600).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}


def test_structural_duplicates(spark):
    sets = {1: "abc", 2: "abc", 3: "abcd", 4: "xyz", 5: "abxy", 6: "xyzabc"}
    df = spark.createDataFrame([(i, v) for i, s in sets.items() for v in s], "item_id long, value string")
    got = {r.item_id: (r.match_id, round(r.similarity, 4)) for r in caches.structural_duplicates(df, 0.6).collect()}
    assert got == {2: (1, 1.0), 3: (1, 0.75), 6: (5, 0.6667)}
    assert caches.structural_duplicates(df.limit(0), 0.6).collect() == []


def test_search_items(spark):
    raw = [
        (1, '{"organic_results": [], "web_results": [{"url": "u1", "name": "n", "position": 0, "rank": 3}, {"title": "no url"}]}'),
        (2, '{"organic_results": {"link": "u2", "snippet": "", "description": "d", "position": 2}}'),
        (3, "not json"),
        (4, None),
    ]
    got = artifacts.search_items(spark.createDataFrame(raw, "id long, raw string")).orderBy("id").collect()
    assert [(r.id, r.url, r.title, r.snippet, r.position) for r in got] == [(1, "u1", "n", None, 3), (2, "u2", None, "d", 2)]


def test_scan_leaves_broken_lines_out(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "domain=a").mkdir()
    (tmp_path / "domain=a" / "x.json").write_text('{"page_id": 1}\n{broken\n{"page_id": 2}\n')
    (tmp_path / "domain=a" / "x.trace").write_text('{"page_id": 3}\n')
    got = artifacts.scan_artifacts(spark, str(tmp_path), StructType().add("page_id", "long").add("domain", "string"))
    assert sorted(r.page_id for r in got.collect()) == [1, 2]
    (tmp_path / "urls.txt").write_text("# c\n\n http://a \nhttp://b\n")
    assert sorted(r.url for r in artifacts.read_url_list(spark, str(tmp_path / "urls.txt")).collect()) == ["http://a", "http://b"]


def test_recovered_json(spark):
    cases = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'so: {"a": {"b": 3}} end', "none", "", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, reply string")
    got = [r.j for r in df.select("i", artifacts.recovered_json("reply").alias("j")).orderBy("i").collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": {"b": 3}}', None, None, None]


def test_streams_go_on(spark, tmp_path):
    """State is kept between runs: what an earlier run has shown is not shown again."""
    rows = tmp_path / "in"
    seen = []
    for texts in (["a b", "a  b", "c"], ["c", "d"]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(str(rows))
        stream = dedup.first_contents(spark.readStream.schema("text string").parquet(str(rows)))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen == [2, 3]
